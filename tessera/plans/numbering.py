"""Row numbers over a whole table without a window over everything.

Rows are sorted in ranges and written; a row's number is its place in its
range plus the sizes of the ranges before, of which there is one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialise, unused

_PLACES = 33  # bits of monotonically_increasing_id that count within a partition


def number_rows(df: DataFrame, name: str, order: list[str | Column] | None = None) -> DataFrame:
    """``df`` with a bigint column ``name``, 0 to n - 1, by the columns given, or by place in the files it is read from."""
    at = unused(df, "_at")
    if order:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = materialise(df.withColumn(at, F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright(at, _PLACES), F.col(at).bitwiseAND(F.lit((1 << _PLACES) - 1))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return rows.join(starts, part == F.col("_p")).withColumn(name, (F.col("_s") + place).cast("bigint")).drop(at, "_p", "_n", "_s")
