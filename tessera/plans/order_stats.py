"""Exact quantiles of a column of any size.

Up to SMALL rows are ranked as they are.  A larger column is cut down first: an
approximate quantile either side of the wanted rank brackets it, a count tells
how many rows lie below, and only the rows between go on; so no task ever sorts,
or holds the distinct values of, the whole column.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 1 << 20


def _at(rows: DataFrame, n: int, k: int, small: int) -> float:
    """The k-th smallest value (from 0) of a column v of n rows."""
    while n > small:
        share, room = k / n, 0.01
        a, b = rows.approxQuantile("v", [max(0.0, share - room), min(1.0, share + room)], room / 4)
        if a == b:
            low, same = rows.agg(F.count(F.when(F.col("v") < a, 1)), F.count(F.when(F.col("v") == a, 1))).first()
            if low <= k < low + same:
                return a
            rows, n, k = (rows.where(F.col("v") < a), low, k) if k < low else (rows.where(F.col("v") > a), n - low - same, k - low - same)
            continue
        low, mid = rows.agg(F.count(F.when(F.col("v") < a, 1)), F.count(F.when(F.col("v").between(a, b), 1))).first()
        if not low <= k < low + mid or mid == n:
            break
        rows, n, k = rows.where(F.col("v").between(a, b)), mid, k - low
    return rows.orderBy("v").offset(k).limit(1).first()[0]


def quantile(df: DataFrame, col: str, q: float, higher: bool = False, small: int = SMALL) -> float | None:
    """The q-quantile of the values that are numbers, interpolated between neighbours, or the higher neighbour; None of none."""
    rows = df.select(F.col(col).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n = rows.count()
    if not n:
        return None
    at = (n - 1) * q
    if higher:
        return _at(rows, n, ceil(at), small)
    if n <= small:
        return rows.agg(F.percentile("v", F.lit(float(q)))).first()[0]
    k, part = floor(at), at - floor(at)
    one = _at(rows, n, k, small)
    return one if not part else one + part * (_at(rows, n, k + 1, small) - one)
