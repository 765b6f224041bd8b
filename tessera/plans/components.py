"""Connected components by alternating large-star and small-star rounds.

Every round keeps the components and moves edges towards the smallest id, so
the number of rounds grows with the logarithm of the longest path.  A round is
two grouped minima (combined before the shuffle) and two equi-joins; a node
with very many neighbours is split by the adaptive skew join, never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import materialise


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    near = large.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node that has an edge to another node; component is the smallest id reachable.

    Loops, repeated and reversed edges are allowed; edges with a null end are left out.
    No edges give an empty table.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialise(now, "edges")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen, now = mark, materialise(_stars(now), "edges", instead_of=(now,))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
