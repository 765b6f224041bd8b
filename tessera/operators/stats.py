"""Rank tests, false discovery rates, markers, agreement of partitions, exact 1-D two-means."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import dbl
from tessera.plans.numbering import number_rows


def bh(rows: DataFrame, p: str, group: list[str] = (), block: int = 1 << 16) -> DataFrame:
    """rows with padj: the least of n / rank * p from this rank up, at most 1; within groups if there are any.

    Ranks and the least values are taken in blocks, so that no task sees all rows, nor a whole group; the least value
    so far runs from the last rank down, since a frame that ends at the last row is gone through again for each row.
    """
    own = number_rows(rows, "_rk", [*group, p]).withColumn("_b", F.floor(F.col("_rk") / block))
    keys = [f"_g{k}" for k in range(len(group))]
    same = lambda: [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys, strict=True)]
    sizes = own.groupBy(*(F.col(g).alias(k) for g, k in zip(group, keys, strict=True))).agg(F.count("*").alias("_n"), F.min("_rk").alias("_s"))
    own = (own.join(sizes, same()) if group else own.crossJoin(F.broadcast(sizes))).drop(*keys)
    own = own.withColumn("_q", F.col(p) * F.col("_n") / (F.col("_rk") - F.col("_s") + 1))
    later = Window.partitionBy(*keys).orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)
    after = own.groupBy(*(F.col(g).alias(k) for g, k in zip(group, keys, strict=True)), F.col("_b").alias("_c")).agg(F.min("_q").alias("_m")).withColumn("_m", F.min("_m").over(later))
    down = Window.partitionBy("_b", *group).orderBy(F.desc("_rk")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = own.withColumn("_own", F.min("_q").over(down)).join(after, [F.col("_b") == F.col("_c"), *same()])
    return met.withColumn("padj", F.least("_own", F.coalesce("_m", dbl(1)), dbl(1))).select(*rows.columns, "padj")


def mann_whitney(expr: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, gene, u, z, log2fc): each cluster against the rest, over all labelled spots; absent values are 0.

    Ranks are averaged over ties without a row for the zeros: all of a gene's
    zeros are one tie.  z has the tie and continuity corrections.
    """
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n1"))
    n = F.broadcast(labels.agg(F.count("*").alias("n")))
    own = expr.where("value <> 0").join(labels, "spot_id").groupBy("gene", "cluster", "value").agg(F.count("*").alias("c"))
    genes = own.select("gene").distinct()
    held = own.groupBy("gene", "cluster").agg(F.sum("c").alias("c"))
    grid = genes.join(F.broadcast(sizes)).join(held, ["gene", "cluster"], "left")
    zeros = grid.select("gene", "cluster", dbl(0).alias("value"), (F.col("n1") - F.coalesce("c", F.lit(0))).alias("c"))
    full = own.unionByName(zeros)
    ties = full.groupBy("gene", "value").agg(F.sum("c").alias("t"))
    before = Window.partitionBy("gene").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranks = ties.withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / dbl(2))
    tie = ties.groupBy("gene").agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("tie"))
    r = full.join(ranks.drop("t"), ["gene", "value"]).groupBy("gene", "cluster").agg(F.sum(F.col("c") * F.col("rank")).alias("r1"), F.sum(F.col("c") * F.col("value")).alias("s1"))
    every = r.join(F.broadcast(sizes), "cluster").join(n).join(tie, "gene").join(full.groupBy("gene").agg(F.sum(F.col("c") * F.col("value")).alias("s")), "gene")
    n1, n2 = F.col("n1").cast("double"), (F.col("n") - F.col("n1")).cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((F.col("n") + 1) - F.col("tie") / (F.col("n").cast("double") * (F.col("n") - 1))))
    off = F.abs(u - n1 * n2 / 2) - dbl(0.5)
    z = F.when(spread > 0, F.greatest(off, dbl(-0.5)) / spread).otherwise(dbl(0))
    fold = F.log2((F.col("s1") / n1 + dbl(1e-9)) / ((F.col("s") - F.col("s1")) / n2 + dbl(1e-9)))
    return every.where("n > n1").select("cluster", "gene", u.alias("u"), z.alias("z"), fold.alias("log2fc"))


def two_sided(tests: DataFrame) -> DataFrame:
    """tests with p, twice the normal tail beyond z (1 below 0)."""
    return tests.withColumn("p", F.least(erfc(F.greatest(F.col("z"), dbl(0)) / dbl(sqrt(2))), dbl(1)))


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0: its series up to 2.5, its continued fraction beyond; good to ten digits."""
    square, term, total = x * x, x, x
    for n in range(1, 40):
        term = -term * square / n
        total = total + term / (2 * n + 1)
    tail = x
    for n in range(60, 0, -1):
        tail = x + dbl(n / 2) / tail
    return F.when(x < 2.5, dbl(1) - dbl(2 / sqrt(pi)) * total).otherwise(F.exp(-square) / (dbl(sqrt(pi)) * tail))


def differential(expr: DataFrame, labels: DataFrame) -> DataFrame:
    """Tests of each cluster against the rest with p and, within the cluster, padj."""
    return bh(two_sided(mann_whitney(expr, labels)), "p", ["cluster"])


def markers(tests: DataFrame, sizes: DataFrame, least: int = 10, per_cluster: int = 50, padj: float = 0.05, final: int = 200) -> DataFrame:
    """(gene, log2fc, padj, cluster, rk): each gene once, by its best cluster; clusters under ``least`` spots are left out."""
    own = tests.join(F.broadcast(sizes.where(F.col("n") >= least).select("cluster")), "cluster", "left_semi").where(F.col("padj") < padj)
    over = Window.partitionBy("cluster").orderBy(F.desc("log2fc"), "padj", "gene")
    top = own.withColumn("_rk", F.row_number().over(over)).where(F.col("_rk") <= per_cluster)
    best = top.groupBy("gene").agg(F.max("log2fc").alias("log2fc"), F.min("padj").alias("padj"), F.max_by("cluster", F.struct("log2fc", "cluster")).alias("cluster"))
    rank = F.row_number().over(Window.orderBy("padj", F.desc("log2fc"), "gene"))
    return best.orderBy("padj", F.desc("log2fc"), "gene").limit(final).withColumn("rk", rank)


def ari(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row, ari: the adjusted Rand index of two labels; 1 if both have a single class or all single rows."""
    two = lambda c: c * (c - 1) / dbl(2)
    cells = rows.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    both = cells.agg(F.sum(two(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    one = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("i"))
    other = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("j"))
    x = both.join(F.broadcast(one)).join(F.broadcast(other))
    expected = F.col("i") * F.col("j") / two(F.col("n"))
    most = (F.col("i") + F.col("j")) / 2
    return x.select(F.when((two(F.col("n")) == 0) | (most == expected), dbl(1)).otherwise((F.col("ij") - expected) / (most - expected)).alias("ari"))


def two_means(rows: DataFrame, col: str, group: str | None = None) -> DataFrame:
    """(group, t): midpoint of the two centres that split the finite values with the least squared error.

    Exact, by prefix sums over distinct values; under two values, or all alike, the median; none, null.
    """
    key = group or "_g"
    own = rows.select(F.col(group).alias(key) if group else F.lit(0).alias(key), F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs(F.col("v")) < float("inf")))
    d = own.groupBy(key, "v").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(key).orderBy("v")
    every = Window.partitionBy(key)
    s = d.select(key, "v", F.sum("c").over(upto).alias("n1"), F.sum(F.col("c") * F.col("v")).over(upto).alias("s1"), F.sum("c").over(every).alias("n"), F.sum(F.col("c") * F.col("v")).over(every).alias("s"))
    n2 = F.col("n") - F.col("n1")
    m1, m2 = F.col("s1") / F.col("n1"), (F.col("s") - F.col("s1")) / n2
    between = F.col("n1") * m1 * m1 + n2 * m2 * m2
    best = s.where(n2 > 0).groupBy(key).agg(F.max_by((m1 + m2) / 2, F.struct(between, -F.col("v"))).alias("t"))
    mid = own.groupBy(key).agg(F.expr("percentile(v, 0.5)").alias("mid"))
    out = mid.join(best, key, "left").select(key, F.coalesce("t", "mid").alias("t"))
    return out if group else out.drop(key)
