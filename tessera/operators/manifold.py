"""A plane that keeps neighbourhoods: fuzzy nearest-neighbour graph and layout by attraction and sampled repulsion.

1. Exact nearest neighbours in feature space, block against block in numpy; blocks are rows of a hash, and a pair
   of blocks is one task.
2. Each point's bandwidth is found by bisection, so that the weights exp(-(d - nearest) / bandwidth) of its k
   neighbours add up to log2(k).
3. Weights of both directions join to p + q - p * q.
4. Points start on their two principal components.  In each round neighbours draw a point towards them, weighed, and
   ``repelled`` points drawn by a hash push it off; all points move at once, by the mean of either, ever less.

Nothing but edges and positions is kept, in tables that rounds write; no task holds more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import clip, dbl
from tessera.plans.numbering import number_rows
from tessera.plans.workspace import discard, materialise

from . import models

BLOCK = 4096
HALVINGS = 48


def feature_knn(features: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(src, dst, d, rk): the k nearest other points by features (id, f), ties by id; f of one length, ids distinct."""
    rows = materialise(features.select("id", F.transform("f", lambda v: v.cast("double")).alias("f")), "features")
    blocks = max(1, -(-rows.count() // block))
    side = lambda n: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias(n)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(n)
    asked = rows.select(F.col("id").alias("id"), F.col("f").alias("f"), side("p"), every("q"))
    held = rows.select("id", "f", every("p"), side("q"))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("d", pa.float64())])
        if not len(a) or not len(b):
            return schema.empty_table()
        x, y = (t.column("f").combine_chunks().flatten().to_numpy().reshape(len(t), -1) for t in (a, b))
        i, j = (t.column("id").to_numpy() for t in (a, b))
        order = np.argsort(j)
        y, j = y[order], j[order]
        out = []
        for at in range(0, len(x), 256):
            d2 = np.maximum((x[at : at + 256] ** 2).sum(1)[:, None] + (y**2).sum(1) - 2 * x[at : at + 256] @ y.T, 0)
            d2[i[at : at + 256, None] == j[None, :]] = np.inf
            best = np.argsort(d2, axis=1, kind="stable")[:, : min(k, len(j))]
            r = np.repeat(np.arange(len(best)), best.shape[1])
            d = np.sqrt(((x[at + r] - y[best.ravel()]) ** 2).sum(1))
            fine = np.isfinite(np.take_along_axis(d2, best, 1).ravel())
            out.append((i[at + r][fine], j[best.ravel()][fine], d[fine]))
        return pa.Table.from_arrays([pa.array(np.concatenate([o[n] for o in out])) for n in range(3)], schema=schema)

    near = asked.groupBy("p", "q").cogroup(held.groupBy("p", "q")).applyInArrow(tile, "src bigint, dst bigint, d double")
    over = Window.partitionBy("src").orderBy("d", "dst")
    return near.withColumn("rk", F.row_number().over(over)).where(F.col("rk") <= k)


def fuzzy_graph(near: DataFrame, k: int) -> DataFrame:
    """(u, v, w), u < v: from directed neighbours (src, dst, d); w in 0..1."""
    own = near.groupBy("src").agg(F.collect_list("d").alias("ds"), F.min(F.when(F.col("d") > 0, F.col("d"))).alias("first"))
    off = F.transform("ds", lambda d: F.greatest(d - F.coalesce("first", dbl(0)), dbl(0)))
    start = F.struct(dbl(0).alias("lo"), dbl(float("inf")).alias("hi"), dbl(1).alias("mid"))

    def halve(s, _):
        total = F.aggregate("off", dbl(0), lambda a, o: a + F.exp(-o / s["mid"]))
        high = total > dbl(np.log2(k))
        lo, hi = F.when(high, s["lo"]).otherwise(s["mid"]), F.when(high, s["mid"]).otherwise(s["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.when(hi == float("inf"), s["mid"] * 2).otherwise((lo + hi) / 2).alias("mid"))

    found = own.withColumn("off", off).withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve))
    mean = F.aggregate("ds", dbl(0), lambda a, d: a + d) / F.size("ds")
    wide = found.select(F.col("src").alias("_s"), F.coalesce("first", dbl(0)).alias("first"), F.greatest(F.col("s.mid"), dbl(1e-3) * mean, dbl(1e-12)).alias("band"))
    weighed = near.join(wide, F.col("src") == F.col("_s")).select("src", "dst", F.exp(-F.greatest(F.col("d") - F.col("first"), dbl(0)) / F.col("band")).alias("w"))
    both = weighed.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum("w").alias("s"), F.product("w").alias("p"), F.count("*").alias("n"))
    return both.select("u", "v", F.when(F.col("n") > 1, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("w"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a * d**(2 b)), fitted to 1 up to min_dist and exp(-(d - min_dist) / spread) beyond."""
    x = np.linspace(1e-3, 3 * spread, 300)
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b = 1.0, 1.0
    for _ in range(100):  # Gauss-Newton
        p = x ** (2 * b)
        f = 1 / (1 + a * p)
        jac = np.stack([-(f**2) * p, -(f**2) * a * p * 2 * np.log(x)], 1)
        step = np.linalg.lstsq(jac, y - f, rcond=None)[0]
        a, b = max(a + step[0], 1e-3), max(b + step[1], 1e-2)
    return float(a), float(b)


def layout(edges: DataFrame, start: DataFrame, a: float, b: float, rounds: int = 30, repelled: int = 20, rate: float = 2.5, speed: float = 0.5, seed: int = 0) -> DataFrame:
    """(id, x, y): positions after all rounds, from (id, x, y); edges (u, v, w).  rate: what repulsion weighs beside attraction; speed: of the first round."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("u")))
    both = materialise(both, "layout-edges")
    now = materialise(number_rows(start.select("id", "x", "y"), "n", ["id"]), "layout")
    n = now.count()
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    d2 = dx * dx + dy * dy
    power = F.pow(F.greatest(d2, dbl(1e-12)), dbl(b))
    draw = dbl(-2 * a * b) * power / F.greatest(d2, dbl(1e-12)) / (dbl(1) + dbl(a) * power)
    push = dbl(2 * b) / ((dbl(1e-3) + d2) * (dbl(1) + dbl(a) * power))
    for turn in range(rounds):
        here, there = now.select(F.col("id").alias("u"), "x", "y"), now.select(F.col("id").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        towards = both.join(here, "u").join(there, "v").select(F.col("u").alias("i"), (F.col("w") * clip(draw * dx, -4, 4)).alias("fx"), (F.col("w") * clip(draw * dy, -4, 4)).alias("fy"))
        picks = now.select("id", "n", "x", "y", F.explode(F.sequence(F.lit(1), F.lit(repelled))).alias("j")).withColumn("m", F.pmod(F.xxhash64("n", "j", F.lit(turn), F.lit(seed)), F.lit(max(n, 1))))
        away = picks.where("m <> n").join(now.select(F.col("n").alias("m"), F.col("x").alias("x2"), F.col("y").alias("y2")), "m")
        away = away.select(F.col("id").alias("i"), (clip(push * dx, -4, 4) * dbl(rate / repelled)).alias("fx"), (clip(push * dy, -4, 4) * dbl(rate / repelled)).alias("fy"))
        step = towards.unionByName(away).groupBy("i").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        size = dbl(speed * (1 - turn / rounds))
        moved = now.join(step, F.col("id") == F.col("i"), "left").select("id", (F.col("x") + size * F.coalesce("fx", dbl(0))).alias("x"), (F.col("y") + size * F.coalesce("fy", dbl(0))).alias("y"), "n")
        now = materialise(moved, "layout", instead_of=(now,))
    discard(both)
    return now.select("id", "x", "y")


def embed(features: DataFrame, k: int = 15, min_dist: float = 0.1, components: int = 50, rounds: int = 30, seed: int = 0) -> DataFrame:
    """(id, x, y) of features (id, f): up to ``components`` principal components of standardised features, then a plane that keeps neighbours.

    Features need two positions that vary at least; the same rows give the same plane, but for the order of floating-point sums.
    """
    width = features.select(F.max(F.size("f"))).first()[0] or 0
    rows = materialise(models.principal_components(features, min(components, width)), "components")
    edges = materialise(fuzzy_graph(feature_knn(rows, k), k), "fuzzy")
    first = rows.select("id", F.col("f")[0].alias("x"), F.col("f")[1].alias("y"))
    most = first.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 1.0
    start = first.select("id", (F.col("x") * dbl(10 / most)).alias("x"), (F.col("y") * dbl(10 / most)).alias("y"))
    return layout(edges, start, *curve(min_dist), rounds=rounds, seed=seed)


def preserved(near: DataFrame, plane_near: DataFrame) -> float:
    """The share of neighbours (src, dst) that are still neighbours in the plane."""
    kept = near.select("src", "dst").join(plane_near.select("src", "dst"), ["src", "dst"], "left_semi").count()
    return kept / max(near.count(), 1)
