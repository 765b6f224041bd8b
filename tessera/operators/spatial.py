"""Spatial joins: radius pairs, nearest neighbours, degree-bounded graphs, spacings.

Points are (id, x, y).  Radius joins are equi-joins on grid cells of the
radius, one side spread over the 3 x 3 cells around it; the distance is an
ordinary filter on the joined rows.  Ties in distance go by id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import dbl
from tessera.plans.numbering import number_rows
from tessera.plans.order_stats import quantile
from tessera.plans.workspace import materialise

SCHEMA = ["src", "dst", "d"]
#: Tables beyond this many points have their density looked at; a cell is crowded with so many times the points wanted.
MANY, CROWDED = 100_000, 32


def _cells(v: str, size: float) -> Column:
    return F.floor(F.col(v) / dbl(size)).cast("bigint")


def near_pairs(a: DataFrame, b: DataFrame, radius: float, keep: list[str] = (), strict: bool = True, spread_a: bool = False) -> DataFrame:
    """(src, dst, d) with d <= radius between points of two tables; ``keep``: columns that must be equal as well.

    strict: a point is no pair with itself (equal ids).  spread_a: spread the first table over the cells around, not the second; for when it is the smaller.
    """
    offsets = F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1))))
    left = a.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"), *keep, _cells("x", radius).alias("cx"), _cells("y", radius).alias("cy"))
    right = b.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), *keep, _cells("x", radius).alias("gx"), _cells("y", radius).alias("gy"))
    around = lambda t: t.withColumn("ox", offsets).withColumn("oy", offsets).withColumn("cx", F.col("gx") + F.col("ox")).withColumn("cy", F.col("gy") + F.col("oy")).drop("gx", "gy", "ox", "oy")
    if spread_a:
        left, right = around(left.withColumnsRenamed({"cx": "gx", "cy": "gy"})), right.withColumnsRenamed({"gx": "cx", "gy": "cy"})
    else:
        right = around(right)
    d = F.sqrt((F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")) + (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2")))
    rows = left.join(right, ["cx", "cy", *keep]).withColumn("d", d).where(F.col("d") <= dbl(radius))
    return (rows.where("src <> dst") if strict else rows).select("src", "dst", "d", *keep)


def radius_pairs(points: DataFrame, radius: float) -> DataFrame:
    """Directed pairs (src, dst, d) of different points within the radius."""
    return near_pairs(points, points, radius)


def _start(points: DataFrame, k: int) -> tuple[int, float, float]:
    """Number of points, a cell that holds about 3 k of them, and the extent."""
    n, x0, x1, y0, y1 = points.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not n:
        return 0, 1.0, 1.0
    w, h = max(x1 - x0, 0.0), max(y1 - y0, 0.0)
    extent = math.hypot(w, h) or 1.0
    area = w * h or extent
    cell = min(extent, math.sqrt(area * (k + 1) / n)) or 1.0
    if n > MANY:  # points in clumps: start from a cell that the densest one fills; sparse places take more rounds
        for _ in range(8):
            most = points.groupBy(_cells("x", cell), _cells("y", cell)).count().agg(F.max("count")).first()[0]
            if most <= CROWDED * (k + 1):
                break
            cell *= math.sqrt(2 * (k + 1) / most)
    return n, cell, extent


def nearest(queries: DataFrame, points: DataFrame, k: int, keep: list[str] = (), strict: bool = True, rule: Column | None = None) -> DataFrame:
    """(src, dst, d, rk, keep): the k nearest points of each query, rk from 1.

    The grid's cell doubles until every query is certain: it has k candidates
    within the cell's size, or the cell spans everything.  Only queries that are
    not certain yet go on.  All rounds are written, so the result reads nothing but tables.  rule: a condition on ids (src, dst) beside distance.
    """
    n, cell, extent = _start(points, k)
    over = Window.partitionBy("src").orderBy("d", "dst")
    done, left, open_ = None, queries, None
    while True:
        pairs = near_pairs(left, points, cell, keep, strict, spread_a=done is not None)  # of later rounds, few queries are spread rather than all points
        pairs = pairs.where(rule) if rule is not None else pairs
        ranked = pairs.withColumn("rk", F.row_number().over(over)).where(F.col("rk") <= k).select("src", "dst", "d", "rk", *keep)
        if cell > extent or not n:
            ranked = materialise(ranked, "nearest")
            return ranked if done is None else done.unionByName(ranked)
        ranked = materialise(ranked.withColumn("_n", F.max("rk").over(Window.partitionBy("src"))), "nearest")  # told while a query's rows are together
        sure = ranked.where(F.col("rk") == k).select("src")
        open_ = (queries.count() if open_ is None else open_) - sure.count()
        if not open_:  # all of this round's queries are certain
            return ranked.drop("_n") if done is None else done.unionByName(ranked.drop("_n"))
        full = ranked.where(F.col("_n") == k).drop("_n")
        done = full if done is None else done.unionByName(full)
        left = left.join(sure, left["id"] == sure["src"], "left_anti")
        cell *= 2.0


def knn(points: DataFrame, k: int) -> DataFrame:
    """(src, dst, d, rk): the k nearest other points of each."""
    return nearest(points, points, k)


def median_nn(points: DataFrame) -> DataFrame:
    """One row, h: the median distance to the nearest other point."""
    return points.sparkSession.createDataFrame([(quantile(knn(points, 1), "d", 0.5),)], "h double")


def spacing(points: DataFrame) -> float:
    return quantile(knn(points, 1), "d", 0.5) or 0.0


def knn_mean(points: DataFrame, k: int) -> DataFrame:
    """One row, mean_d: over all points and their k nearest."""
    return knn(points, k).agg(F.avg("d").alias("mean_d"))


def least_spacing(points: DataFrame) -> DataFrame:
    return knn(points, 1).agg(F.min("d").alias("h"))


def class_spacing(points: DataFrame, label: str) -> DataFrame:
    """(label, h): the median nearest distance within each class of two points or more."""
    own = points.select("id", "x", "y", F.col(label).alias("label"))
    big = own.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    own = own.join(big, "label", "left_semi")
    return nearest(own, own, 1, ["label"]).groupBy("label").agg(F.expr("percentile(d, 0.5)").alias("h"))


def pooled_knn(points: DataFrame, low: int = 8, high: int = 12) -> DataFrame:
    """(d): distances to the low-th up to the high-th neighbour, of all points together."""
    return knn(points, high).where(F.col("rk") >= low).select("d")


def knee(distances: DataFrame, h: float, low: float = 1.2, high: float = 3.5) -> DataFrame:
    """One row, alpha: where the sorted distances over h bend most away from their chord; null if out of range or under 10 rows."""
    r = number_rows(distances.select((F.col("d") / dbl(h)).alias("r")), "rn", ["r"]).withColumn("rn", F.col("rn") + 1)
    at = r.join(F.broadcast(r.agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"))))
    x = (F.col("rn") - 1) / F.greatest(F.col("n") - 1, F.lit(1)).cast("double")
    y = (F.col("r") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), dbl(1e-12))
    best = at.withColumn("off", F.abs(y - x)).agg(F.max_by("r", F.struct(F.col("off"), -F.col("rn"))).alias("r"), F.max("n").alias("n"))
    return best.select(F.when((F.col("n") >= 10) & F.col("r").between(low, high), F.col("r")).alias("alpha"))


def opposite_nearest(points: DataFrame, label: str) -> DataFrame:
    """(id, d): distance to the nearest point of another label; infinity if there is none."""
    own = points.select("id", "x", "y", F.col(label).alias("label"))
    if own.select("label").distinct().limit(2).count() < 2:
        return own.select("id", F.lit(float("inf")).alias("d"))
    n, cell, extent = _start(own, 4)
    left, done = own, None
    tag = own.select(F.col("id").alias("dst"), F.col("label").alias("other"))
    while True:
        pairs = near_pairs(left, own, cell).join(left.select(F.col("id").alias("src"), "label"), "src").join(tag, "dst").where("label <> other")
        got = materialise(pairs.groupBy("src").agg(F.min("d").alias("d")), "opposite")
        done = got if done is None else done.unionByName(got)
        left = materialise(left.join(got, left["id"] == got["src"], "left_anti"), "queries")
        if cell > extent or not left.head(1):
            return own.select("id").join(done, F.col("id") == F.col("src"), "left").select("id", F.coalesce("d", F.lit(float("inf"))).alias("d"))
        cell *= 2.0


def bounded_graph(points: DataFrame, h: float, r_rel: float = 2.2, deg_min: int = 10, deg_max: int = 18, r_max_rel: float | None = None) -> DataFrame:
    """(src, dst, d): neighbours within r_rel * h, at least deg_min, at most deg_max, none beyond r_max_rel * h."""
    return _bounded(knn(points, deg_max), h, r_rel, deg_min, r_max_rel)


def _bounded(near: DataFrame, h: float, r_rel: float, deg_min: int, r_max_rel: float | None) -> DataFrame:
    rows = near.where((F.col("d") <= dbl(r_rel * h)) | (F.col("rk") <= deg_min))
    return (rows.where(F.col("d") <= dbl(r_max_rel * h)) if r_max_rel else rows).select(*SCHEMA)


def graph_and_spacing(points: DataFrame, r_rel: float = 2.2, deg_min: int = 10, deg_max: int = 18, r_max_rel: float | None = None) -> tuple[DataFrame, float]:
    """The degree-bounded graph and the spacing it goes by, from one search."""
    return graph_of(knn(points, deg_max), r_rel, deg_min, r_max_rel)


def graph_of(near: DataFrame, r_rel: float = 2.2, deg_min: int = 10, r_max_rel: float | None = None) -> tuple[DataFrame, float]:
    """The same from neighbours already searched for (``knn``); deg_max is how many they are."""
    h = quantile(near.where("rk = 1"), "d", 0.5) or 0.0
    return _bounded(near, h, r_rel, deg_min, r_max_rel), h


def cap_degree(edges: DataFrame, deg_max: int) -> DataFrame:
    """Each source keeps its deg_max nearest targets."""
    over = Window.partitionBy("src").orderBy("d", "dst")
    return edges.withColumn("_rk", F.row_number().over(over)).where(F.col("_rk") <= deg_max).drop("_rk")


def within_or_all(edges: DataFrame, radius: float) -> DataFrame:
    """Edges within the radius; all edges if there are none such."""
    near = F.broadcast(edges.agg(F.coalesce(F.max((F.col("d") <= dbl(radius)).cast("int")), F.lit(0)).alias("_any")))
    return edges.join(near).where((F.col("_any") == 0) | (F.col("d") <= dbl(radius))).drop("_any")


def edge_distances(points: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with their length d."""
    a = points.select(F.col("id").alias("src"), F.col("x").alias("_x1"), F.col("y").alias("_y1"))
    b = points.select(F.col("id").alias("dst"), F.col("x").alias("_x2"), F.col("y").alias("_y2"))
    return edges.join(a, "src").join(b, "dst").withColumn("d", F.hypot(F.col("_x1") - F.col("_x2"), F.col("_y1") - F.col("_y2"))).drop("_x1", "_y1", "_x2", "_y2")


def sorted_spacing(points: DataFrame, default: float = 10.0) -> DataFrame:
    """One row, h: the median of the positive gaps between sorted coordinates of either axis."""
    axes = points.select(F.lit("x").alias("axis"), F.col("x").alias("v")).unionByName(points.select(F.lit("y").alias("axis"), F.col("y").alias("v"))).distinct()
    gap = F.col("v") - F.lag("v").over(Window.partitionBy("axis").orderBy("v"))
    return axes.withColumn("gap", gap).where("gap > 0").agg(F.coalesce(F.expr("percentile(gap, 0.5)"), dbl(default)).alias("h"))


def nearest_same_x(labels: DataFrame, points: DataFrame) -> DataFrame:
    """labels (x, y, ...) with ``y_near``: the y among points (ord, x, y) of the same x nearest to theirs, the first row of ties.

    Distinct places of either table are sorted together along each column, and a place takes the nearer of the last point
    below and the first above; labels and points of a column never meet pair by pair.  A y that is no number has no nearest
    one and is none.
    """
    number = F.col("y").isNotNull() & ~F.isnan("y")
    p = points.where(number).groupBy(F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.min("ord").alias("_o"))
    asked = labels.where(number).select(F.col("x").alias("_x"), F.col("y").alias("_y")).distinct()
    rows = p.withColumn("_p", F.struct("_o", "_y")).drop("_o").withColumn("_a", F.lit(0)).unionByName(asked.withColumn("_a", F.lit(1)), allowMissingColumns=True)
    running = lambda *order: F.last("_p", ignorenulls=True).over(Window.partitionBy("_x").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_low", running("_y", "_a")).withColumn("_up", running(F.desc("_y"), "_a")).where("_a = 1")
    off = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("_y") - F.col(f"{c}._y")).alias("d"), F.col(f"{c}._o").alias("o"), F.col(f"{c}._y").alias("y")))
    best = rows.select("_x", "_y", F.least(off("_low"), off("_up"))["y"].alias("y_near"))
    return labels.join(best, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left").drop("_x", "_y")


def realign(labels: DataFrame, points: DataFrame, scale: float = 1.154) -> DataFrame:
    """barcode and label (one less) of labels whose y is divided by the scale and moved to the nearest point of the same x."""
    moved = nearest_same_x(labels.withColumn("y", F.col("y") / dbl(scale)), points)
    p = points.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "barcode")
    return moved.join(p, (F.col("x") == F.col("_x")) & (F.col("y_near") == F.col("_y"))).select("barcode", (F.col("label") - 1).alias("label"))
