"""Tumour zones, label smoothing, micro-niche naming and denoising."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import dbl
from tessera.plans.components import components
from tessera.plans.workspace import materialise

from . import spatial, stats


def cluster_vote(labels: DataFrame, mask: DataFrame, threshold: float, bright: float = 200) -> DataFrame:
    """(cluster, share, label): 2 (tumour) where the mean of mask > bright reaches the threshold, else 1.

    labels: (id, cluster, x, y) on pixels; mask: (x, y, v); pixels that aren't there are dark.
    """
    lit = mask.select("x", "y", (F.col("v") > bright).cast("double").alias("m"))
    share = labels.join(lit, ["x", "y"], "left").groupBy("cluster").agg(F.avg(F.coalesce("m", dbl(0))).alias("share"))
    return share.withColumn("label", F.when(F.col("share") >= threshold, 2).otherwise(1))


def neighbour_mix(points: DataFrame, label: str, radius: float) -> DataFrame:
    """(id, mix): the share of neighbours within the radius that have another label; 0 without neighbours."""
    tag = points.select("id", F.col(label).alias("z"))
    pairs = spatial.radius_pairs(points, radius).join(tag.select(F.col("id").alias("src"), F.col("z").alias("a")), "src").join(tag.select(F.col("id").alias("dst"), F.col("z").alias("b")), "dst")
    mix = pairs.groupBy("src").agg(F.avg((F.col("a") != F.col("b")).cast("double")).alias("mix"))
    return points.select("id").join(mix, F.col("id") == F.col("src"), "left").select("id", F.coalesce("mix", dbl(0)).alias("mix"))


def islands(points: DataFrame, keep: DataFrame, radius: float) -> DataFrame:
    """(id, island): components of the radius graph among the points of ``keep`` (id)."""
    own = points.join(keep, "id", "left_semi")
    found = components(spatial.radius_pairs(own, radius), "src", "dst").withColumnRenamed("id", "_id")
    return own.select("id").join(found, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("component", "id").alias("island"))


def zoning(points: DataFrame, label: str = "label12", alpha: float = 2.2, min_island: int = 20, high: float = 0.2, low: float = 0.08) -> DataFrame:
    """(id, zone, mix, opp): tumour_core, tumour_edge, stroma_transit or stroma_interior.

    Core: little mixing and far from the other class; of an island under
    min_island spots only the one farthest from it; of one without any, its
    farthest fifth.  Transit: much mixing, or near the tumour.  A null threshold
    is never met.
    """
    h = spatial.spacing(points)
    own = points.select("id", "x", "y", F.when(F.col(label) == 2, 0).otherwise(1).alias("z"))
    mix, opp = neighbour_mix(own, "z", alpha * h), spatial.opposite_nearest(own, "z").withColumnRenamed("d", "opp")
    rows = materialise(own.select("id", "z").join(mix, "id").join(opp, "id"), "zones")
    cuts = stats.two_means(rows, "mix", "z").withColumnRenamed("t", "t_mix").join(stats.two_means(rows, "opp", "z").withColumnRenamed("t", "t_opp"), "z", "full")
    rows = rows.join(F.broadcast(cuts), "z", "left")
    tumour = rows.where("z = 0").join(islands(own, rows.where("z = 0").select("id"), alpha * h), "id")
    tumour = tumour.withColumn("base", F.coalesce((F.col("mix") <= F.col("t_mix")) & (F.col("opp") >= F.col("t_opp")), F.lit(False)))
    each = Window.partitionBy("island")
    tumour = tumour.withColumn("n", F.count("*").over(each)).withColumn("any", F.max("base").over(each)).withColumn("rk", F.row_number().over(each.orderBy(F.desc("opp"), "id")))
    core = F.when(F.col("n") < min_island, F.col("rk") == 1).when(F.col("any"), F.col("base")).otherwise(F.col("rk") <= F.greatest(F.lit(1), F.ceil(F.col("n") * dbl(high)), F.ceil(F.col("n") * dbl(low))))
    inner = tumour.select("id", F.when(core, "tumour_core").otherwise("tumour_edge").alias("zone"), "mix", "opp")
    near = F.coalesce(F.col("mix") >= F.col("t_mix"), F.lit(False)) | F.coalesce(F.col("opp") <= F.col("t_opp"), F.lit(False))
    outer = rows.where("z = 1").select("id", F.when(near, "stroma_transit").otherwise("stroma_interior").alias("zone"), "mix", "opp")
    return inner.unionByName(outer)


def one_hot(rows: DataFrame, col: str, values: list) -> DataFrame:
    return rows.select("*", *((F.col(col) == v).cast("int").alias(f"{col}_{v}") for v in values))


def smooth_once(labels: DataFrame, near: DataFrame, min_frac: float) -> DataFrame:
    """(id, label, flipped): the commonest label among the neighbours (the smallest of ties) if its share is enough."""
    votes = near.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("c"))
    best = votes.groupBy("src").agg(F.max_by("label", F.struct(F.col("c"), -F.col("label"))).alias("top"), (F.max("c") / F.sum("c")).alias("share"))
    joined = labels.join(best, F.col("id") == F.col("src"), "left")
    flip = F.coalesce((F.col("share") >= min_frac) & (F.col("top") != F.col("label")), F.lit(False))
    return joined.select("id", F.when(flip, F.col("top")).otherwise(F.col("label")).alias("label"), flip.alias("flipped"))


def smooth(points: DataFrame, label: str, k: int, min_frac: float = 0.6, rounds: int = 5) -> DataFrame:
    """(id, label) after rounds of smoothing by neighbours 2 to k + 1, all at once, until nothing flips."""
    near = materialise(spatial.knn(points, k + 1).where("rk >= 2").select("src", "dst"), "smooth-near")
    now = points.select("id", F.col(label).alias("label"))
    for _ in range(rounds):
        got = materialise(smooth_once(now, near, min_frac), "smooth")
        now = got.select("id", "label")
        if not got.where("flipped").head(1):
            break
    return now


def majority_vote(points: DataFrame, macro: str, label: str, radius: float, k: int = 8, share: float = 0.7) -> DataFrame:
    """(id, label, changed): the commonest label of the k nearest of the same macro zone within the radius (of all k if none is).

    Ties go to the label met first, by distance; a label changes if the winner's share is enough.
    """
    own = points.select("id", "x", "y", F.col(macro).alias("macro"), F.col(label).alias("label"))
    near = spatial.nearest(own, own, k, ["macro"])
    within = Window.partitionBy("src")
    near = near.withColumn("_in", F.max((F.col("d") <= dbl(radius)).cast("int")).over(within)).where((F.col("_in") == 0) | (F.col("d") <= dbl(radius)))
    votes = near.drop("macro").join(own.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("c"), F.min("rk").alias("first"))
    best = votes.groupBy("src").agg(F.max_by("label", F.struct(F.col("c"), -F.col("first"))).alias("top"), (F.max("c") / F.sum("c")).alias("share"))
    joined = own.join(best, F.col("id") == F.col("src"), "left")
    change = F.coalesce((F.col("share") >= share) & (F.col("top") != F.col("label")), F.lit(False))
    return joined.select("id", F.when(change, F.col("top")).otherwise(F.col("label")).alias("label"), change.alias("changed"))


def same_label_parts(points: DataFrame, macro: str, label: str, radius: float, k: int = 8) -> DataFrame:
    """(id, part): components of the k-nearest graph within each macro zone and label, edges up to the radius."""
    own = points.select("id", "x", "y", F.col(macro).alias("macro"), F.col(label).alias("label"))
    edges = spatial.nearest(own, own, k, ["macro", "label"]).where(F.col("d") <= dbl(radius))
    found = components(edges, "src", "dst").withColumnRenamed("id", "_id")
    return own.select("id").join(found, F.col("id") == F.col("_id"), "left").select("id", F.coalesce("component", "id").alias("part"))


def clean_islands(points: DataFrame, macro: str, label: str, radius: float, least: int = 5) -> DataFrame:
    """(id, label): parts under ``least`` spots take the commonest other label around them (the smallest of ties), all at once."""
    own = points.select("id", "x", "y", F.col(macro).alias("macro"), F.col(label).alias("label"))
    parts = materialise(same_label_parts(points, macro, label, radius), "parts")
    small = parts.join(parts.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") < least), "part").select("id", "part")
    around = spatial.near_pairs(own.join(small, "id", "left_semi"), own, radius, ["macro"]).join(own.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(own.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").where("a <> b")
    votes = around.join(small.withColumnRenamed("id", "src"), "src").groupBy("part", "b").agg(F.count("*").alias("c"))
    best = votes.groupBy("part").agg(F.max_by("b", F.struct(F.col("c"), -F.col("b"))).alias("new"))
    moved = small.join(best, "part").select("id", "new")
    return own.select("id", "label").join(moved, "id", "left").select("id", F.coalesce("new", "label").alias("label"))


def denoise(points: DataFrame, macro: str, label: str, k: int = 8, reach: float = 2.2, share: float = 0.7, least: int = 5) -> DataFrame:
    """(id, label): a majority vote within macro zones, then small islands cleaned."""
    radius = reach * spatial.spacing(points)
    voted = materialise(majority_vote(points, macro, label, radius, k, share).select("id", "label"), "voted")
    rows = points.select("id", "x", "y", F.col(macro).alias("macro")).join(voted, "id")
    return clean_islands(rows, "macro", "label", radius, least)


def niche_ids(local: DataFrame, least: int = 10) -> DataFrame:
    """(id, micro_id, micro_name) from (id, macro, local, f): local communities under ``least`` spots merge into the nearest kept centroid.

    Ids count up over macro zones in order, then over the local communities kept; a zone with none kept is one niche.
    """
    sizes = local.groupBy("macro", "local").agg(F.count("*").alias("n"))
    most = Window.partitionBy("macro").orderBy(F.desc("n"), "local")
    kept = sizes.withColumn("rk", F.row_number().over(most)).where((F.col("n") >= least) | (F.col("rk") == 1)).select("macro", "local")
    long = local.select("macro", "local", F.posexplode("f").alias("pos", "v")).groupBy("macro", "local", "pos").agg(F.avg("v").alias("c"))
    small = sizes.join(kept, ["macro", "local"], "left_anti").select("macro", "local")
    a = long.join(small, ["macro", "local"], "left_semi").select("macro", F.col("local").alias("old"), "pos", F.col("c").alias("p"))
    b = long.join(kept, ["macro", "local"], "left_semi").select("macro", F.col("local").alias("new"), "pos", F.col("c").alias("q"))
    gap = a.join(b, ["macro", "pos"]).groupBy("macro", "old", "new").agg(F.sum(F.pow(F.col("p") - F.col("q"), dbl(2))).alias("g"))
    to = gap.groupBy("macro", "old").agg(F.min_by("new", F.struct("g", "new")).alias("new"))
    rows = local.select("id", "macro", "local").join(to.withColumnRenamed("old", "local"), ["macro", "local"], "left").select("id", "macro", F.coalesce("new", "local").alias("local"))
    ids = kept.withColumn("micro_id", F.dense_rank().over(Window.orderBy("macro", "local")) - 1)
    return rows.join(ids, ["macro", "local"]).select("id", "micro_id", F.concat_ws(":", "macro", F.col("local").cast("string")).alias("micro_name"))
