"""Model input and losses: score cubes, top-k masks, message passing, clustering targets, features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import clip, dbl
from tessera.plans.workspace import materialise


def ccc_prep(scores: DataFrame, n_spots: int, q: float = 0.95, most: int | None = None) -> DataFrame:
    """(src, dst, pair_id, w): off the diagonal, positive, over the pair's quantile with absent cells as 0, clipped to 0..1.

    The quantile over all n^2 cells is read off the sorted positive ones, as if
    the zeros stood before them.  A pair with fewer positive ones than lie above
    the quantile has a quantile of 0, so only the others are sorted.  most: rows
    that no pair has more of, if that is known (edges, say): if those are too few,
    scores are read once and neither written nor sorted.
    """
    clean = lambda t: t.where("src <> dst").select("src", "dst", "pair_id", F.greatest(F.when(F.isnan("s") | (F.abs("s") == float("inf")), dbl(0)).otherwise(F.coalesce("s", dbl(0))), dbl(0)).alias("s"))
    cells = n_spots * n_spots
    at = q * (cells - 1)
    low, part = int(at), at - int(at)
    if most is not None and most < cells - low - 1:
        return clean(scores).select("src", "dst", "pair_id", clip(F.col("s") / dbl(1e-8), 0, 1).alias("w"))
    own = clean(scores if hasattr(scores, "_tessera_path") else materialise(scores, "scores"))
    pos = own.where("s > 0")
    many = materialise(pos.groupBy("pair_id").agg(F.count("*").alias("n")).where(F.col("n") >= cells - low - 1).select("pair_id"), "many")
    down = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("s")))
    ranked = pos.join(F.broadcast(many), "pair_id", "left_semi").withColumn("rk", dbl(cells) - down)  # 0-based rank from below among all cells
    ends = ranked.groupBy("pair_id").agg(F.max(F.when(F.col("rk") == low, F.col("s"))).alias("a"), F.max(F.when(F.col("rk") == low + 1, F.col("s"))).alias("b"))
    cut = ends.select("pair_id", (F.coalesce("a", dbl(0)) * (1 - part) + F.coalesce("b", dbl(0)) * part).alias("cut"))
    return own.join(F.broadcast(cut), "pair_id", "left").select("src", "dst", "pair_id", clip(F.col("s") / F.greatest(F.coalesce("cut", dbl(0)), dbl(1e-8)), 0, 1).alias("w"))


def topk_mask(weights: DataFrame, k: int) -> DataFrame:
    """(src, dst, w): the k heaviest cells of each row; the diagonal may take a place and then goes."""
    over = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    return weights.withColumn("_rk", F.row_number().over(over)).where((F.col("_rk") <= k) & (F.col("src") != F.col("dst"))).drop("_rk")


def message_passing(ccc: DataFrame, features: DataFrame, logits: dict[int, float]) -> DataFrame:
    """(spot_id, pos, z): sum over j of the softmax-weighted mean of the pairs' scores times x_j.  features: (spot_id, pos, v)."""
    spark = ccc.sparkSession
    rows = spark.createDataFrame([(int(p), float(v)) for p, v in logits.items()], "pair_id bigint, l double")
    top = rows.agg(F.max("l")).first()[0]
    soft = rows.withColumn("e", F.exp(F.col("l") - dbl(top)))
    total = soft.agg(F.sum("e")).first()[0]
    s = ccc.join(F.broadcast(soft), "pair_id").groupBy("src", "dst").agg(F.sum(F.col("e") / dbl(total) * F.col("w")).alias("s"))
    return s.join(features.withColumnRenamed("spot_id", "dst"), "dst").groupBy(F.col("src").alias("spot_id"), "pos").agg(F.sum(F.col("s") * F.col("v")).alias("z"))


def soft_assignment(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, cluster, q): Student's t kernel of squared distances, normalised over the centres.  Both tables are (id or cluster, pos, v)."""
    gap = points.join(centres.withColumnRenamed("v", "c"), "pos").groupBy("id", "cluster").agg(F.sum(F.pow(F.col("v") - F.col("c"), dbl(2))).alias("d2"))
    t = gap.withColumn("t", dbl(1) / (dbl(1) + F.col("d2")))
    return t.select("id", "cluster", (F.col("t") / F.sum("t").over(Window.partitionBy("id"))).alias("q"))


def target_distribution(q: DataFrame) -> DataFrame:
    """(id, cluster, p): squared shares over the cluster's mass, normalised."""
    mass = q.groupBy("cluster").agg(F.sum("q").alias("f"))
    w = q.join(mass, "cluster").withColumn("w", F.col("q") * F.col("q") / F.col("f"))
    return w.select("id", "cluster", (F.col("w") / F.sum("w").over(Window.partitionBy("id"))).alias("p"))


def kl_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """One row, loss: mean over points of sum p log(p / q)."""
    rows = p.join(q, ["id", "cluster"]).groupBy("id").agg(F.sum(F.col("p") * F.log((F.col("p") + dbl(1e-12)) / (F.col("q") + dbl(1e-12)))).alias("l"))
    return rows.agg(F.avg("l").alias("loss"))


def reconstruction_loss(truth: DataFrame, guess: DataFrame) -> DataFrame:
    """(view, loss): mean squared error by view of (view, id, pos, v)."""
    return truth.join(guess.withColumnRenamed("v", "g"), ["view", "id", "pos"]).groupBy("view").agg(F.avg(F.pow(F.col("v") - F.col("g"), dbl(2))).alias("loss"))


def laplacian_loss(edges: DataFrame, z: DataFrame) -> DataFrame:
    """One row, loss: weighted mean squared distance of latent vectors (id, pos, v) over edges (src, dst, w)."""
    a, b = z.select(F.col("id").alias("src"), "pos", F.col("v").alias("p")), z.select(F.col("id").alias("dst"), "pos", F.col("v").alias("q"))
    d = edges.join(a, "src").join(b, ["dst", "pos"]).groupBy("src", "dst", "w").agg(F.sum(F.pow(F.col("p") - F.col("q"), dbl(2))).alias("d2"))
    return d.agg((F.sum(F.col("w") * F.col("d2")) / (F.sum("w") + dbl(1e-8))).alias("loss"))


def info_nce(z: DataFrame, positives: DataFrame, tau: float = 0.12) -> DataFrame:
    """One row, loss: of each point against all others, its positives (src, dst) weighted alike.  All points are compared: a batch, not a corpus."""
    norm = z.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    unit = z.join(norm, "id").select("id", "pos", (F.col("v") / (F.col("n") + dbl(1e-12))).alias("v"))
    sim = unit.select(F.col("id").alias("src"), "pos", F.col("v").alias("p")).join(unit.select(F.col("id").alias("dst"), "pos", F.col("v").alias("q")), "pos").where("src <> dst").groupBy("src", "dst").agg(F.exp(F.sum(F.col("p") * F.col("q")) / dbl(tau)).alias("e"))
    marked = sim.join(positives.select("src", "dst", F.lit(1).alias("pos")), ["src", "dst"], "left")
    each = marked.groupBy("src").agg(F.sum(F.when(F.col("pos") == 1, F.col("e"))).alias("up"), F.sum("e").alias("all")).where("up is not null")
    return each.agg(F.avg(-F.log(F.col("up") / F.col("all"))).alias("loss"))


def _times(w: float) -> Callable:
    return lambda v: v * dbl(w)


def joint_features(views: list[tuple[DataFrame, float]]) -> DataFrame:
    """(id, f): views (id, f array) side by side, each times its weight."""
    out = None
    for i, (df, w) in enumerate(views):
        own = df.select("id", F.transform("f", _times(w)).alias(f"f{i}"))
        out = own if out is None else out.join(own, "id")
    return out.select("id", F.concat(*(f"f{i}" for i in range(len(views)))).alias("f"))


def principal_components(features: DataFrame, k: int = 2) -> DataFrame:
    """(id, f): the first k principal components of standardised features (id, f array)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own = features.select("id", array_to_vector("f").alias("_v"))
    own = StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_s").fit(own).transform(own)
    got = PCA(k=k, inputCol="_s", outputCol="_p").fit(own).transform(own)
    return got.select("id", vector_to_array("_p").alias("f"))


def apply_model(patches: DataFrame, model: Callable, schema: str) -> DataFrame:
    """Rows through a callable that takes and returns a pandas frame: segmentation networks and the like, supplied by the caller."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    return patches.mapInPandas(run, schema)


def aucell(expr: DataFrame, regulons: DataFrame, n_genes: int, share: float = 0.05) -> DataFrame:
    """(spot_id, regulon, auc): area under the recovery curve of a regulon's genes among the top share of a spot's ranking."""
    top = max(1, round(share * n_genes))
    rk = F.row_number().over(Window.partitionBy("spot_id").orderBy(F.desc("value"), "gene"))
    ranked = expr.withColumn("rk", rk).where(F.col("rk") <= top)
    sizes = regulons.groupBy("regulon").agg(F.count("*").alias("n"))
    got = ranked.join(regulons, "gene").groupBy("spot_id", "regulon").agg(F.sum(dbl(top) - F.col("rk") + 1).alias("area"))
    full = F.least(F.col("n"), F.lit(top))
    most = full * dbl(top) - full * (full - 1) / dbl(2)
    return got.join(sizes, "regulon").select("spot_id", "regulon", (F.col("area") / most).alias("auc"))
