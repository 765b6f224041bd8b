"""Registered queries of models that are fitted or run over patches, and of the parameter search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera import adapters as A
from tessera.operators import autoencoder, models, regulators, scoring, tiles
from tessera.plans.workspace import materialise
from tessera.queries import HALF, query, ready


def _mean_around(patch: np.ndarray) -> np.ndarray:
    """A stand-in for a network: the mean of a pixel and the up to eight around it, of the first channel."""
    wide = np.pad(patch[:, :, 0], 1, constant_values=np.nan)
    views = np.lib.stride_tricks.sliding_window_view(wide, (3, 3))
    there = ~np.isnan(views)
    return np.where(there, views, 0.0).sum((2, 3)) / np.maximum(there.sum((2, 3)), 1)


@query(f"{A.PIXELS_SQL}, m AS (SELECT a.y, a.x, avg(b.v) AS p FROM pixels a JOIN pixels b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL), out AS (SELECT r.rule, y::BIGINT AS y, x::BIGINT AS x, p FROM m, (VALUES ('core'), ('blend')) r(rule))", "p", "rule y x")
def tiled_prediction(spark, sf_dir):
    """A model over patches, stitched by tile and by weight: the same as over the whole raster at once."""
    px = materialise(A.pixels(spark, sf_dir).select("y", "x", F.array("v").alias("f")), "pixels")
    core = tiles.predicted(px, _mean_around, 5, 1, fill=float("nan")).withColumn("rule", F.lit("core"))
    return core.unionByName(tiles.predicted(px, _mean_around, 16, 3, blend=True, fill=float("nan")).withColumn("rule", F.lit("blend")))


@query()
def autoencoder_latent(spark, sf_dir):
    """Latent vectors after five epochs over histology, expression and labels, with the prepared scores of all pairs."""
    p, e, ex, pairs = ready(spark, sf_dir)
    ccc = materialise(models.ccc_prep(scoring.raw_scores(e, ex, pairs, HALF), p.count(), most=e.count()), "ccc")
    genes = [r.gene for r in ex.select("gene").distinct().orderBy("gene").collect()]  # some dozens
    wide = ex.groupBy(F.col("spot_id").alias("id")).pivot("gene", genes).agg(F.sum("value")).fillna(0.0)
    views = {"hist": A.hist(spark, sf_dir).withColumnRenamed("spot_id", "id"), "gene": materialise(wide.select("id", F.array(*(F.col(f"`{g}`") for g in genes)).alias("f")), "genes")}
    views["onehot"] = A.spots(spark, sf_dir).select(F.col("spot_id").alias("id"), F.array(*((F.col("label12") == k).cast("double") for k in (1, 2))).alias("f"))
    model = autoencoder.fit(views, ccc, autoencoder.Config(epochs=5))
    return autoencoder.latent(model, views, ccc).select("id", F.posexplode("f").alias("dim", "v"))


@query()
def regulator_shares(spark, sf_dir):
    """What the genes of two makers tell about all genes, by five trees of two levels."""
    ex = materialise(A.expr(spark, sf_dir), "expr")
    regs = [r.gene for r in ex.where("gene rlike '#[12]'").select("gene").distinct().orderBy("gene").collect()]
    return regulators.importance(ex, regs, trees=5, depth=2)
