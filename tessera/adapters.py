"""Tissue views over the star-schema tables, as DataFrames and as SQL text.

Spots come from customers on a jittered lattice of 40 columns, expression from
line items, transcription factors from events, ligand-receptor pairs from parts,
pixels from balances and histology features from embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, d = F.col("c_custkey"), lambda e: F.expr(e).cast("double")
    return table(spark, sf_dir, "customer").select(
        c.cast("bigint").alias("spot_id"),
        F.concat(F.lit("S"), c.cast("string")).alias("barcode"),
        (d("c_custkey % 40") + F.lit(0.4) * d("(c_custkey * 7919) % 997") / F.lit(997.0)).alias("x"),
        (F.floor(c / 40).cast("double") + F.lit(0.4) * d("(c_custkey * 104729) % 991") / F.lit(991.0)).alias("y"),
        F.when((F.floor((c % 40) / 10) + F.floor(c / 400)) % 2 == 0, 2).otherwise(1).alias("label12"),
        F.col("c_mktsegment").alias("macro"),
    )


def expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("o_custkey").cast("bigint").alias("spot_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").cast("double").alias("value"))


def tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("bigint").alias("spot_id"), F.col("event_type").alias("tf")).agg(F.sum("value").cast("double").alias("value"))


def lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair for each part name: the brand of its first part signals to the brand of its last."""
    note = F.when(F.col("p_name").contains("bolt"), "Cell-Cell Contact").when(F.col("p_name").contains("ring"), "Secreted Signaling").otherwise(F.col("p_name"))
    each = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min_by("p_brand", "p_partkey").alias("ligand"), F.max_by("p_brand", "p_partkey").alias("receptor"), F.min_by("p_type", "p_partkey").alias("pathway"))
    number = F.row_number().over(Window.orderBy("p_name")) - 1  # over names, of which there are some dozens
    return each.select(number.cast("bigint").alias("pair_id"), "ligand", "receptor", "pathway", note.alias("ligand_annotation"))


def pixels(spark: SparkSession, sf_dir: str, width: int = 12, step: int = 144) -> DataFrame:
    """All balances, row by row; the last rows are filled with zeros up to a height that 12 divides."""
    c = table(spark, sf_dir, "customer")
    n = (c.agg(F.max("c_custkey")).first()[0] or 0) + 1
    return spark.range(-(-n // step) * step).join(c, F.col("id") == F.col("c_custkey"), "left").select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"), F.coalesce(F.col("c_acctbal").cast("double"), F.lit(0.0)).alias("v"))


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each spot; the table of vectors is dealt out again and again."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = (e.agg(F.max("vec_id")).first()[0] or 0) + 1
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("spot_id")).join(e, F.col("spot_id") % n == F.col("vec_id")).select("spot_id", F.col("embedding").cast("array<double>").alias("f"))


SPOTS_SQL = """spots AS (SELECT c_custkey::BIGINT AS spot_id, 'S' || c_custkey AS barcode,
    (c_custkey % 40)::DOUBLE + 0.4::DOUBLE * ((c_custkey * 7919) % 997)::DOUBLE / 997.0::DOUBLE AS x,
    floor(c_custkey / 40)::DOUBLE + 0.4::DOUBLE * ((c_custkey * 104729) % 991)::DOUBLE / 991.0::DOUBLE AS y,
    CASE WHEN (floor((c_custkey % 40) / 10) + floor(c_custkey / 400))::BIGINT % 2 = 0 THEN 2 ELSE 1 END AS label12, c_mktsegment AS macro FROM customer)"""
EXPR_SQL = """expr AS (SELECT o_custkey::BIGINT AS spot_id, p_brand AS gene, sum(l_quantity)::DOUBLE AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
TF_SQL = "tf AS (SELECT user_id::BIGINT AS spot_id, event_type AS tf, sum(value)::DOUBLE AS value FROM events GROUP BY ALL)"
LR_SQL = """lr AS (SELECT (row_number() OVER (ORDER BY p_name) - 1)::BIGINT AS pair_id, arg_min(p_brand, p_partkey) AS ligand, arg_max(p_brand, p_partkey) AS receptor, arg_min(p_type, p_partkey) AS pathway,
    CASE WHEN contains(p_name, 'bolt') THEN 'Cell-Cell Contact' WHEN contains(p_name, 'ring') THEN 'Secreted Signaling' ELSE p_name END AS ligand_annotation FROM part GROUP BY p_name)"""
PIXELS_SQL = """pixels AS MATERIALIZED (SELECT (id // 12)::INTEGER AS y, (id % 12)::INTEGER AS x, coalesce(c_acctbal::DOUBLE, 0) AS v
    FROM (SELECT unnest(range(0, (max(c_custkey)::BIGINT + 144) // 144 * 144)) AS id FROM customer) LEFT JOIN customer ON c_custkey = id)"""
HIST_SQL = "hist AS (SELECT c_custkey::BIGINT AS spot_id, embedding::DOUBLE[] AS f FROM customer JOIN embeddings ON c_custkey % (SELECT max(vec_id) + 1 FROM embeddings) = vec_id)"
