"""From raw documents to token ids: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of documents; the last returns token ids.  Documents
without a doc_id, and documents that share one, go through like all others; of
duplicates one with an id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, langid, mixing, setsketch
from tessera.llm.queries import MIX_REPEATS, tokenizer_file
from tessera.plans.workspace import materialise, unused


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go."""
    return langid.accepted(docs, langid.fit(docs.where(langid.learnt())))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the smallest id stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, one without an id last.

    Where ids don't tell all rows apart (repeated or null ones), rows get keys of their own, written once; of
    equal ids the smallest key stays.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if not ids.where("doc_id is null or n > 1").head(1):
        kept = setsketch.near_duplicates(docs).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    key = unused(docs, "row_key")
    rows = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "near-keys")
    found = setsketch.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id")
    lead = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("lead")
    kept = found.join(rows.select(key, "doc_id"), key).groupBy("component_id").agg(lead).select(F.col("lead").getField(key).alias(key))
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: a document comes as often as its source's budget draws it, perhaps never."""
    return mixing.mixed(docs, repeats=MIX_REPEATS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the decoded text, for each row of the mixture."""
    return bpe.encode(docs, tokenizer_file(), with_ids=True, with_decoded=False)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("bpe", tokens),
]

#: Language prediction and BPE have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(made, f"pipeline-{name}", instead_of=(docs,))
    return made
