"""Evidence for ligand-receptor pairs in a growing folder of texts.

    spark-submit --py-files tessera.zip,jobs.zip jobs/literature_evidence.py \\
        --documents DIR --terms FILE --pairs FILE --output DIR --checkpoint DIR [--config jobs/literature_evidence.json]

documents: Parquet files with doc_id, text and source; new files may come at any time.
terms: (term, gene), the words that stand for a gene.  pairs: (ligand, receptor, pathway, ligand_annotation).

A run takes the files that its checkpoint hasn't seen, in batches, until none are left.  A sentence that names
both genes of a pair is one piece of evidence, and its words say whether the interaction is bound to the membrane or secreted.

* ``output/evidence``, by pathway and batch: pathway, ligand, receptor, doc, source, sentence, mode.
* ``output/summary``, by pathway: for each pair documents, sentences, sources, sentences by mode, and the mode that most of them tell.

A batch that is taken again after a failure overwrites its own partitions and makes the summaries of its pathways again, from
all evidence; other pathways aren't touched.  A run without new files changes nothing.  Texts that come twice count once, by doc_id
(without one, by their digest) and sentence; of their modes the first in the alphabet counts.  Null and empty texts have no evidence.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import main, read_or_none, read_table, settings
from tessera.functions.columns import gene_name, mode_of
from tessera.operators import interactions

log = logging.getLogger("jobs.literature_evidence")

#: files_per_batch: new files taken at once.  sentence: what ends one.  word: what one is made of, in lower case.  least_term: shorter terms are left out.
DEFAULTS = {"files_per_batch": 1000, "sentence": r"[.!?\n]+", "word": "[a-z0-9-]+", "least_term": 3}
EVIDENCE = "ligand string, receptor string, doc string, source string, sentence int, mode string, pathway string, batch bigint"
SUMMARY = "ligand string, receptor string, n_docs bigint, n_sentences bigint, n_sources bigint, n_membrane bigint, n_secreted bigint, mode string, pathway string"
KEY = ["pathway", "ligand", "receptor"]


def dictionary(terms: DataFrame, least: int) -> DataFrame:
    """(term, gene): terms in lower case, genes in standard form; a term may stand for several genes."""
    own = terms.select(F.lower(F.trim("term")).alias("term"), gene_name("gene").alias("gene"))
    return own.where((F.char_length("term") >= least) & (F.col("gene") != "")).distinct()


def database(pairs: DataFrame) -> DataFrame:
    """(ligand, receptor, pathway): distinct pairs of single genes; pairs without a pathway are in one called unknown."""
    own = interactions.without_complexes(interactions.clean(pairs.select(*interactions.NEEDED)))
    known = own.where("ligand <> '' and receptor <> ''")
    return known.select("ligand", "receptor", F.when(F.col("pathway") == "", "unknown").otherwise(F.col("pathway")).alias("pathway")).distinct()


def evidence(documents: DataFrame, terms: DataFrame, pairs: DataFrame, conf: dict) -> DataFrame:
    """A row for each pair and sentence that names both of its genes.

    Genes are gathered by sentence, so pairs are formed within a row and bounded by the pairs that are known.
    """
    doc = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.sha2("text", 256)))
    texts = documents.where("text is not null").select(doc.alias("doc"), F.coalesce("source", F.lit("unknown")).alias("source"), "text", F.monotonically_increasing_id().alias("row"))
    sentences = texts.select("doc", "source", "row", F.posexplode(F.split("text", conf["sentence"])).alias("sentence", "body"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(conf["word"]), F.lit(0)))
    each = sentences.select("doc", "source", "row", "sentence", mode_of("body").alias("mode"), F.explode(words).alias("term"))
    named = each.join(terms, "term").groupBy("doc", "source", "row", "sentence", "mode").agg(F.collect_set("gene").alias("genes"))
    led = named.where(F.size("genes") > 0).withColumn("ligand", F.explode("genes")).join(pairs, "ligand")
    return led.where(F.array_contains("genes", F.col("receptor"))).select(*KEY, "doc", "source", "sentence", "mode")


def summary(rows: DataFrame) -> DataFrame:
    """What is known of each pair; repeated documents count once."""
    once = rows.groupBy(*KEY, "doc", "sentence").agg(F.min("source").alias("source"), F.min("mode").alias("mode"))
    tells = lambda m: F.count_if(F.col("mode") == m)
    found = once.groupBy(*KEY).agg(F.countDistinct("doc").alias("n_docs"), F.count("*").alias("n_sentences"), F.countDistinct("source").alias("n_sources"), tells("mb").alias("n_membrane"), tells("secreted").alias("n_secreted"))
    most = F.when(F.col("n_membrane") > F.col("n_secreted"), "mb").when(F.col("n_secreted") > F.col("n_membrane"), "secreted")
    return found.withColumn("mode", most)


def run(spark: SparkSession, documents: str, terms: str, pairs: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Gather evidence for ligand-receptor pairs from documents that have come since the last run; returns the summary."""
    conf = settings(DEFAULTS, config)
    schema = spark.read.parquet(documents).select("doc_id", "text", "source").schema
    texts = spark.readStream.schema(schema).option("maxFilesPerTrigger", conf["files_per_batch"])
    stream = texts.parquet(f"{documents.rstrip('/')[:-1]}[{documents.rstrip('/')[-1]}]")  # a pattern, as a stream takes a folder or a pattern, but no single file

    def take(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        known = dictionary(read_table(own, terms), conf["least_term"])
        rows = evidence(batch, known, database(read_table(own, pairs)), conf)
        write(rows.withColumn("batch", F.lit(number).cast("bigint")).repartition("pathway"), f"{output}/evidence", "pathway", "batch")
        every = read_or_none(own, f"{output}/evidence", EVIDENCE)
        mine = every.where(F.col("batch") == number)
        made = mine.count()
        log.info("batch %d: read %d documents of %s, wrote %d rows of evidence to %s", number, batch.count(), documents, made, f"{output}/evidence")
        if made:
            touched = mine.select("pathway").distinct()
            write(summary(every.join(touched, "pathway", "left_semi")).repartition("pathway"), f"{output}/summary", "pathway")
            log.info("batch %d: wrote the summaries of %d pathways to %s", number, touched.count(), f"{output}/summary")

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("run over: %d batches", sum(p["numInputRows"] > 0 for p in query.recentProgress))
    return read_or_none(spark, f"{output}/summary", SUMMARY)


def write(rows: DataFrame, path: str, *by: str) -> None:
    """Overwrite the partitions that the rows are in, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


if __name__ == "__main__":
    main(run, {"documents": "Parquet folder of texts", "terms": "table of terms and genes", "pairs": "table of ligand-receptor pairs", "output": "folder of the results", "checkpoint": "folder of the stream's checkpoint"})
