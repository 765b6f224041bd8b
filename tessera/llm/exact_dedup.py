"""Exact deduplication as a stream with keyed state that never expires.

Texts are equal when they are identical after each run of bytes 0x20 and
0x09-0x0D becomes one space; null counts as empty.  A streaming aggregation,
keyed by the SHA-256 digest of the normalised text, keeps for each digest the
smallest doc_id seen, the content locator of that row (file and row index) and
the number of rows.  There is no watermark, so state stays for good; it lives
in RocksDB on the executors' disks and its checkpoint in the shared folder.
Rows of one digest are combined before the shuffle: a text that makes up a
third of all rows costs one row from each task.  A stream started again with
the same folder reads only files it has not seen, however old, and judges them
against all earlier ones; a text that the state lacks is an error.

Every row that hits a digest held by another row is then compared byte by byte
with the text at the locator.  Rows that share a digest but not the bytes leave
the group and are grouped by their text itself; so a digest as short as a few
bits still gives exact groups (``digest_bits`` is short in tests only).

Of equal texts the row with the smallest doc_id stays, one without a doc_id only
where no other has one; rows that repeat that doc_id as well go by the smaller
locator.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.workspace import exists, fresh_path, is_directory, materialise, unused

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the stream's own session.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column, bits: int = 256) -> Column:
    """The first ``bits`` bits of the text's SHA-256, as bytes; fewer than 8 leave one byte of 2**bits values."""
    whole = F.unhex(F.sha2(text, 256))
    if bits >= 8:
        return F.substring(whole, 1, bits // 8)
    return F.unhex(F.lpad(F.hex(F.conv(F.substring(F.sha2(text, 256), 1, 2), 16, 10).cast("int") % (1 << bits)), 2, "0"))


def located(spark: SparkSession, path: str, files_per_batch: int | None = None, streaming: bool = False) -> DataFrame:
    """doc_id, text and the locator (file, row) of each row of a Parquet table."""
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    reader = spark.readStream if streaming else spark.read
    if streaming:
        reader = reader.option("maxFileAge", "36500d")  # by default files a week older than the newest one seen are passed over
    if streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if streaming and not is_directory(spark, path):
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file only as a pattern
    return reader.schema(schema).parquet(path).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"))


def _entry() -> Column:
    """What the smallest of decides which row stays: a row with an id comes before one without."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")


def absorb(spark: SparkSession, path: str, state: str, digest_bits: int = 256, files_per_batch: int | None = None) -> None:
    """Run the stream over the files of ``path`` that ``state`` has not seen, until there are none left."""
    own = spark.newSession()
    for k, v in STATE.items():
        own.conf.set(k, v)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    rows = located(own, path, files_per_batch, streaming=True)
    keyed = rows.select(digest(normalised(), digest_bits).alias("digest"), _entry().alias("entry"))
    groups = keyed.groupBy("digest").agg(F.min("entry").alias("first"), F.count("*").alias("n"))
    query = groups.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def held(spark: SparkSession, state: str) -> DataFrame:
    """What the state keeps: digest, first (doc_id and locator) and n."""
    found = spark.read.format("statestore").load(state)
    return found.select(F.col("key.digest").alias("digest"), F.struct("value.min.doc_id", "value.min.locator").alias("first"), F.col("value.count").alias("n"))


def duplicates(spark: SparkSession, path: str, state: str | None = None, digest_bits: int = 256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the locator (file, row) of every row of the Parquet table at ``path``.

    state: the stream's checkpoint, to go on from an earlier run; a new one in the shared folder if left out.
    """
    state = state or fresh_path(spark, "dedup-state")
    absorb(spark, path, state, digest_bits)
    rows = located(spark, path)
    if not exists(spark, f"{state}/state"):
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.sha2(normalised(), 256).alias("text_sha256"), "locator.*")
    groups = materialise(held(spark, state), "dedup-groups").select(F.col("digest").alias("k"), "first", "n")
    keyed = rows.select("doc_id", "locator", F.sha2(normalised(), 256).alias("text_sha256"), digest(normalised(), digest_bits).alias("digest"))
    known = F.when(F.col("k").isNotNull(), F.col("n")).otherwise(F.raise_error(F.lit("a text is missing from the state: its file was not read")).cast("bigint"))
    judged = materialise(keyed.join(groups, F.col("digest") == F.col("k"), "left").select("doc_id", "locator", "text_sha256", "first", known.alias("n")), "dedup-judged", instead_of=(groups,))
    hits = judged.where("n > 1 and not (doc_id <=> first.doc_id and locator = first.locator)").select("locator", F.col("first.locator").alias("at"))
    wanted = hits.select("locator").unionByName(hits.select(F.col("at").alias("locator")).distinct()).distinct()
    texts = materialise(rows.select("locator", normalised().alias("body")).join(wanted, "locator", "left_semi"), "dedup-texts")
    pairs = hits.join(texts, "locator").withColumnRenamed("body", "mine").join(texts.select(F.col("locator").alias("at"), F.col("body").alias("theirs")), "at")
    strays = materialise(pairs.where("cast(mine as binary) <> cast(theirs as binary)").select("locator", "at", F.col("mine").alias("body")), "dedup-strays", instead_of=(texts,))
    if not strays.head(1):
        return judged.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("locator") == F.col("first.locator"))).alias("kept"), "text_sha256", "locator.*")
    own = strays.join(judged.select("locator", "doc_id", "text_sha256"), "locator")
    again = own.groupBy("body").agg(F.min(_entry()).alias("lead"), F.count("*").alias("size"))
    moved = own.join(again, "body").select("locator", F.struct("lead.doc_id", "lead.locator").alias("lead"), "size")
    lost = strays.groupBy("at").agg(F.count("*").alias("lost"))
    left = judged.join(moved, "locator", "left").join(lost, F.col("first.locator") == F.col("at"), "left")
    keep = F.coalesce(F.col("lead"), F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.locator").alias("locator")))
    return left.select("doc_id", keep.getField("doc_id").alias("keep_id"), F.coalesce("size", F.col("n") - F.coalesce("lost", F.lit(0))).alias("group_size"), (F.col("doc_id").eqNullSafe(keep.getField("doc_id")) & (F.col("locator") == keep.getField("locator"))).alias("kept"), "text_sha256", "locator.*")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The rows go to the shared folder first, for the stream to read and the locators to point into.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "dedup-input")
    docs.write.parquet(path)
    state = fresh_path(spark, "dedup-state")
    judged = duplicates(spark, path, state)
    rows = spark.read.schema(docs.schema).parquet(path)
    at = unused(docs, "at")
    kept = judged.where("kept").select(F.struct("file", "row").alias(at))
    located_rows = rows.withColumn(at, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    return located_rows.join(kept, at, "left_semi").select(*docs.columns)
