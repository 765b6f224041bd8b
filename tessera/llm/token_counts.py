"""Token counts kept up to date by signed deltas.

Totals by source, language and tokenizer version are sums of committed batches.
A batch holds signed rows, +1 document and its tokens for an insert, -1 and
minus its tokens for a delete, both for a revised count, summed by key before
they are written.  A batch is written to a folder of its own and renamed into
place under its id, by a rename that fails where the id is there already: so a
retried or repeated commit changes nothing, of two at once one returns False, and
a commit that failed halfway left nothing that counts.  ``compact`` folds the
batches of one listing, and no others, into a snapshot that remembers their ids;
a batch that lands meanwhile stays a batch of its own.  Folders are listed before
the snapshot is looked up, so a reader never misses a batch that was just folded.
(Renames are atomic in HDFS and local file systems; in object stores without them one
writer at a time must be ensured from outside.)

Null sources and languages are keys like any other.  Null texts count no
tokens.  Keys whose documents and tokens both come to zero are left out.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"

#: Counting rules by version: how a text is cut into tokens.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "alnum-1": r"[A-Za-z0-9]+"}


def counted(docs: DataFrame, version: str, tokens: Column | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer and tokens; ``tokens`` for a rule that isn't in VERSIONS."""
    rule = tokens if tokens is not None else F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(VERSIONS[version]))
    return docs.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), rule.cast("bigint").alias("tokens"))


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(1).cast("bigint").alias("docs"), "tokens")


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(-1).cast("bigint").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old counts go and the new ones come, under whatever keys each has."""
    return deletes(old).unionByName(inserts(new))


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Ledger:
    """Committed batches of deltas below one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(f"{path}/batches"))

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _listed(self) -> tuple[list[str], str | None, set[str]]:
        """Committed batches that aren't folded, the snapshot, and the ids folded into it."""
        found = [x.getPath().getName() for x in self._fs.listStatus(self._at(f"{self.path}/batches"))]
        snapshots = sorted(x.getPath().toString() for x in self._fs.globStatus(self._at(f"{self.path}/snapshot-*")) or [])
        snapshot = snapshots[-1] if snapshots else None
        folded = {r.value for r in self.spark.read.text(f"{snapshot}/ids").collect()} if snapshot else set()
        return sorted(set(found) - folded), snapshot, folded

    def batches(self) -> list[str]:
        """Ids that count: committed batches, and those folded into the snapshot."""
        own, _, folded = self._listed()
        return sorted({*own, *folded})

    def _place(self, draft: str, target: str) -> bool:
        """Rename a folder to a name that nothing has yet; False, and the folder gone, if something has."""
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._at(draft), self._at(target), options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(self._at(draft), True)
            return False
        return True

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch; False if it had been committed before, when nothing is computed or changed."""
        if not re.fullmatch(r"[\w.-]+", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        own, _, folded = self._listed()
        if batch_id in folded or batch_id in own:
            return False
        draft = f"{self.path}/drafts/{batch_id}-{uuid.uuid4().hex}"
        summed(deltas).write.parquet(draft)
        return self._place(draft, f"{self.path}/batches/{batch_id}")

    def _totals(self, own: list[str], snapshot: str | None) -> DataFrame:
        paths = [f"{self.path}/batches/{b}" for b in own] + ([f"{snapshot}/totals"] if snapshot else [])
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return summed(rows).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        own, snapshot, _ = self._listed()
        return self._totals(own, snapshot)

    def compact(self) -> None:
        """Fold the batches there are now into one snapshot; totals stay as they are."""
        own, snapshot, folded = self._listed()
        number = int(snapshot.rsplit("-", 1)[1]) + 1 if snapshot else 0
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        self._totals(own, snapshot).write.parquet(f"{draft}/totals")
        self.spark.createDataFrame([(i,) for i in sorted({*own, *folded})], "value string").coalesce(1).write.text(f"{draft}/ids")
        if not self._place(draft, f"{self.path}/snapshot-{number:09d}"):
            raise RuntimeError("another compaction came first")
        for i in own:
            self._fs.delete(self._at(f"{self.path}/batches/{i}"), True)
