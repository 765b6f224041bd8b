"""Token ids as ORC: run-length encoded integers, row indexes, Bloom filters.

Documents are dealt to files by ranges of doc_id and sorted within them, so
ascending file names are ascending ids.  The ids of a document are one list of
ints, which ORC stores with its second integer run-length encoding; each stripe
carries row indexes (minimum and maximum of every 10,000 rows) and a Bloom
filter on doc_id.  A reader can take stripes in parallel, and a filter on doc_id
skips files, stripes and row groups from the metadata alone.  A third column, the
row's number in its file, costs a few bytes a stripe; it orders rows of one doc_id.

Tokenisation calls the ``tokenizers`` library on the distinct runs of text
between white space of each slice, a few thousand at once, with a special
string between them that the library never merges with its neighbours; white
space never matters to such a file's pattern.  Runs that hold a special string,
or whose neighbours do, make their whole text go through the library by itself.

Null and empty texts have the end id alone.  An empty table writes an empty
folder of files and reads back no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.workspace import materialise

from .bpe import gather, white_bounds
from .runs import Runs
from .text import Slice, distinct_words, slices, word_hashes

#: Options of Spark's ORC writer.
ORC = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "10000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
BETWEEN = "<|startoftext|>"
#: Runs in one text for the library, which takes longer for each piece of a long one.
TOGETHER = 64
SCHEMA = "doc_id bigint, ids array<int>, row bigint"
#: Stored bytes of input for a file of ids.
FILE_BYTES = 64 << 20


class LibraryEncoder:
    """Ids by the tokenizers library, remembered by run of text."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_str(spec)
        self.tool.no_truncation()
        self.tool.no_padding()
        self.between = self.tool.token_to_id(BETWEEN)
        self.special = [t.content.encode() for t in self.tool.get_added_tokens_decoder().values()]
        self.met = Runs()

    def _runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, lens = [], []
        for at in range(0, len(runs), 4096):
            some = runs[at : at + 4096]
            texts = [BETWEEN.join(some[k : k + TOGETHER]) for k in range(0, len(some), TOGETHER)]
            found: list[int] = []
            for e in self.tool.encode_batch_fast(texts, add_special_tokens=False):
                found += e.ids
                found.append(self.between)
            ids = np.array(found[:-1], np.uint32)
            cut = np.flatnonzero(ids == self.between)
            if len(cut) != len(some) - 1:
                raise ValueError("a run of text holds a special string")
            bounds = np.concatenate([[-1], cut, [len(ids)]])
            lens.append(np.diff(bounds) - 1)
            flat.append(ids[ids != self.between])
        return np.concatenate(flat), np.concatenate(lens)

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a slice, and each text's first one."""
        raw = part.data.tobytes()
        if any(s in raw for s in self.special):
            each = [np.array(self.tool.encode(part.text(i).decode(), add_special_tokens=False).ids, np.uint32) for i in range(part.n)]
            return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        starts, stops, first = white_bounds(part.data, part.offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(part.n + 1, np.int64)
        keys, checks = (word_hashes(part.data, starts, stops, lane) for lane in range(2))
        where, back = distinct_words(keys, checks)

        def new(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return self._runs([raw[a:b].decode() for a, b in zip(starts[where[which]].tolist(), stops[where[which]].tolist(), strict=True)])

        flat, begin, lens = self.met.ids(keys[where], checks[where], new)
        ids, sizes = gather(flat, begin[back], lens[back])
        return ids, np.concatenate([[0], np.cumsum(sizes)])[first]


_tools: dict[int, LibraryEncoder] = {}


def _tool(spec: str) -> LibraryEncoder:
    key = hash(spec)
    if key not in _tools:
        _tools.clear()
        _tools[key] = LibraryEncoder(spec)
    return _tools[key]


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 1, files: int | None = None) -> None:
    """Write doc_id and ids of every row of ``docs`` (doc_id, text; nothing else is read), in ascending doc_id order.

    files: how many; by default one for each shuffle partition, or for each
    FILE_BYTES of stored input if those are more, so that no task grows with the corpus.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer_file, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, row = _tool(spec.value), 0
        for batch in batches:
            for part in slices(batch):
                ids, first = tool.encode(part)
                lens = np.diff(first)
                out = np.full(len(ids) + part.n, end_id, np.int32)
                to = np.arange(len(ids)) + np.repeat(np.arange(part.n), lens)
                out[to] = ids
                cut = (first + np.arange(part.n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.rows.column(0), pa.ListArray.from_arrays(pa.array(cut), pa.array(out)), pa.array(np.arange(row, row + part.n))], ["doc_id", "ids", "row"])
                row += part.n

    n = files or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-_stored_bytes(docs) // FILE_BYTES))
    ordered = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, SCHEMA).write.options(**ORC).orc(path)


def _stored_bytes(docs: DataFrame) -> int:
    """What the planner knows of the input's size; 0 if it knows nothing."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids and row, with filters on doc_id pushed to the ORC metadata."""
    return spark.read.schema(SCHEMA).orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(1)
        cut = ids.offsets.to_numpy()
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(flat[cut[i] : cut[i + 1]].tobytes()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.diff(cut), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "file", "row", "n_tokens", "ids_crc32"])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files.

    ``start`` is a sum over the files before, of which there is one row each,
    plus a running sum within the file, in the order of its rows.
    """
    rows = read(spark, path).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), "row").mapInArrow(_digest, "doc_id bigint, file string, row bigint, n_tokens bigint, ids_crc32 bigint")
    rows = materialise(rows, "token-digests")
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("size"), F.min("doc_id").alias("low"))
    before = Window.orderBy(F.col("low").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = sums.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).select("file", "base")
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(files, "file").withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
