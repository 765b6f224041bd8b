"""Removal of repeated passages: a count-min prefilter, then exact grouping.

Words are runs of bytes other than 0x20 and 0x09-0x0D, taken unchanged.  A
window is ``size`` consecutive words of one document.  A word goes if a window
that covers it has a word sequence that starts at any other place as well, in
another document or in the same one.

First pass: each window is charged to its anchor, the smallest hash among the
runs of ``size // 2`` words inside it, at that run's place.  Equal windows have
equal anchors at different places, so the count of an anchor never falls short
of the count of a window; and there are some nine times fewer anchors than
windows.  Each task counts its anchors in sparse two-row count-min sketches,
cut in blocks of 65,536 cells; blocks are merged cell by cell.  The cells
counted twice or more come back, at most ``2 * 2**cell_bits / 8`` bytes (64 MB),
whatever the size of the corpus: that is the only thing broadcast.  A fuller
sketch lets more windows through and loses none.

Second pass: windows whose anchor is estimated repeated go into an exact
grouping by two independent hashes of their word sequence, 96 bits in all.  Places of one window that
meet in one task are settled there, so that a passage in a third of all
documents sends one row from each task.

Null and empty texts have no words; a text shorter than the window keeps all
its words; repeated rows are documents of their own and lose their windows.
Rows that share a doc_id (or have none) but differ in text are told apart by
128 bits of the text's SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import gram_hashes, mark_of, marks, mix, slices, word_bounds, words_of

BLOCK_BITS = 16
FLUSH = 1 << 21
_sketches: dict[int, list[np.ndarray]] = {}


def anchors(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its first word, the hash of its anchor and the anchor's place."""
    run = max(1, size // 2)
    grams, _ = gram_hashes(hashes, first, run)
    row_end = np.repeat(first[1:], np.diff(first))
    starts = np.flatnonzero(np.arange(len(hashes)) + size <= row_end)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), starts
    span = size - run + 1
    value, place = grams.copy(), np.arange(len(grams))
    done = 1
    while done < span:  # the smallest of ever longer stretches; of equals the leftmost
        step = min(done, span - done)
        right = value[step:] < value[:-step]
        value[:-step] = np.where(right, value[step:], value[:-step])
        place[:-step] = np.where(right, place[step:], place[:-step])
        done += step
    return starts, value[starts], place[starts]


def _cells(values: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [(values >> np.uint64(64 - bits)).astype(np.int64), (mix(values ^ np.uint64(0xA5A5F00DCAFE1234)) >> np.uint64(64 - bits)).astype(np.int64)]


def _sketch(size: int, bits: int):
    """Sparse sketches of a task's anchors: (block, the low cell bits of each count)."""

    def blocks(values: list[np.ndarray], windows: int) -> pa.RecordBatch:
        ids, parts = [], []
        for row, cells in enumerate(_cells(np.concatenate(values), bits)):
            cells.sort()
            block = cells >> BLOCK_BITS
            cut = np.flatnonzero(np.diff(block, prepend=-1))
            low = (cells & 0xFFFF).astype(np.uint16)
            ids += [(row << (bits - BLOCK_BITS)) + int(b) for b in block[cut]]
            parts += [x.tobytes() for x in np.split(low, cut[1:])] if len(cut) else []
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(parts, pa.binary()), pa.array([windows] + [0] * (len(ids) - 1), pa.int64())] if ids else [pa.array([], pa.int32()), pa.array([], pa.binary()), pa.array([], pa.int64())], ["block", "cells", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = windows = 0
        for batch in batches:
            for part in slices(batch):
                hashes, _, _, first = words_of(part, False)
                starts, value, place = anchors(hashes, first, size)
                if not len(starts):
                    continue
                fresh = np.flatnonzero(np.diff(place, prepend=-1))  # each place once: places rise with the windows
                held.append(value[fresh])
                n += len(fresh)
                windows += len(starts)
                if n >= FLUSH:
                    yield blocks(held, windows)
                    held, n, windows = [], 0, 0
        if held:
            yield blocks(held, windows)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the sketches of each block, which come sorted by block: its cells counted twice or more."""

    def full(block: int, counts: np.ndarray) -> tuple[int, bytes, bool]:
        cells = np.flatnonzero(counts >= 2)
        dense = 2 * len(cells) > counts.size // 8
        return block, (np.packbits(counts >= 2) if dense else cells.astype(np.uint16)).tobytes(), dense

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.bool_()))], ["block", "cells", "dense"])

    now, counts, rows = None, None, []
    for batch in batches:
        for block, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if block != now:
                if now is not None:
                    rows.append(full(now, counts))
                now, counts = block, np.zeros(1 << BLOCK_BITS, np.int32)
                if len(rows) >= 256:
                    yield out(rows)
                    rows = []
            np.minimum(counts + np.bincount(np.frombuffer(cells.as_buffer(), np.uint16), minlength=1 << BLOCK_BITS), 2, out=counts, casting="unsafe")
    if now is not None:
        rows.append(full(now, counts))
    if rows:
        yield out(rows)


def count_min(docs: DataFrame, size: int, bits: int) -> dict:
    """The merged sketch: for each of two rows the cells counted twice or more, as bits or as a list, whichever is smaller."""
    parts = docs.select("text").mapInArrow(_sketch(size, bits), "block int, cells binary, windows bigint").select("block", "cells")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_merged, "block int, cells binary, dense boolean").toArrow()
    return {"bits": bits, "blocks": [(b, c, d) for b, c, d in zip(*(merged.column(i).to_pylist() for i in range(3)), strict=True)]}


def _lookup(sketch) -> list[np.ndarray]:
    """Two arrays of bits, built once in each Python worker."""
    if sketch.id not in _sketches:
        _sketches.clear()
        bits = sketch.value["bits"]
        rows = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(2)]
        per = 1 << (bits - BLOCK_BITS)
        for block, cells, dense in sketch.value["blocks"]:
            own = rows[block // per][(block % per) << (BLOCK_BITS - 3) :][: 1 << (BLOCK_BITS - 3)]
            if dense:
                own[:] = np.frombuffer(cells, np.uint8)
            else:
                flags = np.zeros(1 << BLOCK_BITS, np.uint8)
                flags[np.frombuffer(cells, np.uint16)] = 1
                own[:] = np.packbits(flags)
        _sketches[sketch.id] = rows
    return _sketches[sketch.id]


class _Broadcast:
    """A broadcast with a name for the worker's cache."""

    def __init__(self, spark, value):
        self.inner = spark.sparkContext.broadcast(value)
        self.id = self.inner._jbroadcast.id() if self.inner._jbroadcast is not None else id(value)

    def __getstate__(self):
        return {"inner": self.inner, "id": self.id}

    @property
    def value(self):
        return self.inner.value


def _flagged(size: int, sketch):
    """(h, c, doc_id, t, pos, n): windows estimated repeated; n: places in this task, below 0 if known to be repeated."""

    def rows(held: list) -> pa.RecordBatch:
        h, c, pos = (np.concatenate([x[i] for x in held]) for i in range(3))
        ids, t = (pa.concat_arrays([x[i] for x in held]) for i in (3, 4))
        order = np.lexsort((c, h))
        hs, cs = h[order], c[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])
        group = np.cumsum(new) - 1
        n = np.bincount(group)[group]
        lead = new | (n > 1)  # single places, and all places of the windows that are settled
        at = np.flatnonzero(np.bincount(order[lead], minlength=len(h)))  # in the order of the documents, which compresses well
        places = np.empty(len(h), np.int64)
        places[order] = np.where(new, n, -1)  # minus: settled, not to be counted again, and dealt out at random
        order, n, h = at, places[at], h.copy()
        with np.errstate(over="ignore"):
            spread = order[n < 0]
            h[spread] = mix(h[spread] + spread.astype(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(h[order].view(np.int64)), pa.array(c[order].view(np.int32)), ids.take(pa.array(order)), t.take(pa.array(order)), pa.array(pos[order].astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "c", "doc_id", "t", "pos", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _lookup(sketch)
        held: list = []
        n = 0
        for batch in batches:
            for part in slices(batch):
                hashes, _, _, first = words_of(part, False)
                starts, value, _ = anchors(hashes, first, size)
                if not len(starts):
                    continue
                hit = np.ones(len(starts), bool)
                for bits, cells in zip(seen, _cells(value, sketch.value["bits"]), strict=True):
                    hit &= (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
                at = starts[hit]
                if not len(at):
                    continue
                full, _ = gram_hashes(hashes, first, size)
                other, *_ = words_of(part, False, 1)
                check, _ = gram_hashes(other, first, size, 1)
                row = np.searchsorted(first, at, "right") - 1
                own, back = np.unique(row, return_inverse=True)
                held.append((full[at], (check[at] >> np.uint64(32)).astype(np.uint32), at - first[row], part.rows.column(0).take(pa.array(row)), marks(part, own).take(pa.array(back))))
                n += len(at)
                if n >= FLUSH:
                    yield rows(held)
                    held, n = [], 0
        if held:
            yield rows(held)

    return run


def _cut(size: int, keep_text: bool):
    """Words without those covered by the repeated windows that begin at ``places``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2)
            for at, part in _with_start(batch):
                starts, stops, first = word_bounds(part.data, part.offsets)
                n_words, removed, digests, texts = np.diff(first), np.zeros(part.n, np.int64), [], []
                for i in range(part.n):
                    words = part.text(i).split()
                    if places[at + i].is_valid:
                        begin = places[at + i].values.to_numpy()
                        step = np.zeros(len(words) + 1, np.int32)
                        np.add.at(step, begin, 1)
                        np.add.at(step, np.minimum(begin + size, len(words)), -1)
                        gone = np.cumsum(step[:-1]) > 0
                        removed[i] = gone.sum()
                        words = [words[k] for k in np.flatnonzero(~gone)]
                    kept = b" ".join(words)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if keep_text:
                        texts.append(kept)
                arrays = [part.rows.column(0), pa.array(n_words, pa.int64()), pa.array(removed), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(texts, pa.binary()).cast(pa.string())] * keep_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text)

    return run


def _with_start(batch: pa.RecordBatch):
    at = 0
    for part in slices(batch):
        yield at, part
        at += part.n


def remove_repeats(docs: DataFrame, size: int = 35, cell_bits: int = 28, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept_text of every row of ``docs``.

    docs: doc_id and text; further columns are left out.  size: words in a window.
    cell_bits: each of the two sketch rows has 2**cell_bits cells.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketch = _Broadcast(docs.sparkSession, count_min(docs, size, cell_bits))
    found = docs.mapInArrow(_flagged(size, sketch), f"h bigint, c int, doc_id {kind}, t binary, pos int, n int")
    over = Window.partitionBy("h", "c")
    repeated = found.withColumn("total", F.sum("n").over(over)).where("total > 1 or n < 0").select("doc_id", "t", "pos")
    places = repeated.groupBy("doc_id", "t").agg(F.collect_list("pos").alias("places"))
    joined = docs.withColumn("t", mark_of("text")).join(places.withColumnRenamed("doc_id", "k").withColumnRenamed("t", "kt"), F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("t") == F.col("kt")), "left").select("doc_id", "text", "places")
    return joined.mapInArrow(_cut(size, keep_text), f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * keep_text)
