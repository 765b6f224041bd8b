"""Words and word hashes of Arrow string batches, as flat numpy arrays.

A batch of texts is one run of UTF-8 bytes plus offsets, so that a whole slice
of documents is tokenised by a handful of array operations.  A word is a run
of bytes other than 0x20 and 0x09-0x0D; a null text counts as an empty one.
Slices hold about ``SLICE_BYTES`` of text: memory is bounded by that or by the
longest single text, never by the number of rows in a batch.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20

#: Two lanes of constants, so that two hashes of one word have nothing in common but its bytes.
_STEP = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], np.uint64)
_SEED = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)
_FIRST = np.array([0xFF51AFD7ED558CCD, 0xBF58476D1CE4E5B9], np.uint64)
_SECOND = np.array([0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], np.uint64)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Slice:
    """Some rows of a batch: their bytes, and where each row's bytes begin."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[Slice]:
    """The rows of a batch in runs of about ``size`` bytes of text."""
    if batch.num_rows == 0:
        return
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        own = offsets[start : stop + 1]
        yield Slice(batch.slice(start, stop - start), data[own[0] : own[-1]], own - own[0])
        start = stop
    release()


def marks(part: Slice, rows: Iterable[int]) -> pa.Array:
    """128 bits of the SHA-256 of each of the texts, which tell rows of one id apart."""
    return pa.array([hashlib.sha256(part.text(i)).digest()[:16] for i in rows], pa.binary())


def mark_of(text: str) -> Column:
    """The same of a column; a null text counts as an empty one."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.encode(text, "UTF-8"), F.lit(b"")), 256)), 1, 16)


def release() -> None:
    """Give memory that numpy and Arrow have freed back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each row (one more entry than rows)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = ink.copy()
    begins[1:] &= ~ink[:-1] | cut[1:n]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:] | cut[1:n]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def mix(h: np.ndarray, lane: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values; each lane is another one."""
    shift = np.uint64(33 - lane * 3)
    with np.errstate(over="ignore"):
        h = h ^ (h >> shift)
        h *= _FIRST[lane]
        h ^= h >> np.uint64(33 - lane * 6)
        h *= _SECOND[lane]
        h ^= h >> np.uint64(33 - lane * 2)
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, wherever the word stands; the lanes are independent of each other.

    Eight bytes at a time are scrambled with the key of their place in the
    word, and the results added up; nothing is a polynomial in the bytes.  The
    last eight are filled with zeros, and the length enters with them, so words
    of up to eight bytes and one length never collide in either lane.
    """
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    padded = np.empty(len(data) + 8, np.uint8)
    padded[: len(data)], padded[len(data) :] = data, 0
    eights = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    lens = stops - starts
    with np.errstate(over="ignore"):
        x = eights[starts] & _KEEP[np.minimum(lens, 8)]
        h = mix(x + lens.astype(np.uint64) * _STEP[lane] + _SEED[lane], lane)
        long = np.flatnonzero(lens > 8)
        if len(long):
            more = (lens[long] - 1) // 8  # eights after the first
            begin = np.cumsum(more) - more
            for a in range(0, len(long), 1 << 16):  # in stretches, so that memory is bounded by the longest word
                some, own = long[a : a + (1 << 16)], more[a : a + (1 << 16)]
                place = np.arange(int(own.sum())) - np.repeat(begin[a : a + (1 << 16)] - begin[a], own) + 1
                at = np.repeat(starts[some], own) + 8 * place
                x = eights[at] & _KEEP[np.minimum(np.repeat(stops[some], own) - at, 8)]
                x = mix(x ^ mix(place.astype(np.uint64) * _STEP[lane] + _SEED[1 - lane], 1 - lane), lane)
                h[some] += np.add.reduceat(x, begin[a : a + (1 << 16)] - begin[a])
            h[long] = mix(h[long], lane)
    return h


def _joined(left: np.ndarray, right: np.ndarray, size: int, lane: int) -> np.ndarray:
    """Hashes of what ``left`` and the ``size`` words of ``right`` after it hold."""
    with np.errstate(over="ignore"):
        h = left * _SECOND[1 - lane]
        h += right ^ (np.uint64(size) * _STEP[lane])
        h ^= h >> np.uint64(31)
        h *= _FIRST[lane]
        h ^= h >> np.uint64(29)
    return h


def gram_hashes(words: np.ndarray, first: np.ndarray, size: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, and which of them stay within their row.

    Runs of 1, 2, 4 ... words are scrambled two by two, so that the work grows
    with the logarithm of ``size`` and the hash isn't linear in the words.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    at = np.arange(n)
    whole = at + size <= np.repeat(first[1:], np.diff(first))
    if size > n:
        return words.copy(), whole
    part, length, done, out = words, 1, 0, None
    while True:
        if size & length:  # each piece goes before what is done: the longest comes first
            cut = n - done - length + 1
            out = part[:cut].copy() if out is None else _joined(part[:cut], out[length : length + cut], done, lane)
            done += length
        if length * 2 > size:
            break
        cut = n - 2 * length + 1
        part, length = _joined(part[:cut], part[length : length + cut], length, lane), length * 2
    h = np.zeros(n, np.uint64)
    h[: len(out)] = out
    return mix(h, lane), whole


def shingles(words: np.ndarray, first: np.ndarray, size: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``size`` words (the whole row if it is shorter), and each row's first one."""
    h, whole = gram_hashes(words, first, size, lane)
    counts = np.diff(first)
    for short in range(1, size):
        rows = np.flatnonzero(counts == short)
        if len(rows):
            at = first[:-1][rows]
            own, _ = gram_hashes(words[(at[:, None] + np.arange(short)).ravel()], np.arange(len(rows) + 1) * short, short, lane)
            with np.errstate(over="ignore"):
                h[at] = mix(own[::short] + np.uint64(short), lane)
            whole[at] = True
    kept = np.flatnonzero(whole)
    return h[kept], np.searchsorted(kept, first)


def distinct_words(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct word first stands, in the order of its hash, and each word's place among the distinct ones.

    Words are the same if both hashes agree.
    """
    _, where, back = np.unique(hashes, return_index=True, return_inverse=True)
    if (checks[where][back] == checks).all():
        return where, back
    order = np.lexsort((checks, hashes))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(hashes[order]) != 0) | (np.diff(checks[order]) != 0)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def words_of(part: Slice, lowered: bool, lane: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a slice, and each row's first word."""
    data = lower(part.data) if lowered else part.data
    starts, stops, first = word_bounds(data, part.offsets)
    return word_hashes(data, starts, stops, lane), starts, stops, first
