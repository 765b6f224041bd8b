"""A hashed maximum-entropy language model with a class-factored softmax.

Tokens are a text's words (A-Z in lower case, runs of bytes other than 0x20 and
0x09-0x0D) and one end.  The most frequent training words are symbols of their
own, ``side`` classes of ``side`` words by rank; every other word belongs to one
of ``side`` further classes by its last two bytes, and to one of ``side`` buckets
there by its hash.  With class and member (word or bucket) as the two halves,

    P(word | context) = P(class | context) * P(member | class, context) * P(word | member)

The first two factors are softmaxes over a bias and sums of hashed feature weights:
for the class the previous symbol, the one before it (a skip feature), both
together, and the one three back (a skip feature); for the member the class
itself, and the previous symbol and the one before, each with the class.  The
last is 1 for a word of its own and (c + 1) / (C + V + 1) in a bucket of C
training tokens and V distinct words, the 1 left over for all unknown words; so
probabilities sum to one, and rare words have evidence of their context too.

Everything grows with the corpus: ``side`` with the fourth root of the distinct
words, so that words of their own grow with the square root; feature rows with
the fifth root of the training tokens (at 30 TB of text some 0.5 GB of weights,
the bound ``most_bytes``: give executors 4 GB a core there, or less most_bytes).

Learning goes over all training tokens, in ROUNDS jobs of a part each.  Texts are
dealt to shards by a hash of doc_id and words, and read in the order of doc_id
within a shard; every shard takes adaptive gradient steps from the weights and
step sizes it was sent, and the mean over shards, weighted by tokens and taken
in the order of the shards, starts the next round.  The number of shards follows
from the number of tokens alone, so scores don't depend on files, partitions
or lost executors.  Counts of words never leave the executors as a whole: they
are summed in shards by word hash, and each shard answers the dictionaries that asked it.

One pass turns texts into chunks (a dictionary of word hashes and positions in
it); all later passes read chunks, or the symbols made of them.  Words are known by 64-bit hashes.

Null and empty texts are one end token; rows without a doc_id are scored like
any other.  With nothing to learn from, N and V are 0 and the model is uniform over its buckets.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.workspace import discard, fresh_path, materialise, written

from .text import lower, mix, slices, word_bounds, word_hashes

ROUNDS, BATCH, RATE = 3, 1 << 12, 1.0
END = np.uint64(0x243F6A8885A308D3)
CHUNK_BYTES = 8 << 20
SHARD_ENTRIES = 1 << 20
#: Numbers in a part of the weights, and groups of shards, in which changes are averaged: no task meets all of either.
PART, BUCKETS = 1 << 16, 64
#: Training tokens of a shard for each number of the weights; tokens that are learnt from, or scored, at once.
TOKENS_A_WEIGHT, HELD = 2, 1 << 18
#: Exponents beyond either end count as the end.
STEEP = np.float32(80)
NONE = np.float32(-1e4)


@dataclass(frozen=True)
class Shape:
    """How large a model is; derived from the distinct words and the tokens that teach."""

    side: int
    rows: int

    @classmethod
    def of(cls, tokens: int, words: int, most_bytes: int) -> Shape:
        side = max(32, 8 * round(0.75 * words**0.25 / 8))
        rows = min(2000 * max(tokens, 1) ** 0.2, most_bytes / (4 * 3 * side))
        return cls(side, 1024 * max(1, round(rows / 1024)))

    @property
    def head(self) -> int:
        return self.side * self.side

    @property
    def symbols(self) -> int:
        return 2 * self.head

    @property
    def kind(self):
        return np.uint16 if self.symbols <= 1 << 16 else np.uint32

    @property
    def weights(self) -> int:
        return 3 * self.side * self.rows

    def shards(self, tokens: int) -> int:
        return max(1, -(-tokens // (TOKENS_A_WEIGHT * self.weights)))

    def tail(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols of words that have none of their own, from their hashes and last two bytes."""
        with np.errstate(over="ignore"):
            own = ((ends.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(8)).astype(np.int64) % self.side
            return self.head + own * self.side + (mix(words) % np.uint64(self.side)).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True) if x.nbytes else b""


def _unpack(b: bytes, kind, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _last_two(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    last = data[stops - 1].astype(np.uint16)
    return last * np.uint16(256) + np.where(stops - starts > 1, data[np.maximum(stops - 2, 0)], 0).astype(np.uint16)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each few MB of text: ids, lengths, dictionary and the tokens' places in it."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for part in slices(batch, size=CHUNK_BYTES // 4):
            data = lower(part.data)
            starts, stops, first = word_bounds(data, part.offsets)
            lens = np.diff(first) + 1
            tokens = np.full(int(lens.sum()), END, np.uint64)
            ends = np.zeros(len(tokens), np.uint16)
            to = np.arange(len(starts)) + np.repeat(np.arange(part.n), lens - 1)
            tokens[to], ends[to] = word_hashes(data, starts, stops), _last_two(data, starts, stops)
            ids = part.rows.column(0)
            flags = part.rows.column(2).to_numpy(zero_copy_only=False).astype(np.uint8) + 2 * ids.is_null().to_numpy(zero_copy_only=False)
            held.append((ids.fill_null(0).to_numpy().copy(), lens, flags.astype(np.uint8), tokens, ends))
            size += len(data)
            if size >= CHUNK_BYTES:
                yield _chunk(held)
                held, size = [], 0
    if held:
        yield _chunk(held)


def _chunk(held: list[tuple]) -> pa.RecordBatch:
    ids, lens, flags, tokens, ends = (np.concatenate([x[k] for x in held]) for k in range(5))
    entries, where, back = np.unique(tokens, return_index=True, return_inverse=True)
    seen = np.bincount(back[np.repeat(flags & 1 == 0, lens)], minlength=len(entries))
    with np.errstate(over="ignore"):  # what deals texts to shards and rounds
        deal = mix(np.add.reduceat(mix(tokens), np.cumsum(lens) - lens) + mix(ids.astype(np.uint64), 1), 1)
    row = [int.from_bytes(os.urandom(7), "little"), len(ids), len(tokens), len(entries), ids.tobytes(), deal.tobytes(), _pack(lens.astype(np.uint32)), flags.tobytes(), _pack(back.astype(np.uint32)), entries.tobytes(), seen.astype(np.uint32).tobytes(), ends[where].tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, [pa.int64()] * 4 + [pa.binary()] * 8, strict=True)], CHUNK.names)


class CHUNK:
    names = ["chunk", "n_docs", "n_tokens", "n_entries", "ids", "deal", "lens", "flags", "tokens", "entries", "seen", "ends"]
    schema = ", ".join(f"{n} {'bigint' if i < 4 else 'binary'}" for i, n in enumerate(names))


def _to_shards(shards: int):
    """(shard, chunk, entries, seen, ends): each dictionary cut by ranges of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, e, seen, ends in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                entries, seen, ends = np.frombuffer(e, np.uint64), np.frombuffer(seen, np.uint32), np.frombuffer(ends, np.uint16)
                shard = _shard(entries, shards)
                at = np.flatnonzero(np.diff(shard, prepend=-1))  # entries are sorted, and so are their shards
                yield pa.RecordBatch.from_arrays([pa.array(shard[at], pa.int32()), pa.array([chunk] * len(at), pa.int64()), *(pa.array([p.tobytes() for p in np.split(x, at[1:])], pa.binary()) for x in (entries, seen, ends))], ["shard", "chunk", "entries", "seen", "ends"])

    return run


def _shard(entries: np.ndarray, shards: int) -> np.ndarray:
    return ((entries >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


COUNTED = "kind int, shard int, chunk bigint, counts binary, n bigint, v bigint, words binary, ends binary"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by shard: counts for each dictionary that asked (kind 0), and the shard's training words (kind 1)."""

    def answer(shard: int, rows: list) -> pa.RecordBatch:
        entries = np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows])
        seen = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows]).astype(np.float64)
        ends = np.concatenate([np.frombuffer(r[3], np.uint16) for r in rows])
        words, where, back = np.unique(entries, return_index=True, return_inverse=True)
        total = np.bincount(back, seen, len(words)).astype(np.int64)
        sizes = [len(r[1]) // 8 for r in rows]
        each = [x.tobytes() for x in np.split(total[back], np.cumsum(sizes)[:-1])]
        known = np.flatnonzero(total)
        k = len(rows)
        cols = [[0] * k + [1], [shard] * (k + 1), [r[0] for r in rows] + [None], [*each, _pack(total[known])], [None] * k + [int(total.sum())], [None] * k + [len(known)], [None] * k + [words[known].tobytes()], [None] * k + [ends[where[known]].tobytes()]]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in COUNTED.split(", ")])

    now, rows = None, []
    for batch in batches:
        for shard, *rest in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if shard != now:
                if rows:
                    yield answer(now, rows)
                now, rows = shard, []
            rows.append(rest)
    if rows:
        yield answer(now, rows)


def _words(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and last bytes of a shard's training words."""
    return np.frombuffer(row["words"], np.uint64), _unpack(row["counts"], np.int64, row["v"]), np.frombuffer(row["ends"], np.uint16)


def _leaders(most: int):
    """(word, n): the leading words of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                words, n, _ = _words(row)
                at = np.lexsort((words.view(np.int64), -n))[:most]
                yield pa.RecordBatch.from_arrays([pa.array(words[at].view(np.int64)), pa.array(n[at])], ["word", "n"])

    return run


def _places(shape: Shape, head: np.ndarray, order: np.ndarray, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of words; ``head``: sorted hashes of those with symbols of their own, which are in ``order``."""
    out = shape.tail(words, ends)
    if len(head):
        at = np.minimum(np.searchsorted(head, words), len(head) - 1)
        own = head[at] == words
        out[own] = order[at[own]]
    return out


def _sums(shape: Shape, head: np.ndarray, order: np.ndarray):
    """(symbol, n, v): tokens and distinct words by symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(shape.symbols, np.int64), np.zeros(shape.symbols, np.int64)
        for batch in batches:
            for row in _rows(batch):
                words, count, ends = _words(row)
                at = _places(shape, head, order, words, ends)
                n += np.bincount(at, count, shape.symbols).astype(np.int64)
                v += np.bincount(at, minlength=shape.symbols)
        own = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own]), pa.array(v[own])], ["symbol", "n", "v"])

    return run


def _symbols(known, shards: int, rounds: int):
    """A row for each text from chunks with their counts: symbols of its tokens, and what needs no context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, head, order, sums, n, v = known.value
        for batch in batches:
            for row in _rows(batch):
                entries = np.frombuffer(row["entries"], np.uint64)
                counts = np.concatenate([np.frombuffer(b, np.int64) for _, b in sorted((x["shard"], x["counts"]) for x in row["parts"])])
                symbol = _places(shape, head, order, entries, np.frombuffer(row["ends"], np.uint16))
                share = np.where(symbol < shape.head, 0.0, np.log10((counts + 1) / (sums[symbol].sum(1) + 1)))
                base = np.log10((counts + 1) / (n + v + 1))
                tokens = _unpack(row["tokens"], np.uint32, row["n_tokens"])
                lens = _unpack(row["lens"], np.uint32, row["n_docs"]).astype(np.int64)
                cut = np.cumsum(lens) - lens
                each = [np.add.reduceat(x[tokens], cut) for x in (base, share, (counts > 0).astype(np.int64))]
                flags, deal = np.frombuffer(row["flags"], np.uint8), np.frombuffer(row["deal"], np.uint64)
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=flags & 2 != 0)
                texts = _binary(symbol[tokens].astype(shape.kind), np.append(cut, len(tokens)))
                shard, turn = (deal >> np.uint64(32)) % np.uint64(shards), (deal & np.uint64(0xFFFFFFFF)) % np.uint64(rounds)
                out = [pa.array(shard.astype(np.int32)), pa.array(turn.astype(np.int32)), pa.array(deal.view(np.int64)), ids, pa.array(flags & 1 != 0), pa.array(lens), pa.array(each[2]), pa.array(each[0]), pa.array(each[1]), texts]
                whole = pa.RecordBatch.from_arrays(out, SYMBOL.names)
                for at in range(0, whole.num_rows, 4096):
                    yield whole.slice(at, 4096)

    return run


def _binary(x: np.ndarray, first: np.ndarray) -> pa.Array:
    """Stretches of an array as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * x.itemsize).astype(np.int32)), pa.py_buffer(x)])


class SYMBOL:
    names = ["shard", "turn", "deal", "doc_id", "held", "n_tokens", "known", "base", "share", "symbols"]
    schema = "shard int, turn int, deal bigint, doc_id bigint, held boolean, n_tokens bigint, known bigint, base double, share double, symbols binary"


def contexts(symbols: np.ndarray, place: np.ndarray, at: slice, start: int) -> np.ndarray:
    """The three symbols before each token of a stretch; ``start`` before a text's first.  place: of each token in its text."""
    out = np.full((3, at.stop - at.start), start, np.int64)
    for back in range(1, 4):
        own = np.flatnonzero(place[at] >= back)
        out[back - 1, own] = symbols[own + (at.start - back)]
    return out


def _hash(x: np.ndarray, salt: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((x.astype(np.uint64) + np.uint64(salt << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % rows


def class_features(shape: Shape, context: np.ndarray) -> list[np.ndarray]:
    """Rows of the class factor's weights for each token."""
    one, two, three = context
    return [_hash(x, k, shape.rows) for k, x in enumerate((one, two, one * (shape.symbols + 1) + two, three), 1)]


def member_features(shape: Shape, context: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Rows of the member factor's weights for each token, whose class is ``own``."""
    one, two, _ = context
    return [_hash(x, k, shape.rows) for k, x in enumerate((own, one * 2 * shape.side + own, two * 2 * shape.side + own), 5)]


def _scores(table: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Exponents of each token's choices, kept within bounds that neither overflow nor sum to nothing."""
    out = np.take(table, rows[0], axis=0)
    some = np.empty_like(out)
    for r in rows[1:]:
        out += np.take(table, r, axis=0, out=some, mode="clip")
    out += bias
    return np.clip(out, -STEEP, STEEP, out=out)


def _by_row(gradient: np.ndarray, order: np.ndarray, cut: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of the gradients of each feature row; ``order`` has tokens by row, ``cut`` where each row begins.

    Most rows have a few tokens: the first four of each are added as arrays, only what is left one row after the other.
    """
    out = np.take(gradient, order[cut], axis=0)
    for k in range(1, 4):
        some = np.flatnonzero(count > k)
        if not len(some):
            return out
        out[some] += np.take(gradient, order[cut[some] + k], axis=0)
    some = np.flatnonzero(count > 4)
    if len(some):
        left = count[some] - 4
        begin = np.cumsum(left) - left
        at = np.arange(int(left.sum())) + np.repeat(cut[some] + 4 - begin, left)
        out[some] += np.add.reduceat(np.take(gradient, order[at], axis=0), begin, axis=0)
    return out


class Weights:
    """Feature weights and step sizes of both factors, and biases by class and by member."""

    def __init__(self, shape: Shape, sums: np.ndarray):
        """sums: training tokens and distinct words by symbol."""
        self.shape = shape
        table = sums[:, 0].reshape(2 * shape.side, shape.side).astype(np.float64)
        exists = np.ones(table.shape, bool)  # a symbol of its own without a word is never chosen; a bucket may be
        exists[: shape.side] = table[: shape.side] > 0
        every = exists.sum(1)
        by_class = np.where(every > 0, table.sum(1) + 1, 0)
        some = np.where(exists, table + 0.5, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.bias = np.where(every > 0, np.log(by_class / by_class.sum()), NONE).astype(np.float32)
            self.member_bias = np.where(exists, np.log(some / some.sum(1, keepdims=True)), NONE).astype(np.float32)
        self.tables = [np.zeros((shape.rows, 2 * shape.side), np.float32), np.zeros((shape.rows, shape.side), np.float32)]
        self.steps = [np.full(shape.rows, 0.1, np.float32) for _ in range(2)]

    def factors(self, symbols: np.ndarray, place: np.ndarray, at: slice) -> list[tuple]:
        """For each factor and a stretch of tokens: feature rows, biases and the choice taken."""
        context = contexts(symbols, place, at, self.shape.symbols)
        own, member = symbols[at] // self.shape.side, symbols[at] % self.shape.side
        return [(class_features(self.shape, context), self.bias, own), (member_features(self.shape, context, own), self.member_bias[own], member)]

    def log10(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 P(class) * P(member) of each token."""
        out = np.empty(len(symbols))
        for at in _stretches(len(symbols)):
            total = 0
            for table, (rows, bias, choice) in zip(self.tables, self.factors(symbols, place, at), strict=True):
                z = _scores(table, rows, bias)
                own = z[np.arange(len(choice)), choice].astype(np.float64)
                total = total + own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32))
            out[at] = total
        return out / np.log(10)

    def parts(self) -> list[np.ndarray]:
        """Everything that learning changes, table by table, as flat views."""
        return [x.reshape(-1) for x in (*self.tables, *self.steps)]

    def copy(self) -> Weights:
        out = object.__new__(Weights)
        out.shape, out.bias, out.member_bias = self.shape, self.bias, self.member_bias
        out.tables, out.steps = [x.copy() for x in self.tables], [x.copy() for x in self.steps]
        return out

    def less(self, other: Weights) -> np.ndarray:
        """The difference at half precision, one table after the other, made a stretch at a time."""
        out, at = np.empty(sum(x.size for x in self.parts()), np.float16), 0
        for x, y in zip(self.parts(), other.parts(), strict=True):
            for k in range(0, x.size, PART):
                out[at + k : at + min(k + PART, x.size)] = x[k : k + PART] - y[k : k + PART]
            at += x.size
        return out

    def move(self, at: int, change: np.ndarray) -> None:
        """Add a stretch of a difference, from its place on."""
        for x in self.parts():
            low, high = max(at, 0), min(at + len(change), x.size)
            if low < high:
                x[low:high] += change[low - at : high - at]
            at -= x.size

    def learn(self, symbols: np.ndarray, place: np.ndarray) -> None:
        """Adaptive gradient steps, a batch at a time; a feature row's step size falls with the gradients it has seen."""
        for at in _stretches(len(symbols)):
            for table, size, (rows, bias, choice) in zip(self.tables, self.steps, self.factors(symbols, place, at), strict=True):
                p = _scores(table, rows, bias)
                np.exp(p, out=p)
                p *= (1 / (p @ np.ones(p.shape[1], np.float32)))[:, None]
                p[np.arange(len(p)), choice] -= 1
                for r in rows:
                    ranked = np.sort(r * BATCH + np.arange(len(r)))
                    order, ranked = ranked % BATCH, ranked // BATCH
                    cut = np.flatnonzero(np.diff(ranked, prepend=-1))
                    count = np.diff(np.append(cut, len(ranked)))
                    g = _by_row(p, order, cut, count)
                    g /= np.sqrt(count).astype(np.float32)[:, None]
                    own = ranked[cut]
                    size[own] = np.sqrt(size[own] ** 2 + np.einsum("ij,ij->i", g, g) * np.float32(4 / g.shape[1]))
                    g *= (np.float32(RATE / len(rows)) / size[own])[:, None]
                    table[own] -= g


def _stretches(n: int) -> list[slice]:
    return [slice(at, min(at + BATCH, n)) for at in range(0, n, BATCH)]


def _gathered(rows, kind) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(rows, symbols, places in the text) of some texts at once, from rows that end in a text's symbols."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1])
        if n >= HELD * np.dtype(kind).itemsize:
            yield _flat(held, kind)
            held, n = [], 0
    if held:
        yield _flat(held, kind)


def _flat(held: list, kind) -> tuple[list, np.ndarray, np.ndarray]:
    symbols = np.frombuffer(b"".join(r[-1] for r in held), kind).astype(np.int64)
    lens = np.array([len(r[-1]) for r in held]) // np.dtype(kind).itemsize
    return held, symbols, np.arange(len(symbols)) - np.repeat(np.cumsum(lens) - lens, lens)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator]]:
    """(shard, its rows), from rows (shard, symbols) that come shard by shard."""
    from itertools import groupby

    rows = ((s, x) for batch in batches for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    return ((s, own) for s, own in groupby(rows, key=lambda r: r[0]))


CHANGE = "part int, bucket int, shard int, tokens bigint, change binary"


def _train(sent):
    """(part, bucket, shard, tokens, change): what each shard's tokens of this round change in each part of the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for shard, rows in _by_shard(batches):
            own, n = weights.copy(), 0
            for _, symbols, place in _gathered(rows, weights.shape.kind):
                own.learn(symbols, place)
                n += len(symbols)
            change = own.less(weights)
            for k, at in enumerate(range(0, len(change), PART)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([shard % BUCKETS], pa.int32()), pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([change[at : at + PART].tobytes()], pa.binary())], ["part", "bucket", "shard", "tokens", "change"])

    return run


def _mean(kind, keys: int):
    """The mean change of each part (and bucket: keys = 2), weighted by tokens, from rows in a fixed order; ``kind``: their number type."""

    def row(key, total, n):
        bucket = key[1] if keys == 2 else 0
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([bucket], pa.int32()), pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["part", "bucket", "shard", "tokens", "change"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, n = None, None, 0
        for batch in batches:
            for part, bucket, _, tokens, change in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (part, bucket)[:keys] != now:
                    if now is not None:
                        yield row(now, total, n)
                    now, total, n = (part, bucket)[:keys], 0.0, 0
                total, n = total + tokens * np.frombuffer(change, kind).astype(np.float64), n + tokens
        if now is not None:
            yield row(now, total, n)

    return run


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one: a chunk is a few MB."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(sent, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for batch in batches:
            score = batch.column("share").to_numpy().copy()
            texts = ((i, x) for i, x in enumerate(batch.column("symbols").to_pylist()))
            for rows, symbols, place in _gathered(texts, weights.shape.kind):
                at = np.flatnonzero(place == 0)
                score[rows[0][0] : rows[-1][0] + 1] += np.add.reduceat(weights.log10(symbols, place), at)
            own = [batch.column(c) for c in ("doc_id", "held", "n_tokens", "known")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(score), n)), batch.column("base"), pa.array(score)], [x.split()[0] for x in RESULT.split(", ")])

    return run


def _ordered(texts: DataFrame, shards: int) -> DataFrame:
    """Texts written shard by shard, one file each, which no reader splits: a file is one row group.

    So its writer holds a shard's encoded symbols, two or four bytes a token, before they go to the file.
    """
    spark, path = texts.sparkSession, fresh_path(texts.sparkSession, "lm-symbols")
    own = texts.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "deal", "symbols")
    own.write.option("parquet.block.size", 1 << 40).option("parquet.block.row.count.limit", (1 << 31) - 1).parquet(path)
    return written(spark.read.schema(SYMBOL.schema).parquet(path), path)


def score(docs: DataFrame, held_out, rounds: int = ROUNDS, most_bytes: int = 1 << 29) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    docs: an integer doc_id and text.  held_out: a boolean column of rows that teach nothing.
    most_bytes: bound of the feature weights.  A task that learns holds them two and a half times (as sent, the copy
    that learns, the change at half precision), one that scores once, the driver twice (weights and their change).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(held_out, F.lit(True)).alias("held"))
    chunks = materialise(rows.mapInArrow(_chunks, CHUNK.schema), "lm-chunks")
    entries = chunks.agg(F.sum("n_entries")).first()[0] or 0
    asked = chunks.select("chunk", "entries", "seen", "ends").mapInArrow(_to_shards(max(1, -(-entries // SHARD_ENTRIES))), "shard int, chunk bigint, entries binary, seen binary, ends binary")
    counted = materialise(asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(_count, COUNTED), "lm-counts")
    words = counted.where("kind = 1").select("counts", "n", "v", "words", "ends")
    n, v = (x or 0 for x in words.agg(F.sum("n"), F.sum("v")).first())
    shape = Shape.of(n, v, most_bytes)
    top = words.mapInArrow(_leaders(shape.head), "word bigint, n bigint").orderBy(F.desc("n"), "word").limit(shape.head).toArrow()
    head = top.column(0).to_numpy().view(np.uint64)
    order = np.argsort(head)
    head = head[order]
    sums = np.zeros((shape.symbols, 2), np.int64)
    found = words.mapInArrow(_sums(shape, head, order), "symbol bigint, n bigint, v bigint").groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
    sums[found.column(0).to_numpy()] = np.stack([found.column(1).to_numpy(), found.column(2).to_numpy()], 1)
    shards = shape.shards(n)
    known = spark.sparkContext.broadcast((shape, head, order.astype(np.int64), sums, n, v))
    back = counted.where("kind = 0").groupBy("chunk").agg(F.collect_list(F.struct("shard", "counts")).alias("parts"))
    joined = chunks.join(back, "chunk").select("n_docs", "n_tokens", "ids", "deal", "lens", "flags", "tokens", "entries", "ends", "parts")
    symbols = _ordered(joined.mapInArrow(_symbols(known, shards, rounds), SYMBOL.schema), shards)
    discard(chunks, counted)
    weights = Weights(shape, sums)
    for turn in range(rounds if n else 0):
        sent = spark.sparkContext.broadcast(weights)
        changes = symbols.where(~F.col("held") & (F.col("turn") == turn)).select("shard", "symbols").mapInArrow(_train(sent), CHANGE)
        some = changes.repartition("part", "bucket").sortWithinPartitions("part", "bucket", "shard").mapInArrow(_mean(np.float16, 2), CHANGE)
        mean = some.repartition("part").sortWithinPartitions("part", "bucket").mapInArrow(_mean(np.float32, 1), CHANGE).select("part", "change").toArrow().sort_by("part")
        for part, change in zip(mean.column("part").to_pylist(), mean.column("change"), strict=True):
            weights.move(part * PART, np.frombuffer(change.as_buffer(), np.float32))
    return symbols.select("doc_id", "held", "n_tokens", "known", "base", "share", "symbols").mapInArrow(_score(spark.sparkContext.broadcast(weights), n), RESULT)
