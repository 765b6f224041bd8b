"""Byte-pair encoding by batched numpy merge rounds, and decoding.

Reads a tokenizer file of the ``tokenizers`` library with NFC, white space to
one space and lower case as its normalizer, a pattern split and byte symbols
before the merges, a word-end suffix, and no decoder.  Texts are cut at white
space, which no piece of the pattern spans; the distinct runs of a slice are
normalised, split and merged once, and their ids put back in place of every
occurrence.

A merge round works on the symbols of all distinct pieces in one flat array:
each neighbouring pair inside a piece becomes a 64-bit key, found by binary
search among the sorted keys of all merges, which gives its rank.  In each
piece the pair of lowest rank is merged wherever it stands, leftmost first;
pieces without a known pair are done.  A piece of L symbols takes L - 1 rounds
at most, and all pieces share the rounds.  Pieces of more than LONG_PIECE symbols,
such as encoded data or scripts without spaces, have rounds by rank instead, which
look at changed pairs only; the merges are the same.

Null and empty texts have no ids.  The special strings of the file stand for
their ids wherever they occur in a text, as the library has it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import Runs
from .text import SLICE_BYTES, Slice, distinct_words, slices, word_hashes

#: White space in Unicode; U+001C to U+001F are none.
_WHITE = regex.compile("[\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_SIGMA = "Σ"
LONG_PIECE = 256


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def lower_case(text: str) -> str:
    """Lower case, character by character: a final sigma is like any other."""
    return text.lower() if _SIGMA not in text else "".join(c.lower() for c in text)


class Encoder:
    """The tables of one tokenizer file."""

    def __init__(self, spec: str):
        conf = json.loads(spec)
        model = conf["model"]
        kinds = [n["type"] for n in conf["normalizer"]["normalizers"]]
        steps = conf["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or conf["decoder"] is not None or model["ignore_merges"]:
            raise ValueError("this encoder knows NFC, Replace, Lowercase; Split, ByteLevel; BPE without decoder")
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(keys))
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], rank[order], made[rank]
        words = {i: w for w, i in vocab.items()} | {i: w for w, i in self.special.items()}
        self.words = [words.get(i, "").encode() for i in range(max(words) + 1)]
        self.met = Runs()

    def merge(self, ids: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols ``ids`` of the pieces numbered ``piece`` (rising) until no pair is known."""
        long = np.bincount(piece, minlength=1)[piece] > LONG_PIECE
        if not long.any():
            return self._by_rounds(ids, piece)
        parts = [self._by_rounds(ids[~long], piece[~long]), self._by_rank(ids[long], piece[long])]
        ids, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(piece, kind="stable")
        return ids[order], piece[order]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, the number of merges if it isn't known."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys))

    def _by_rank(self, ids: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same merges, where a round takes the lowest rank of all pieces and looks only at the pairs beside it.

        Places of each rank wait in a queue; symbols are linked to their neighbours.  So the work grows with the
        symbols, not with symbols times rounds.
        """
        n, top = len(ids), len(self.rank)
        ids, after, before = ids.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.append(piece[1:] != piece[:-1], True)
        after[ends], before[np.append(True, ends[:-1])] = -1, -1
        rank = np.full(n, top)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(at: np.ndarray) -> None:
            rank[at] = top
            at = at[after[at] >= 0]
            rank[at] = self._ranks(ids[at], ids[after[at]])
            at = at[rank[at] < top]
            at = at[np.argsort(rank[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[at], prepend=-1))
            for own in np.split(at, cuts[1:]) if len(at) else ():
                r = int(rank[own[0]])
                if r not in waiting:
                    heapq.heappush(queue, r)
                waiting.setdefault(r, []).append(own)

        put(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            start = np.append(True, after[at[:-1]] != at[1:])  # in a run of one symbol every other pair merges, from the left
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0]
            gone = after[at]
            ids[at], after[at] = self.made[r], after[gone]
            rank[gone], ids[gone] = top, -1
            follows = after[at] >= 0
            before[after[at[follows]]] = at[follows]
            left = before[at]
            put(np.unique(np.concatenate([at, left[left >= 0]])))
        kept = ids >= 0
        return ids[kept], piece[kept]

    def _by_rounds(self, ids: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each round merges the pair of lowest rank of every piece: for pieces of few symbols."""
        done_ids, done_piece = [], []
        top = len(self.rank)
        while len(ids) > 1:
            key = ids[:-1] * self.width + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), top - 1)
            rank = np.where((self.keys[at] == key) & (piece[:-1] == piece[1:]), self.rank[at], top)
            heads = np.flatnonzero(np.diff(piece, prepend=piece[0] - 1))
            lowest = np.minimum.reduceat(np.append(rank, top), heads)
            lens = np.diff(np.append(heads, len(ids)))
            mine = np.repeat(lowest, lens)
            over = mine == top
            if over.any():
                done_ids.append(ids[over])
                done_piece.append(piece[over])
                live = ~over
                ids, piece, rank, mine = ids[live], piece[live], np.append(rank, top)[live][:-1] if live.any() else rank[:0], mine[live]
                if not len(ids):
                    break
            hit = np.append(rank == mine[:-1], False)
            hit[:-1] &= piece[:-1] == piece[1:]
            spots = np.flatnonzero(hit)
            if len(spots) > 1:  # in a run of one symbol every other pair merges, from the left
                new_run = np.diff(spots, prepend=-2) != 1
                start = np.maximum.accumulate(np.where(new_run, np.arange(len(spots)), 0))
                spots = spots[(np.arange(len(spots)) - start) % 2 == 0]
            ids = ids.copy()
            ids[spots] = self.made[mine[spots]]
            keep = np.ones(len(ids), bool)
            keep[spots + 1] = False
            ids, piece = ids[keep], piece[keep]
        done_ids.append(ids)
        done_piece.append(piece)
        ids, piece = np.concatenate(done_ids), np.concatenate(done_piece)
        order = np.argsort(piece, kind="stable")
        return ids[order], piece[order]

    def runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs without white space, and each run's first one."""
        pieces: dict[str, int] = {}
        order, counts = [], np.zeros(len(runs), np.int64)
        for i, run in enumerate(runs):
            if not run.isascii():
                run = unicodedata.normalize("NFC", run)
            found = self.pattern.findall(lower_case(run))
            counts[i] = len(found)
            order += [pieces.setdefault(p, len(pieces)) for p in found]
        flat = [p.encode() for p in pieces]
        lens = np.fromiter(map(len, flat), np.int64, len(flat))
        raw = np.frombuffer(b"".join(flat), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lens) - 1
        symbols[ends] = self.last[raw[ends]]
        ids, piece = self.merge(symbols, np.repeat(np.arange(len(flat)), lens))
        first = np.searchsorted(piece, np.arange(len(flat) + 1))
        which = np.array(order, np.int64)
        out, lengths = gather(ids, first[which], first[which + 1] - first[which]) if len(which) else (ids[:0], which)
        total = np.concatenate([[0], np.cumsum(lengths)])
        cut = np.concatenate([[0], np.cumsum(counts)])
        return out.astype(np.uint32), total[cut]

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a slice, and each text's first one."""
        data, n = part.data, len(part.data)
        starts, stops, first = white_bounds(data, part.offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(part.n + 1, np.int64)
        keys, checks = (word_hashes(data, starts, stops, lane) for lane in range(2))
        where, back = distinct_words(keys, checks)
        raw = data.tobytes()

        def new(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found, cut = self.runs([raw[a:b].decode() for a, b in zip(starts[where[which]].tolist(), stops[where[which]].tolist(), strict=True)])
            return found, np.diff(cut)

        flat, begin, lens = self.met.ids(keys[where], checks[where], new)
        ids, sizes = gather(flat, begin[back], lens[back])
        total = np.concatenate([[0], np.cumsum(sizes)])[first]
        if any(s.encode() in raw for s in self.special):
            ids, total = self._with_special(part, ids, total)
        return ids, total

    def _with_special(self, part: Slice, ids: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with special strings are cut there and encoded piece by piece."""
        out = []
        for i in range(part.n):
            text = part.text(i).decode()
            if not self.special_at.search(text):
                out.append(ids[total[i] : total[i + 1]])
                continue
            own, at = [], 0
            for m in [*self.special_at.finditer(text), None]:
                runs = [r for r in _WHITE.split(text[at : m.start() if m else None]) if r]
                if runs:
                    own.append(self.runs(runs)[0])
                if m:
                    own.append(np.array([self.special[m[0]]], np.uint32))
                    at = m.end()
            out.append(np.concatenate(own))
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def decode(self, ids: np.ndarray) -> bytes:
        """The vocabulary entries joined by one space, which is what a file without decoder asks for."""
        return b" ".join(map(self.words.__getitem__, ids.tolist()))


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` one after the other."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return flat[np.arange(total) + np.repeat(starts - (ends - lens), lens)], lens


def white_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without Unicode white space, and each text's first run."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = (data != 0x20) & ((data < 9) | (data > 13))
    for lead, tails in ((0xC2, (b"\x85", b"\xa0")), (0xE1, (b"\x9a\x80",)), (0xE2, (*(b"\x80" + bytes([c]) for c in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f")), (0xE3, (b"\x80\x80",))):
        at = np.flatnonzero(data == lead)
        for tail in tails if len(at) else ():
            k = at[at + len(tail) < n]
            for d, c in enumerate(tail):
                k = k[data[k + 1 + d] == c]
            for d in range(len(tail) + 1):
                ink[k + d] = False
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins, ends = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1] | cut[1:n]
    ends[:-1] &= ~ink[1:] | cut[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


_encoders: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The tables for a tokenizer file's contents, built once in each worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def encode(docs: DataFrame, tokenizer_file: str, with_ids: bool = True, with_decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids and decoded of every row of ``docs``.

    tokenizer_file: read on the driver and sent with the tasks (a few MB, whatever the corpus).
    """
    docs = docs.select("doc_id", "text")
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer_file, encoding="utf-8").read())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(spec.value)
        for batch in batches:
            for part in slices(batch, size=SLICE_BYTES):
                ids, first = own.encode(part)
                rows = [ids[first[i] : first[i + 1]] for i in range(part.n)]
                decoded = [own.decode(r) for r in rows]
                arrays = [part.rows.column(0), pa.array(np.diff(first), pa.int64()), pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows], pa.string()), pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                if with_decoded:
                    arrays.append(pa.array(decoded, pa.binary()).cast(pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_decoded)
