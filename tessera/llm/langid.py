"""Language identification in two steps: family, then one against one.

Features are hashed byte 1- to 3-grams of the whole text (A-Z in lower case,
every byte that is neither a letter nor part of a multi-byte character a space),
as shares of the text's n-grams.  Linear support vector machines, one for each
family against the rest, choose the family; within it, one machine for each pair
of languages votes, and summed margins break ties.  All decision functions are
linear in the shares, so a text is scored by one table look-up per n-gram, in
flat arrays, and no text is ever cut short.

Machines are fitted on the driver from at most about ``per_language`` labelled
rows of each language (``most`` in all), drawn by a hash of doc_id: that bound, documented here,
is the only sampling, and counts and predictions cover all rows.

A null text, or one without a letter, is ``und`` with score 0; so is every row
if there is nothing to learn from.  Rows without a label teach nothing.  A
language of no listed family is a family of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import slices

# ISO 639-1 codes by language family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt ro wa",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "celtic": "br cy ga gd gv kw",
    "baltic": "lt lv",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt ug uz",
    "indo-aryan": "as bn gu hi mr ne or pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt ti",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

#: Bytes of text at once: some hundred bytes of arrays for each.
SLICE = 1 << 20
BITS = 12
SIZE = 1 << BITS
UNKNOWN = "und"
_FORM = np.full(256, 32, np.uint8)
_FORM[97:123] = np.arange(97, 123)
_FORM[65:91] = np.arange(97, 123)
_FORM[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order 1 to 3: the features of a slice in order, and each text's first one."""
    form = _FORM[data].astype(np.uint32)
    code, out, firsts = np.zeros(len(form), np.uint32), [], []
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(len(form))
    with np.errstate(over="ignore"):
        for order in range(3):
            code = code[: len(form) - order] * np.uint32(256) + form[order:] if order else form.copy()
            whole = at[: len(code)] + order < row_end[: len(code)]
            h = (code[whole] + np.uint32(order * 0x01000193)) * np.uint32(0x9E3779B1)
            out.append((h >> np.uint32(32 - BITS)).astype(np.int64))
            firsts.append(np.searchsorted(np.flatnonzero(whole), offsets))
    return out, firsts


def _row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first) - 1, values.shape[1]))
    full = np.diff(first) > 0
    if full.any():
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0)
    return out


def has_letter(part) -> np.ndarray:
    """Which texts of a slice hold a letter, ASCII or other."""
    form = _FORM[part.data]
    total = np.concatenate([[0], np.cumsum((form != 32) & (form < 128))])[part.offsets]
    found = np.diff(total) > 0
    for i in np.flatnonzero(~found):
        text = part.text(i)
        if not text.isascii():
            found[i] = any(c.isalpha() for c in text.decode("utf-8", "replace"))
    return found


@dataclass
class Model:
    """Languages by family, and a column of weights for each family and each pair within one."""

    families: list[list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        n_fam = len(self.families)
        fam = margins[:, :n_fam]
        best = fam.argmax(1) if n_fam > 1 else np.zeros(len(margins), np.int64)
        e = np.exp(3 * (fam - fam.max(1, keepdims=True)))
        score = e[np.arange(len(best)), best] / e.sum(1)
        names: list[str] = [""] * len(best)
        for f, langs in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            if len(langs) == 1 or not len(rows):
                for i in rows:
                    names[i] = langs[0]
                continue
            votes, sums, sure = (np.zeros((len(rows), len(langs))) for _ in range(3))
            for k, (a, b) in enumerate(self.pairs):
                if a in langs:
                    m = margins[rows, n_fam + k]
                    for lang, own in ((a, m), (b, -m)):
                        j = langs.index(lang)
                        votes[:, j] += own >= 0 if lang == a else own > 0
                        sums[:, j] += np.tanh(own)
                        sure[:, j] += -np.logaddexp(0, -3 * own)
            pick = (votes + 1e-3 * sums).argmax(1)
            p = np.exp(sure - sure.max(1, keepdims=True))
            score[rows] *= p[np.arange(len(rows)), pick] / p.sum(1)
            for i, j in zip(rows, pick, strict=True):
                names[i] = langs[j]
        return names, np.clip(score, 0.0, 1.0)


def _machine(x: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, classes weighted alike; y is +1 or -1."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    pw, pb = w.copy(), b
    step = 1.0 / (2 * float(weight @ np.einsum("ij,ij->i", x, x)) + 2 * ridge + 2)
    for t in range(rounds):
        vw, vb = w + (t / (t + 3)) * (w - pw), b + (t / (t + 3)) * (b - pb)
        slack = np.maximum(0, 1 - y * (x @ vw + vb)).astype(np.float32)
        pull = weight * slack * y
        pw, pb = w, b
        w = vw + step * (2 * (pull @ x) - 2 * ridge * vw)
        b = vb + step * 2 * float(pull.sum())
    return w, b


def learnt(label: str = "lang") -> Column:
    """Rows that may teach: crc32 of the id as text, modulo 4, is not 2."""
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2) & F.col(label).isNotNull()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, features, counts): the sparse counts of each text."""
    for batch in batches:
        for part in slices(batch, size=SLICE):
            found, firsts = grams(part.data, part.offsets)
            ids, counts = [], []
            for i in range(part.n):
                own = np.concatenate([f[a[i] : a[i + 1]] for f, a in zip(found, firsts, strict=True)])
                count = np.bincount(own, minlength=SIZE)
                at = np.flatnonzero(count)
                ids.append(at.astype(np.uint16).tobytes())
                counts.append(count[at].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([part.rows.column(0), part.rows.column(2), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "lang", "features", "counts"])


def fit(docs: DataFrame, per_language: int = 1000, most: int = 16_000) -> Model | None:
    """The model from rows with doc_id, text and lang; None if no row has both text and label.

    About ``per_language`` rows of each language teach, and about ``most`` in all, which bounds the driver's memory.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    usable = docs.where("lang is not null and length(text) > 0").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    per_language = min(per_language, max(1, most // len(sizes)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20))
    few = F.create_map(*(F.lit(x) for k, n in sorted(sizes.items()) for x in (k, max(1, int(per_language / max(n, per_language) * (1 << 20))))))
    rows = usable.where(draw < few[F.col("lang")]).mapInArrow(_features, f"doc_id {kind}, lang string, features binary, counts binary").toArrow().sort_by([("doc_id", "ascending"), ("features", "ascending")])
    langs = np.array(rows.column("lang").to_pylist())
    x = np.zeros((rows.num_rows, SIZE), np.float32)
    for i, (f, c) in enumerate(zip(rows.column("features").to_pylist(), rows.column("counts").to_pylist(), strict=True)):
        c = np.frombuffer(c, np.uint32)
        x[i, np.frombuffer(f, np.uint16)] = c / c.sum()
    scale = 1.0 / np.sqrt(x.mean(0) + 1e-7)
    x *= scale.astype(np.float32)
    by: dict[str, list[str]] = {}
    for lang in sorted(set(langs.tolist())):
        by.setdefault(_FAMILY.get(lang, f"own:{lang}"), []).append(lang)
    families = [by[k] for k in sorted(by)]
    pairs = [p for own in families for p in combinations(own, 2)]
    columns, bias = [], []
    for own in families:
        w, b = _machine(x, np.where(np.isin(langs, own), 1.0, -1.0).astype(np.float32))
        columns.append(w)
        bias.append(b)
    for a, b in pairs:
        mine = np.isin(langs, [a, b])
        w, c = _machine(x[mine], np.where(langs[mine] == a, 1.0, -1.0).astype(np.float32))
        columns.append(w)
        bias.append(c)
    return Model(families, pairs, (np.stack(columns, 1) * scale[:, None]).astype(np.float32), np.array(bias))


def _judged(model: Model | None, part) -> tuple[list[str], np.ndarray]:
    """Predicted language and score of each text of a slice."""
    if model is None:
        return [UNKNOWN] * part.n, np.zeros(part.n)
    found, firsts = grams(part.data, part.offsets)
    sums = sum(_row_sums(model.weights[f], a) for f, a in zip(found, firsts, strict=True))
    n = sum(np.diff(a) for a in firsts)
    guess, sure = model.predict(sums / np.maximum(n, 1)[:, None] + model.bias)
    ok = has_letter(part)
    return [g if o else UNKNOWN for g, o in zip(guess, ok, strict=True)], np.where(ok, sure, 0.0)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that have a language, with all their columns; with no model, those that have a letter."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE):
                keep = has_letter(part) if sent.value is None else np.array(_judged(sent.value, part)[0]) != UNKNOWN
                yield part.rows.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``; only doc_id and text are read."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE):
                names, score = _judged(sent.value, part)
                yield pa.RecordBatch.from_arrays([part.rows.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
