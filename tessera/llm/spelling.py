"""Spelling variants: words one edit apart, found over their three rarest bigrams.

A single inserted, deleted or replaced code point destroys two of a word's
bigrams at most.  With all bigrams in one global order, rarest first, two words
that are near therefore share one of each other's first three, and its places
differ by one at most (1).  What is more, the edit lies on one side of that
bigram, so the other side is the same in both words, bigram included.

1. The words' bigrams are counted in 65,536 slots: a table of that size, at any
   vocabulary, is all that is collected and broadcast.  Bigrams are ordered by
   the count of their slot, then by their code points, then by their place.
2. Each word sends six rows, two for each of its three rarest bigrams: one with
   all that stands before it and one with all that stands after it, the bigram
   included.  Equal rows of two words mean the same bigram, and with lengths
   that differ by one at most also places that do.
3. Rows meet in an equi-join; lengths and letter masks are compared first, then
   an edit distance cut off at one decides.  All of that is the join's own
   condition, so pairs that fail are never rows, and a frequent bigram's bucket
   can be split by the adaptive skew join.

A word's form is its near word of largest n if that is at least ``lead`` times
its own; forms are followed to the last by doubling, a table for each round.  n
grows with each step, so there are no circles and few rounds.

Null and empty texts have no words.  Repeated rows count again, with or without
an id; rows without a doc_id are spelt with an empty one.  Words may be of any
length; they cost six times their length.  An empty table gives an empty one.
Further columns are left out.

(1) Of the bigrams that both words keep, take the first in the order of one
word.  Were its partner not among the other's first three, one of those three
would be kept as well and come before it in either order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.workspace import discard, materialise

#: A run of letters: ASCII and the Latin-1 supplement from U+00C0 on.
RUN = r"[A-Za-zÀ-ÿ]+"
RAREST = 3
SLOTS = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slipped(doc_id: Column, run: Column, one_in: int) -> Column:
    """The run, without one code point if ``one_in`` divides the crc32 of "doc_id:run"; h % length says which."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = 5, least: int = 3, one_in: int | None = None) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, of at least ``least_length`` code points that occur ``least`` times or more.

    one_in: lose a letter of one run in so many, as ``slipped`` has it.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    word = slipped(F.col("doc_id"), F.col("run"), one_in) if one_in else F.col("run")
    return runs.select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _bigrams(words: list[str]) -> tuple[np.ndarray, ...]:
    """Code points of all words, each word's first one, and of each bigram its word, its place there, its code points and its slot."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(lens) - lens
    row = np.repeat(np.arange(len(words)), lens)
    at = np.flatnonzero(row[1:] == row[:-1])
    content = codes[at] << 21 | codes[at + 1]
    return codes, first, row[at], at - first[row[at]], content, (codes[at] * 257 ^ codes[at + 1]) % SLOTS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        if batch.num_rows:
            total += np.bincount(_bigrams(batch.column(0).to_pylist())[5], minlength=SLOTS)
    slots = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total[slots])], ["slot", "n"])


def _rarest(counts):
    """(word, n, len, mask, side): each word with both sides of its rarest bigrams; mask has a bit for each letter, modulo 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 4096):
                batch = whole.slice(begin, 4096)
                words = batch.column(0).to_pylist()
                codes, first, row, place, content, slot = _bigrams(words)
                order = np.lexsort((place, content, counts.value[slot], row))
                head = np.searchsorted(row, np.arange(len(words)))  # rows rise, so the sorted ones begin where they did
                own = order[np.arange(len(order)) - head[row] < RAREST]
                who, where = row[own], place[own]
                sides = [side for w, p in zip(who.tolist(), where.tolist(), strict=True) for side in ("<" + words[w][: p + 2], ">" + words[w][p:])]
                mask = np.bitwise_or.reduceat(np.uint64(1) << (codes % 64).astype(np.uint64), first).view(np.int64)
                twice = np.repeat(who, 2)
                at = pa.array(twice)
                lens = np.diff(np.append(first, len(codes)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(lens[twice].astype(np.int32)), pa.array(mask[twice]), pa.array(sides, pa.string())], ["word", "n", "len", "mask", "side"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): all pairs of words, each once and a before b, that are exactly one edit apart.

    words: distinct ``word`` of four code points or more, so that each has three bigrams, and ``n``.
    """
    words = words.select("word", "n")
    counts = np.zeros(SLOTS, np.int64)
    for slot, n in words.mapInArrow(_counted, "slot int, n bigint").groupBy("slot").agg(F.sum("n")).collect():  # SLOTS rows at most
        counts[slot] = n
    known = words.sparkSession.sparkContext.broadcast(counts)
    sides = materialise(words.mapInArrow(_rarest(known), "word string, n bigint, len int, mask bigint, side string"), "word-sides")
    a, b = sides.alias("a"), sides.alias("b")
    like = (F.col("a.side") == F.col("b.side")) & (F.col("a.word") < F.col("b.word")) & (F.abs(F.col("a.len") - F.col("b.len")) <= 1)
    like &= F.bit_count(F.col("a.mask").bitwiseXOR(F.col("b.mask"))) <= 2
    met = a.join(b, like & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
    found = materialise(met.select(F.col("a.word").alias("a"), F.col("a.n").alias("an"), F.col("b.word").alias("b"), F.col("b.n").alias("bn")).distinct(), "near-words")
    discard(sides)
    return found


def roots(links: DataFrame) -> DataFrame:
    """(word, root): for links (word, form) without circles, where each word has one form at most, the last form reached."""
    now = materialise(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("k"), F.col("root").alias("next"))
        made = materialise(now.join(on, F.col("root") == F.col("k"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots", instead_of=(now,))
        if not made.where("moved").head(1):
            return made
        now = made


def variants(words: DataFrame, lead: float = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of ``words`` (word, n; words distinct, of four code points or more)."""
    words = materialise(words.select("word", F.col("n").cast("bigint").alias("n")), "words")
    pairs = near_words(words)
    side = lambda w, n, o, m: F.struct(F.col(w).alias("word"), F.col(n).alias("n"), F.col(o).alias("other"), F.col(m).alias("m"))
    both = pairs.select(F.explode(F.array(side("a", "an", "b", "bn"), side("b", "bn", "a", "an"))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    led = F.col("best.less") * -1 >= F.col("n") * lead
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(led, F.col("best.other")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n"))
    rows = materialise(rows, "word-forms", instead_of=(words, pairs))
    last = roots(rows.where("form is not null"))
    return rows.join(last.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
