"""Spelling variants against plain Python, and the odd cases."""

import random
import re
import zlib

import pytest
from conftest_llm import ODD, rows_of
from pyspark.sql import functions as F

from tessera.llm import spelling


def plain_words(docs, least_length=5, least=3, one_in=97):
    n = {}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if one_in and h % one_in == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] = n.get(run, 0) + 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least}


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(n):
    out, form = [], {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out.append((w, len(others)))
    rows = []
    for w, k in out:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], k, n[form[w]] if form[w] else None))
    return sorted(rows, key=str)


COLS = ("word", "form", "root", "n", "n_near", "form_n")


def edited(rng, w, letters):
    k = rng.randrange(len(w))
    return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])


@pytest.mark.parametrize("letters", ["ab", "abcdéü÷", "abcdefghijklmnop"])
def test_variants_equal_plain_python(spark, letters):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(60)}
    for _ in range(3):
        words |= {e for w in list(words) for e in [edited(rng, w, letters)] if len(e) >= 5}
    n = {w: rng.choice([3, 3, 4, 6, 7, 12, 30, 100]) for w in sorted(words)[:400]}
    df = spark.createDataFrame(list(n.items()), "word string, n bigint")
    assert rows_of(spelling.variants(df), *COLS) == plain_variants(n)


def test_counts_equal_plain_python(spark):
    rng = random.Random(5)
    texts = ["Straße straße STRASSE Àbcdé àbcdé naïve; naïve-naïve 12abcde34 " + " ".join(rng.choice(["letters", "letter", "Léttre", "aaaaaa", "a"]) for _ in range(400)) for _ in range(12)]
    docs = [(i if i else None, t) for i, t in enumerate(texts)] + [(3, None), (4, ""), (4, ""), (-7, "x" * 70_000), (8, "x" * 70_000), (9, "x" * 70_000)]
    got = spelling.word_counts(spark.createDataFrame(docs, "doc_id bigint, text string"), one_in=97)
    want = plain_words(docs)
    assert dict(rows_of(got, "word", "n")) == want
    assert any(len(w) == 70_000 for w in want)
    assert rows_of(spelling.variants(got), *COLS) == plain_variants(want)


def test_slips_take_the_stated_letter(spark):
    found = next(f"{i}:{w}" for i in range(3000) for w in ["häuser"] if zlib.crc32(f"{i}:{w}".encode()) % 97 == 0)
    i = int(found.split(":")[0])
    got = spelling.word_counts(spark.createDataFrame([(i, "Häuser " * 3)], "doc_id bigint, text string"), one_in=97)
    k = zlib.crc32(found.encode()) % 6
    assert rows_of(got, "word", "n") == [("häuser"[:k] + "häuser"[k + 1 :], 3)]


def test_a_long_chain_reaches_its_root(spark):
    words = ["b" * k + "a" * (40 - k) for k in range(25)]
    n = {w: 3 * 2**k for k, w in enumerate(words)}
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(list(n.items()), "word string, n bigint")).collect()}
    assert got == {w: (words[k + 1] if k < 24 else None, words[24]) for k, w in enumerate(words)}


def test_odd_rows_and_empty_tables(spark, odd, none):
    want = plain_words(ODD, least=1, one_in=None)
    assert dict(rows_of(spelling.word_counts(odd, least=1), "word", "n")) == want
    assert rows_of(spelling.variants(spelling.word_counts(odd, least=1).withColumn("form", F.lit("x"))), *COLS) == plain_variants(want)
    assert spelling.variants(spelling.word_counts(none)).count() == 0
