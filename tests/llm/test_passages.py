"""Repeated passages (2), SetSketch near duplicates (9), exact duplicates (10), against brute force."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ODD, TWINS, rows_of, same_crc, words

from tessera.llm import exact_dedup, setsketch, substring_dedup
from tessera.llm import text as T


def brute_passages(docs, size):
    tokens = [words(t) for _, t in docs]
    seen = Counter(tuple(w[i : i + size]) for w in tokens for i in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(docs, tokens, strict=True):
        gone = set()
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone.update(range(k, k + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made_docs(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(60)]
    docs = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.4:
            at = rng.randint(0, len(w))
            cut = rng.randint(0, 30)
            w[at:at] = passage[cut : cut + rng.randint(10, 60)]
        if rng.random() < 0.1:
            w = ["same"] * rng.randint(30, 80)
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    docs += [(n + k, docs[k][1]) for k in range(5)]
    return docs


@pytest.mark.parametrize("size,bits", [(35, 28), (5, 20), (1, 17), (20, 16)])
def test_passages_against_brute_force(spark, size, bits):
    docs = made_docs(size)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = substring_dedup.remove_repeats(df, size, bits)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_passages(docs, size)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got.collect())


def test_passages_of_odd_rows(odd, none):
    got = substring_dedup.remove_repeats(odd, 35)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_passages(ODD, 35)
    assert substring_dedup.remove_repeats(none, 35).count() == 0


def test_passages_tell_twin_words_apart(spark):
    for one, two in TWINS:
        rest = " ".join(f"w{k}" for k in range(34))
        docs = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"x {one} {rest}")]
        got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string"), 35, 16)
        assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_passages(docs, 35)
        assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 35, 2: 0, 3: 35}


@pytest.mark.parametrize("ident", [1, None])
def test_passages_of_rows_with_one_id_and_one_checksum(spark, ident):
    """Texts of one id (or none) that a crc32 takes for one: places found in one aren't cut from the other."""
    x, y = same_crc(" ".join(f"x{k}" for k in range(60)), " ".join(f"y{k}" for k in range(60)))
    docs = [(ident, x), (ident, y), (3, " ".join(f"x{k}" for k in range(20, 60)))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2), 35)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_passages(docs, 35)


def test_the_sketch_has_a_bounded_size(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(3000))) for i in range(40)] * 2
    sketch = substring_dedup.count_min(spark.createDataFrame(docs, "doc_id bigint, text string"), 35, 18)
    assert 0 < sum(len(c) for _, c, _ in sketch["blocks"]) <= 2 * 2**18 // 8


def test_a_full_sketch_loses_nothing(spark):
    docs = [(i, " ".join(f"d{i}w{k}" for k in range(400))) for i in range(40)] + [(99, " ".join(f"d7w{k}" for k in range(100, 200)))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows_of(substring_dedup.remove_repeats(df, 35, 16), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_passages(docs, 35)


def test_equal_windows_have_equal_anchors_at_different_places():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 4, 3000).astype(np.uint64)
    first = np.array([0, 1000, 1000, 3000])
    starts, value, place = substring_dedup.anchors(T.mix(w), first, 9)
    by = {}
    for s, v, p in zip(starts.tolist(), value.tolist(), place.tolist(), strict=True):
        by.setdefault(tuple(w[s : s + 9].tolist()), []).append((v, p))
    for same in by.values():
        assert len({v for v, _ in same}) == 1
        assert len({p for _, p in same}) == len(same)


def brute_near(docs, size=5, percent=75):
    sets = {}
    for i, t in docs:
        w = [x for x in (t or "").encode().lower().split()]
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted(((i, len(sets[i]), root(i), root(i) == i) for i, _ in docs), key=str)


def near_docs(seed):
    rng = random.Random(seed)
    docs = []
    for g in range(12):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 200))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
            docs.append((len(docs) * 3 - 7, " ".join(w).upper() if rng.random() < 0.3 else "  ".join(w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, seed):
    docs = near_docs(seed)
    got = setsketch.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == brute_near(docs)


def test_near_duplicates_of_odd_rows(odd, none):
    got = setsketch.near_duplicates(odd)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == brute_near(ODD)
    assert setsketch.near_duplicates(none).count() == 0


def test_near_duplicates_tell_twin_words_apart(spark):
    docs = [(k, t) for k, t in enumerate(x for one, two in TWINS for x in (one, two, f"{one} a b c d e", f"{two} a b c d e", f"A {one}", f"a {one}"))]
    got = setsketch.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == brute_near(docs)


def test_rows_of_one_id_have_their_own_links(spark):
    base = [f"w{k}" for k in range(60)]
    other = [f"x{k}" for k in range(60)]
    near = lambda w: " ".join([*w[:-1], "new"])
    docs = [(1, " ".join(base)), (1, " ".join(other)), (3, near(other)), (4, near(base)), (5, "alone here"), (None, near(base) + " more"), (None, "nothing like it"), (1, "alone too")]
    got = setsketch.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))
    want = [(1, 1, True), (1, 1, True), (3, 1, False), (4, 1, False), (5, 5, True), (None, 1, False), (None, None, True), (1, 1, True)]
    assert rows_of(got, "doc_id", "component_id", "kept") == sorted(want, key=str)


@pytest.mark.parametrize("ident", [1, None])
def test_near_duplicates_of_rows_with_one_id_and_one_checksum(spark, ident):
    x, y = same_crc(" ".join(f"x{k}" for k in range(60)), " ".join(f"y{k}" for k in range(60)))
    docs = [(ident, x), (ident, y), (4, y + " more"), (5, x + " more")]
    got = setsketch.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2))
    low = [ident, ident] if ident else [5, 4]
    assert rows_of(got, "doc_id", "component_id") == sorted([(ident, low[0]), (ident, low[1]), (4, low[1]), (5, low[0])], key=str)


def test_a_large_component_meets_only_the_rest(spark, monkeypatch):
    """Two groups that share buckets, one of them large, with the links between them found whatever the block."""
    inner = setsketch._across
    monkeypatch.setattr(setsketch, "_across", lambda *a: inner(*a, block=4, cell=3))
    rng = random.Random(12)
    base = [f"w{k}" for k in range(120)]
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(i // 12):
            w[rng.randrange(120)] = f"n{rng.random()}"
        docs.append((i, " ".join(w)))
    got = setsketch.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == brute_near(docs)


def test_pairs_across_blocks_are_found(spark, monkeypatch):
    """Small blocks and cells: the search across components must not depend on them."""
    inner = setsketch._across
    monkeypatch.setattr(setsketch, "_across", lambda *a: inner(*a, block=3, cell=2))
    docs = near_docs(3)
    got = setsketch.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == brute_near(docs)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 63, 900, dtype=np.uint64), rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    ra, rb, rab = (setsketch.registers(x, np.array([0, len(x)]))[0] for x in (a, b, np.concatenate([a, b])))
    assert (np.maximum(ra, rb) == rab).all()
    # sets of 900 and 1200 that share 900: similarity 0.75
    more, less = (ra > rab).sum(), (ra < rab).sum()
    j = np.linspace(0.01, 0.75, 75)
    best = j[setsketch.log_likelihood(more, less, setsketch.REGISTERS - more - less, 900 / 2100, j).argmax()]
    assert abs(best - 0.75) < 0.1
    assert setsketch.may_reach(ra[None], rab[None], np.array([900.0]), np.array([1200.0]), 0.75)[0]
    assert not setsketch.may_reach(ra[None], rb[None], np.array([900.0]), np.array([300.0]), 0.75)[0]


def brute_exact(docs):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in docs]
    size, least = Counter(t for _, t in norm), {}
    for i, t in norm:
        least[t] = min(least.get(t, i), i)
    return sorted(((i, least[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=str)


@pytest.mark.parametrize("bits", [256, 64, 2])
def test_exact_duplicates_with_short_digests(spark, tmp_path, bits):
    docs = [(i * 7 % 50 - 3, t) for i, t in enumerate(["a b", "a  b", "a\tb", "c", "", " ", None, "ä", "A b", "d" * 4000] * 5)]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    got = exact_dedup.duplicates(spark, f"{tmp_path}/docs", digest_bits=bits)
    assert rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256") == brute_exact(docs)
    assert got.where("kept").count() == len({r[3] for r in brute_exact(docs)})
    assert got.where("kept and doc_id <> keep_id").count() == 0


def test_exact_duplicates_of_odd_rows(odd, none, tmp_path):
    odd.write.parquet(f"{tmp_path}/odd")
    got = exact_dedup.duplicates(odd.sparkSession, f"{tmp_path}/odd")
    assert rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256") == brute_exact(ODD)
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len({r[3] for r in brute_exact(ODD)})
    assert exact_dedup.deduplicate(none).count() == 0


def test_the_stream_goes_on_from_its_state(spark, tmp_path):
    """State outlives the stream: files that come later are judged against all earlier ones, and each file is read once."""
    path, state = f"{tmp_path}/in", f"{tmp_path}/state"
    schema = "doc_id bigint, text string"
    spark.createDataFrame([(5, "a b"), (6, "c")], schema).repartition(2).write.parquet(path)
    exact_dedup.absorb(spark, path, state, files_per_batch=1)
    spark.createDataFrame([(2, "a  b"), (9, "c"), (1, "new")], schema).coalesce(1).write.mode("append").parquet(path)
    exact_dedup.absorb(spark, path, state, files_per_batch=1)
    exact_dedup.absorb(spark, path, state)
    held = sorted((r["first"].doc_id, r.n) for r in exact_dedup.held(spark, state).collect())
    assert held == [(1, 1), (2, 2), (6, 2)]
    got = exact_dedup.duplicates(spark, path, state)
    assert rows_of(got, "doc_id", "keep_id", "group_size") == sorted([(5, 2, 2), (2, 2, 2), (6, 6, 2), (9, 6, 2), (1, 1, 1)], key=str)


def test_the_stream_reads_old_files_and_misses_none(spark, tmp_path, monkeypatch):
    path, state = f"{tmp_path}/in", f"{tmp_path}/state"
    schema = "doc_id bigint, text string"
    spark.createDataFrame([(5, "a b")], schema).coalesce(1).write.parquet(path)
    exact_dedup.absorb(spark, path, state)
    before = set(os.listdir(path))
    spark.createDataFrame([(2, "a  b"), (1, "new")], schema).coalesce(1).write.mode("append").parquet(path)
    for name in set(os.listdir(path)) - before:
        os.utime(f"{path}/{name}", (0, 10**9))
    got = exact_dedup.duplicates(spark, path, state)
    assert rows_of(got, "doc_id", "keep_id", "group_size") == sorted([(5, 2, 2), (2, 2, 2), (1, 1, 1)], key=str)
    spark.createDataFrame([(7, "later")], schema).coalesce(1).write.mode("append").parquet(path)
    monkeypatch.setattr(exact_dedup, "absorb", lambda *a: None)
    with pytest.raises(Exception, match="missing from the state"):
        exact_dedup.duplicates(spark, path, state)


def test_word_hashes_ignore_place_and_slices_cut_anywhere():
    texts = [t for _, t in ODD]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    for size in (1, 100, 1 << 22):
        found = []
        for part in T.slices(batch, size=size):
            h, _, _, first = T.words_of(part, True)
            found += [h[first[i] : first[i + 1]].tolist() for i in range(part.n)]
        want = {}
        for text, own in zip(texts, found, strict=True):
            tokens = (text or "").encode().lower().split()
            assert len(tokens) == len(own)
            for w, x in zip(tokens, own, strict=True):
                assert want.setdefault(w, x) == x
        assert len(set(want.values())) == len(want)


def test_hashes_are_of_the_bytes_and_lanes_are_independent():
    def hashes(words, lane=0):
        data = np.frombuffer(b" ".join(w.encode() for w in words), np.uint8)
        starts, stops, first = T.word_bounds(data, np.array([0, len(data)]))
        return T.word_hashes(data, starts, stops, lane)

    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(5000)} | {w for pair in TWINS for w in pair} | {"a" * k for k in range(1, 200)})
    for lane in range(2):
        own = hashes(words, lane)
        assert len(np.unique(own)) == len(words)
        assert (own[::-1] == hashes(words[::-1], lane)).all()
        assert len(np.unique(own >> np.uint64(44))) > 0.9 * len(words)
    assert len(np.unique(hashes(words) ^ hashes(words, 1))) == len(words)


def test_grams_tell_every_order_apart():
    w = T.mix(np.arange(2, dtype=np.uint64))[np.array([bin(i).count("1") % 2 for i in range(4096)])]
    for size in (1, 2, 3, 5, 17, 35, 1024):
        h, whole = T.gram_hashes(w, np.array([0, len(w)]), size)
        want = {}
        for i in np.flatnonzero(whole).tolist():
            assert want.setdefault(w[i : i + size].tobytes(), h[i]) == h[i]
        assert whole.sum() == len(w) - size + 1 and len(set(want.values())) == len(want)


def test_words_that_share_a_hash_are_kept_apart():
    hashes, checks = np.array([5, 3, 5, 5, 3], np.uint64), np.array([1, 1, 2, 1, 1], np.uint64)
    where, back = T.distinct_words(hashes, checks)
    assert len(where) == 3 and (hashes[where][back] == hashes).all() and (checks[where][back] == checks).all()
