"""Token ledger (1), language model (3), BPE (5), ORC ids (6), mixing (7) and language ID (8)."""

import hashlib
import math
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.orc as po
import pytest
from conftest_llm import ODD, TWINS, lowered, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, maxent_lm, mixing, orc_tokens, runs, token_counts
from tessera.llm import text as T
from tessera.llm.queries import tokenizer_file

TOKENIZER_FILE = tokenizer_file()

# --- 1


def test_ledger_adds_signed_batches_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "en", "x y z"), (2, "a", None, None), (3, None, "fr", "b  c"), (4, "a", "en", "")], "doc_id bigint, source string, lang string, text string")
    ledger = token_counts.Ledger(spark, f"{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    rows = token_counts.counted(docs, "words-1")
    assert ledger.commit("load", token_counts.inserts(rows))
    want = [("a", "en", "words-1", 2, 3), ("a", None, "words-1", 1, 0), (None, "fr", "words-1", 1, 2)]
    assert rows_of(ledger.totals(), "source", "lang", "tokenizer", "docs", "tokens") == sorted(want, key=str)
    assert not ledger.commit("load", token_counts.inserts(rows))  # a retry changes nothing
    assert rows_of(ledger.totals(), "source", "lang", "tokenizer", "docs", "tokens") == sorted(want, key=str)
    assert ledger.commit("out", token_counts.deletes(rows.where("doc_id = 3")))
    assert ledger.commit("again", token_counts.revisions(rows.where("doc_id = 1"), token_counts.counted(docs.where("doc_id = 1"), "bytes", F.length("text"))))
    want = [("a", "en", "words-1", 1, 0), ("a", None, "words-1", 1, 0), ("a", "en", "bytes", 1, 5)]
    assert rows_of(ledger.totals(), "source", "lang", "tokenizer", "docs", "tokens") == sorted(want, key=str)
    ledger.compact()
    assert rows_of(ledger.totals(), "source", "lang", "tokenizer", "docs", "tokens") == sorted(want, key=str)
    assert ledger.batches() == ["again", "load", "out"]
    assert not ledger.commit("out", token_counts.deletes(rows)) and ledger.commit("new", token_counts.inserts(rows.where("doc_id = 4")))
    assert dict((r.tokenizer, r.docs) for r in ledger.totals().where("lang = 'en'").collect()) == {"words-1": 2, "bytes": 1}
    with pytest.raises(ValueError):
        ledger.commit("../x", rows)


def test_a_batch_that_lands_while_others_are_folded_counts_once(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(k, "a", "en", "x " * n) for k in range(1)], "doc_id bigint, source string, lang string, text string")
    ledger, other = (token_counts.Ledger(spark, f"{tmp_path}/ledger") for _ in range(2))
    ledger.commit("one", token_counts.inserts(token_counts.counted(rows(1), "words-1")))
    inner = ledger._totals

    def late(*a):
        other.commit("two", token_counts.inserts(token_counts.counted(rows(100), "words-1")))
        return inner(*a)

    ledger._totals = late
    ledger.compact()
    ledger._totals = inner
    assert ledger.totals().first().tokens == 101 and ledger.batches() == ["one", "two"]
    ledger.compact()
    assert ledger.totals().first().tokens == 101 and ledger._listed()[0] == []


def test_of_two_commits_at_once_one_is_true(spark, tmp_path):
    rows = token_counts.inserts(token_counts.counted(spark.createDataFrame([(1, "a", "en", "x y")], "doc_id bigint, source string, lang string, text string"), "words-1"))
    one, two = (token_counts.Ledger(spark, f"{tmp_path}/ledger") for _ in range(2))
    two._listed = lambda: ([], None, set())  # looked before the other one was there
    assert one.commit("b", rows) and not two.commit("b", rows)
    assert one.totals().first().tokens == 2
    one.compact()
    assert two.commit("b", rows) and one.totals().first().tokens == 2  # a folded id counts once, whatever lands later


def test_ledger_of_odd_rows(odd, none, tmp_path):
    for df, n in ((odd, len(ODD)), (none, 0)):
        ledger = token_counts.Ledger(odd.sparkSession, f"{tmp_path}/{n}")
        ledger.commit("a", token_counts.inserts(token_counts.counted(df, "words-1")))
        got = ledger.totals().agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        assert tuple(got) == (n, sum(len((t or "").split()) for _, t in ODD) if n else 0)


# --- 3


def brute_base(docs):
    tok = [(i, [*lowered(t), None]) for i, t in docs]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    c = Counter(w for i, ws in tok if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((i, held[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6) + 0.0) for i, ws in tok), key=str)


def held7():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def test_model_counts_and_base_score(spark, odd, none):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["The", "of", "cat", f"rare{i}", f"w{rng.randint(0, 3000)}"]) for _ in range(rng.randint(0, 90)))) for i in range(120)]
    cols = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    for df, rows in ((spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), docs), (odd, ODD)):
        got = maxent_lm.score(df, held7()).withColumn("base_score", F.round("base_score", 6) + 0.0)
        assert rows_of(got, *cols) == brute_base(rows)
        assert got.where("score is null or isnan(score) or score > 0").count() == 0
    assert maxent_lm.score(none, held7()).count() == 0
    alone = maxent_lm.score(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), F.lit(True)).first()
    assert alone.train_tokens == 0 and alone.base_score == 0.0 and alone.score < 0


def some_weights(seed=0):
    rng = np.random.default_rng(seed)
    shape = maxent_lm.Shape(32, 2048)
    sums = np.stack([rng.integers(1, 50, shape.symbols), rng.integers(1, 5, shape.symbols)], 1)
    w = maxent_lm.Weights(shape, sums)
    w.tables = [rng.normal(0, 1, t.shape).astype(np.float32) for t in w.tables]
    return w


def test_model_probabilities_sum_to_one():
    w = some_weights()
    # every symbol after one and the same context: two symbols, then the one in question
    symbols = np.concatenate([[5, 1030, s] for s in range(w.shape.symbols)])
    p = 10 ** w.log10(symbols, np.arange(len(symbols)) % 3)[2::3]
    assert abs(p.sum() - 1) < 1e-4
    none = maxent_lm.Weights(w.shape, np.zeros((w.shape.symbols, 2), np.int64))
    p = 10 ** none.log10(np.arange(w.shape.symbols), np.zeros(w.shape.symbols, np.int64))
    assert abs(p[w.shape.head :].sum() - 1) < 1e-4 and p[: w.shape.head].max() < 1e-20


def test_model_sees_the_word_three_back_the_class_and_rare_words():
    w = some_weights(1)
    p = w.log10(np.array([5, 1, 2, 9, 700, 1, 2, 9]), np.arange(8) % 4)
    assert abs(p[3] - p[7]) > 1e-3
    context = maxent_lm.contexts(np.array([5, 1, 2, 9]), np.arange(4), slice(0, 4), w.shape.symbols)
    assert len(maxent_lm.class_features(w.shape, context)) == 4 and len(maxent_lm.member_features(w.shape, context, np.zeros(4, np.int64))) == 3
    a, b = w.shape.tail(np.array([1, 2], np.uint64), np.array([7, 7], np.uint16)).tolist()  # two rare words of one ending
    assert a != b and a // 32 == b // 32 and min(a, b) >= w.shape.head
    q = w.log10(np.array([3, a, 9, 3, b, 9]), np.arange(6) % 3)
    assert abs(q[1] - q[4]) > 1e-3 and abs(q[2] - q[5]) > 1e-3  # predicted apart, and seen apart as context


def test_model_grows_with_the_corpus():
    shapes = [maxent_lm.Shape.of(10**k, int(10 ** (0.7 * k)), 1 << 29) for k in range(4, 14)]
    assert all(x.rows < y.rows for x, y in zip(shapes[:7], shapes[1:8], strict=True))
    assert shapes[-1].side > shapes[3].side and all(4 * x.weights <= 1 << 29 for x in shapes)


def test_scores_do_not_depend_on_the_layout(spark):
    rng = random.Random(11)
    docs = [(i if i % 50 else None, " ".join(f"w{min(int(rng.expovariate(0.02)), 3000)}" for _ in range(300))) for i in range(1800)]
    own = [maxent_lm.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(n), F.crc32("text") % 7 == 2, most_bytes=1 << 18) for rows, n in ((docs, 2), (docs[::-1], 7))]
    assert maxent_lm.Shape.of(450_000, 300, 1 << 18).shards(450_000) > 1
    one, two = (rows_of(x, "doc_id", "n_tokens", "base_score", "score") for x in own)
    assert [x[:2] + x[3:] for x in one] == [x[:2] + x[3:] for x in two]
    assert len(one) == len(docs) and sum(x[0] is None for x in one) == 36


def brute_model(docs, held):
    """Scores by loops over single tokens, for a corpus of one shard in which every training word has a symbol of its own."""

    def hashed(word):
        data = np.frombuffer(word, np.uint8)
        return T.word_hashes(data, np.array([0]), np.array([len(data)]))[0]

    texts = {i: lowered(t) for i, t in docs}
    code = {w: hashed(w) for ws in texts.values() for w in ws}
    seq = {i: [*(code[w] for w in ws), maxent_lm.END] for i, ws in texts.items()}
    ends = {code[w]: (w[-1] << 8) + (w[-2] if len(w) > 1 else 0) for w in code} | {maxent_lm.END: 0}
    count = Counter(h for i, s in seq.items() if not held(i) for h in s)
    shape = maxent_lm.Shape.of(sum(count.values()), len(count), 1 << 29)
    side, rows, width = shape.side, shape.rows, 2 * shape.side
    assert len(count) <= shape.head and shape.shards(sum(count.values())) == 1
    symbol = {h: k for k, h in enumerate(sorted(count, key=lambda h: (-count[h], int(np.uint64(h).astype(np.int64)))))}
    symbol |= {h: int(shape.tail(np.array([h], np.uint64), np.array([e], np.uint16))[0]) for h, e in ends.items() if h not in count}
    total = np.zeros((width, side))
    for h, n in count.items():
        total[symbol[h] // side, symbol[h] % side] = n
    there = total > 0
    there[side:] = True
    by_class = np.where(there.any(1), total.sum(1) + 1, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        bias = np.where(there.any(1), np.log(by_class / by_class.sum()), -1e4)
        within = np.where(there, np.log((total + 0.5) / np.where(there, total + 0.5, 0).sum(1, keepdims=True)), -1e4)
    tables, size = [np.zeros((rows, width)), np.zeros((rows, side))], [np.full(rows, 0.1), np.full(rows, 0.1)]

    def row(x, salt):
        return ((x + (salt << 40)) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % rows

    def uses(s, k):
        """For both factors: the feature rows, the biases and what was chosen at place k."""
        one, two, three = (s[k - b] if k >= b else shape.symbols for b in (1, 2, 3))
        own = s[k] // side
        return [([row(x, j) for j, x in enumerate((one, two, one * (shape.symbols + 1) + two, three), 1)], bias, own), ([row(x, j) for j, x in enumerate((own, one * width + own, two * width + own), 5)], within[own], s[k] % side)]

    def chances(f, at, own):
        z = np.exp(np.clip(sum(tables[f][r] for r in at) + own, -80, 80))
        return z / z.sum()

    def deal(i):
        return int(T.mix(np.array([np.add.reduce(T.mix(np.array(seq[i], np.uint64)))], np.uint64) + T.mix(np.array([i], np.int64).astype(np.uint64), 1), 1)[0])

    places = {i: [symbol[h] for h in s] for i, s in seq.items()}
    for turn in range(maxent_lm.ROUNDS):
        tokens = [uses(places[i], k) for i in sorted(seq) if not held(i) and (deal(i) & 0xFFFFFFFF) % maxent_lm.ROUNDS == turn for k in range(len(places[i]))]
        before, steps = [t.copy() for t in tables], [x.copy() for x in size]
        for a in range(0, len(tokens), maxent_lm.BATCH):
            for f in range(2):
                batch = [t[f] for t in tokens[a : a + maxent_lm.BATCH]]
                push = []
                for at, own, y in batch:
                    p = chances(f, at, own)
                    p[y] -= 1
                    push.append(p)
                for j in range(len(batch[0][0])):
                    found: dict = {}
                    for (at, _, _), p in zip(batch, push, strict=True):
                        found.setdefault(at[j], []).append(p)
                    for r, ps in found.items():
                        g = sum(ps) / math.sqrt(len(ps))
                        size[f][r] = math.sqrt(size[f][r] ** 2 + (g @ g) * 4 / len(g))
                        tables[f][r] -= maxent_lm.RATE / len(batch[0][0]) * g / size[f][r]
        tables = [b + (t - b).astype(np.float16) for t, b in zip(tables, before, strict=True)]
        size = [b + (t - b).astype(np.float16) for t, b in zip(size, steps, strict=True)]
    # an unknown word has the whole of its bucket, in which nothing was learnt
    return {i: sum(math.log10(chances(f, at, own)[y]) for k in range(len(s)) for f, (at, own, y) in enumerate(uses(s, k))) for i, s in places.items()}


def test_model_against_loops_over_tokens(spark):
    rng = random.Random(21)
    docs = [(i, " ".join(f"{rng.choice('abcdefgh')}{min(int(rng.expovariate(0.3)), 40)}" for _ in range(rng.randint(0, 50))) + f" only{i}" * (i % 9 == 0)) for i in range(500)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want = brute_model(docs, held)
    for r in maxent_lm.score(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), held7()).collect():
        assert abs(r.score - want[r.doc_id]) < 0.01 + 1e-3 * r.n_tokens


def test_model_learns_what_follows(spark):
    rng = random.Random(1)
    follow = {w: [f"{w}{k}" for k in range(3)] for w in "abcdefgh"}
    docs = []
    for i in range(300):
        w = [x for _ in range(60) for a in [rng.choice("abcdefgh")] for x in (a, rng.choice(follow[a]))]
        docs.append((i, " ".join(w)))
    got = maxent_lm.score(spark.createDataFrame(docs, "doc_id bigint, text string"), held7()).where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.3  # log10 per token; the base sees no context


# --- 5 and 6

TEXTS = ["", None, "  ", "Hello, WORLD's it'S 123 ßtraße ÀÉ é x y z", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ ﬁ Å", "t\tn\nl\x0b\x0c\x85n\x1cf\x1d", "😀👍🏽 日本語", "a" * 5000, "'s'S'll we'LL'", "́start", "x　y", "١٢٣ ½ ²", "<|endoftext", "﻿bom ​z \x00n", "aaaa aaaaa", "한국어 각"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER_FILE)


def encoded(encode, texts):
    out = []
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    for part in T.slices(batch):
        ids, first = encode(part)
        out += [ids[first[i] : first[i + 1]].tolist() for i in range(part.n)]
    return out


def test_twin_words_have_their_own_ids(library):
    spec = open(TOKENIZER_FILE, encoding="utf-8").read()
    texts = [x for one, two in TWINS for x in (one, two, f"so {one} and {two}", f"so {two}")]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for own in (bpe.Encoder(spec), orc_tokens.LibraryEncoder(spec)):
        assert encoded(own.encode, texts) == want
        assert [x for t in texts for x in encoded(own.encode, [t])] == want


def test_runs_whose_hashes_meet_are_kept_apart(library, monkeypatch):
    spec = open(TOKENIZER_FILE, encoding="utf-8").read()
    texts = [" ".join(f"word{i * k % 97}" for k in range(50)) for i in range(40)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    weak = lambda d, a, b, lane=0: T.word_hashes(d, a, b, lane) & np.uint64(7 if lane == 0 else (1 << 64) - 1)
    for module, own in ((bpe, bpe.Encoder(spec)), (orc_tokens, orc_tokens.LibraryEncoder(spec))):
        monkeypatch.setattr(module, "word_hashes", weak)
        assert encoded(own.encode, texts) == want
        assert [x for t in texts for x in encoded(own.encode, [t])] == want


def test_both_encoders_match_the_library(library):
    spec = open(TOKENIZER_FILE, encoding="utf-8").read()
    want = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    own = bpe.encoder(spec)
    assert encoded(own.encode, TEXTS) == want
    assert encoded(orc_tokens.LibraryEncoder(spec).encode, TEXTS) == want
    plain = [t for t in TEXTS if "<|" not in (t or "")]
    assert encoded(orc_tokens.LibraryEncoder(spec).encode, plain) == [library.encode(t or "", add_special_tokens=False).ids for t in plain]
    assert [own.decode(np.array(w)).decode() for w in want] == [library.decode(w, skip_special_tokens=False) for w in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cn", "Cs", "Co"]), max_size=40), max_size=8))
def test_encoder_matches_the_library_on_any_text(texts):
    from tokenizers import Tokenizer

    spec = open(TOKENIZER_FILE, encoding="utf-8").read()
    tool = Tokenizer.from_str(spec)
    latin = ["".join(c for c in t if ord(c) < 0x2000) for t in texts]
    assert encoded(bpe.encoder(spec).encode, latin) == [tool.encode(t, add_special_tokens=False).ids for t in latin]


def test_long_runs_have_the_library_s_ids_and_take_seconds(library):
    own = bpe.encoder(open(TOKENIZER_FILE, encoding="utf-8").read())
    rng = random.Random(11)
    long = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (("abcdefghijklmnopqrstuvwxyz", 1_000_000), ("ab", 100_000), ("a", 99_999), ("éa日ß", 50_000), ("the in er an", 60_000))]
    for text in (x.replace(" ", "") for x in long):
        began = time.monotonic()
        assert own.runs([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert time.monotonic() - began < 60
    mixed = [x for k in range(20) for x in (f"word{k}", long[3][k * 400 : k * 400 + 300 + k], "short")]
    ids, cut = own.runs(mixed)
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)] == [library.encode(x, add_special_tokens=False).ids for x in mixed]


def test_memory_of_runs_may_be_small(library, monkeypatch):
    spec = open(TOKENIZER_FILE, encoding="utf-8").read()
    texts = [" ".join(f"word{i * k % 97}" for k in range(50)) for i in range(40)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(runs, "REMEMBERED", 90)
    monkeypatch.setattr(runs, "SMALL", 9)
    for own in (bpe.Encoder(spec), orc_tokens.LibraryEncoder(spec)):
        assert [x for t in texts for x in encoded(own.encode, [t])] == want


def test_encode_query_rows(odd, none, library):
    got = bpe.encode(odd, TOKENIZER_FILE)
    want = []
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert all(len(r.ids) == r.n_tokens for r in got.collect())
    assert bpe.encode(none, TOKENIZER_FILE).count() == 0


def test_orc_files(odd, none, library, tmp_path):
    spark = odd.sparkSession
    orc_tokens.write(odd, f"{tmp_path}/ids", TOKENIZER_FILE, end_id=1, files=3)
    want = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in ODD]
    got = [(r.doc_id, list(r.ids)) for r in orc_tokens.read(spark, f"{tmp_path}/ids").collect()]
    assert sorted(got) == sorted(want)
    names = sorted(f for f in os.listdir(f"{tmp_path}/ids") if f.endswith(".orc"))
    order = [i for f in names for i in po.ORCFile(f"{tmp_path}/ids/{f}").read(["doc_id"]).column(0).to_pylist()]
    assert order == sorted(i for i, _ in ODD)
    rows = sorted(orc_tokens.manifest(spark, f"{tmp_path}/ids").collect(), key=lambda r: r.start)
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    assert [r.doc_id for r in rows] == sorted(i for i, _ in ODD)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in orc_tokens.read(spark, f"{tmp_path}/ids").where("doc_id = 7")._jdf.queryExecution().toString()
    assert orc_tokens.read(spark, f"{tmp_path}/ids").where("doc_id = 7").count() == 1
    orc_tokens.write(none, f"{tmp_path}/none", TOKENIZER_FILE)
    assert orc_tokens.manifest(spark, f"{tmp_path}/none").count() == 0


def rows_read(df):
    """Rows that the scan of a plan gave, once it has run."""
    df._jdf.collectToPython()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_orc_metadata_prunes_and_stripes_are_read_alone(spark, tmp_path):
    docs = spark.range(60_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("word number "), "id").alias("text"))
    path = f"{tmp_path}/ids"
    orc_tokens.write(docs, path, TOKENIZER_FILE, files=2)
    read = lambda rule: orc_tokens.read(spark, path).where(rule).select("doc_id", "ids")
    assert rows_read(read("doc_id >= 0")) == 60_000
    assert 0 < rows_read(read("doc_id = 30000")) <= 10_000  # one row group of one file
    assert rows_read(read("doc_id > 119990")) <= 10_000
    absent = [rows_read(read(f"doc_id = {k}")) for k in (30_001, 50_001, 70_001, 90_001, 110_001)]  # within the range, so it is the Bloom filter
    assert absent.count(0) >= 4
    for f in sorted(f for f in os.listdir(path) if f.endswith(".orc")):
        file = po.ORCFile(f"{path}/{f}")
        assert file.compression == "ZSTD" and file.row_index_stride == 10_000
        each = [file.read_stripe(k).column("doc_id").to_pylist() for k in range(file.nstripes)]
        assert sum(each, []) == file.read(["doc_id"]).column(0).to_pylist()


def test_rows_of_one_id_start_in_the_order_of_the_file(spark, tmp_path, library):
    docs = [(k % 3, "x " * k) for k in range(60)] + [(None, "no id"), (None, "")]
    orc_tokens.write(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), f"{tmp_path}/ids", TOKENIZER_FILE, files=2)
    at, want = 0, []
    for f in sorted(f for f in os.listdir(f"{tmp_path}/ids") if f.endswith(".orc")):
        for i, ids in zip(*(c.to_pylist() for c in po.ORCFile(f"{tmp_path}/ids/{f}").read(["doc_id", "ids"]).columns), strict=True):
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    assert rows_of(orc_tokens.manifest(spark, f"{tmp_path}/ids"), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
    assert len(want) == len(docs)


def test_files_follow_the_size_of_the_input(odd, tmp_path, monkeypatch):
    monkeypatch.setattr(orc_tokens, "_stored_bytes", lambda docs: 6 * orc_tokens.FILE_BYTES - 1)
    asked = []
    inner = type(odd).repartitionByRange
    monkeypatch.setattr(type(odd), "repartitionByRange", lambda self, n, *c: asked.append(n) or inner(self, n, *c))
    orc_tokens.write(odd, f"{tmp_path}/ids", TOKENIZER_FILE)
    assert asked == [6]


# --- 7


def brute_plan(docs, entropy=None, repeats=None, share=1.0, seed=0):
    rows = [(i, s, len((t or "").split())) for i, s, t in docs]
    t = Counter()
    for _, s, n in rows:
        t[s] += n
    t = {s: n for s, n in t.items() if n}
    total = sum(t.values())
    p = {s: n / total for s, n in t.items()}

    def weights(k):
        m = {s: x ** (k / mixing.STEPS) for s, x in p.items()}
        return {s: x / sum(m.values()) for s, x in m.items()}

    def fine(k):
        w = weights(k)
        if entropy is not None:
            return len(w) < 2 or -sum(x * math.log(x) for x in w.values()) / math.log(len(w)) >= entropy
        return max(w[s] / p[s] for s in w) * share <= repeats

    ks = [k for k in range(mixing.STEPS + 1) if fine(k)]
    k = (max(ks) if entropy is not None else min(ks)) if ks else (0 if entropy is not None else mixing.STEPS)
    w, copies = weights(k), {}
    for s in t:
        budget = math.floor(w[s] * total * share)
        epochs, rest = divmod(budget, t[s])
        key = {i: hashlib.md5(f"{seed}:{epochs}:{i}".encode()).hexdigest() for i, s2, _ in rows if s2 == s}
        used = 0
        for i, n in sorted(((i, n) for i, s2, n in rows if s2 == s and n), key=lambda r: key[r[0]]):
            copies[i] = epochs + (used < rest)
            used += n
    return k, {i: copies.get(i, 0) for i, _, _ in rows}


@pytest.mark.parametrize("target", [{"repeats": 1.5}, {"repeats": 3.0, "share": 1.7}, {"entropy": 0.9}, {"entropy": 0.5}, {"repeats": 0.5}])
def test_mixing_against_brute_force(spark, target):
    rng = random.Random(7)
    docs = [(i, rng.choice(["big"] * 12 + ["mid"] * 3 + ["small", None]), " ".join("w" for _ in range(rng.randint(0, 40)))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").repartition(3)
    k, copies = brute_plan(docs, **target)
    own = {("budget_share" if a == "share" else a): b for a, b in target.items()}
    got = mixing.plan(df, **own).collect()
    assert {r.k for r in got} == {k}
    assert {r.doc_id: r.copies for r in got} == copies
    rows = Counter(r.doc_id for r in mixing.mixed(df, **own).collect())
    assert rows == Counter({i: n for i, n in copies.items() if n})


def test_schedule_is_a_permutation_of_blocks_in_each_epoch(spark):
    rng = random.Random(9)
    docs = [(i, rng.choice(["big"] * 9 + ["small"]), " ".join("w" for _ in range(rng.randint(0, 9)))) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").repartition(3)
    rows = mixing.schedule(df, repeats=3.0, budget_share=1.7, seed=5).collect()
    copies = {r.doc_id: r.copies for r in mixing.plan(df, repeats=3.0, budget_share=1.7, seed=5).collect()}
    assert Counter(r.doc_id for r in rows if r.epoch is not None) == Counter({i: n for i, n in copies.items() if n})
    assert {r.doc_id for r in rows if r.epoch is None} == {i for i, n in copies.items() if not n}
    by = {}
    for r in rows:
        if r.epoch is not None:
            key = hashlib.md5(f"5:{r.epoch}:{r.doc_id}".encode()).hexdigest()
            assert r.block == int(key[:3], 16)
            by.setdefault((r.source, r.epoch, r.block), []).append((key, r.position))
    assert all([p for _, p in sorted(own)] == list(range(len(own))) for own in by.values())
    orders = {e: [r.doc_id for r in sorted((r for r in rows if (r.source, r.epoch) == ("small", e)), key=lambda r: (r.block, r.position))] for e in (0, 1)}
    assert sorted(orders[0]) != orders[0] and orders[0][: len(orders[1])] != orders[1]  # each epoch has an order of its own


def test_mixed_rows_come_in_the_order_of_the_schedule(spark):
    docs = [(i, f"s{i % 3}", "w " * (i % 7 + 1)) for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").repartition(3)
    rows = mixing.mixed(df, repeats=3.0, budget_share=1.7, seed=5).withColumn("part", F.spark_partition_id()).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r.part, []).append(r.doc_id)
    drawn = {(r.doc_id, r.epoch): r.block for r in mixing.schedule(df, repeats=3.0, budget_share=1.7, seed=5).where("epoch is not null").collect()}
    key = lambda i, e: (e, hashlib.md5(f"5:{e}:{i}".encode()).hexdigest())
    for k in range(4):
        want = sorted((*key(i, e), i) for (i, e), block in drawn.items() if block * 4 // 4096 == k)
        assert parts[k] == [i for *_, i in want] and len(want) > 20


def test_mixing_of_odd_rows(odd, none):
    assert mixing.schedule(none, repeats=2.0).count() == 0
    assert mixing.schedule(odd, repeats=2.0).select("doc_id").distinct().count() == len({i for i, _ in ODD})
    assert mixing.plan(odd, repeats=2.0).count() == len(ODD)
    assert mixing.mixed(odd, repeats=2.0).columns == odd.columns
    assert mixing.plan(none, entropy=0.9).count() == 0 and mixing.mixed(none, entropy=0.9).count() == 0
    with pytest.raises(ValueError):
        mixing.plan(odd)


def test_mixing_has_no_python_in_its_plan(odd):
    text = mixing.schedule(odd, repeats=2.0)._jdf.queryExecution().toString()
    assert "Python" not in text and "MapIn" not in text


# --- 8

VOCAB = {"en": "the and of to in that is was for with house water", "de": "der die und nicht das ist ein mit haus wasser über für", "fr": "le la les et des est une dans avec maison eau être", "es": "el los las y que una con casa agua niño está señor"}


def spoken(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(VOCAB[lang].split()) for _ in range(rng.randint(3, 30))), lang) for i in range(n) for lang in [rng.choice(list(VOCAB))]]


def test_languages_of_held_out_rows(spark):
    docs = spark.createDataFrame(spoken(1, 600), "doc_id bigint, text string, lang string")
    model = langid.fit(docs.where(langid.learnt()))
    assert sorted(map(sorted, model.families)) == [["de", "en"], ["es", "fr"]] and sorted(model.pairs) == [("de", "en"), ("es", "fr")]
    got = langid.predict(docs, model).join(docs, "doc_id").where(~langid.learnt())
    assert got.count() > 100 and got.where("lang = lang_pred").count() >= 0.97 * got.count()
    assert got.where("score <= 0 or score > 1").count() == 0
    # neither the label nor other columns matter for a prediction
    again = langid.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("fr")), model)
    assert rows_of(again, "doc_id", "lang_pred", "score") == rows_of(langid.predict(docs, model), "doc_id", "lang_pred", "score")


def test_languages_of_odd_rows(odd, none, spark):
    docs = spark.createDataFrame(spoken(2, 200), "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (13, "und")} <= got
    assert all(lang != "und" for i, lang in got if i in (4, 5, 7, 8, 12))
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 4
    assert langid.predict(none, model).count() == 0 and langid.accepted(none, model).count() == 0
    assert langid.fit(none) is None and langid.fit(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {(r.lang_pred, r.score) for r in langid.predict(odd, None).collect()} == {("und", 0.0)}
    one = langid.fit(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in langid.predict(odd.where("doc_id = 5"), one).collect()} == {"de"}
    rare = langid.fit(docs.withColumn("lang", F.when(F.col("lang") == "de", "qq").otherwise(F.col("lang"))))
    assert ["qq"] in rare.families


def plain_language(model, text):
    """Prediction of one text from lists of its bytes, by the definition of the two steps."""
    form = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()]
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    grams = []
    for n in range(3):
        for k in range(len(form) - n):
            code = 0
            for b in form[k : k + n + 1]:
                code = (code * 256 + b) % 2**32
            grams.append((code + n * 0x01000193) % 2**32 * 0x9E3779B1 % 2**32 >> (32 - langid.BITS))
    share = Counter(grams)
    margin = [sum(model.weights[g, k] * n for g, n in share.items()) / len(grams) + model.bias[k] for k in range(len(model.bias))]
    fam = margin[: len(model.families)]
    best = fam.index(max(fam))
    score = math.exp(3 * fam[best]) / sum(math.exp(3 * m) for m in fam)
    langs = model.families[best]
    if len(langs) == 1:
        return langs[0], score
    vote, sums, sure = ({x: 0.0 for x in langs} for _ in range(3))
    for k, (a, b) in enumerate(model.pairs):
        if a in langs:
            m = margin[len(model.families) + k]
            vote[a if m >= 0 else b] += 1
            for x, own in ((a, m), (b, -m)):
                sums[x] += math.tanh(own)
                sure[x] -= math.log1p(math.exp(-3 * own))
    pick = max(langs, key=lambda x: vote[x] + 1e-3 * sums[x])
    return pick, score * math.exp(sure[pick]) / sum(math.exp(v) for v in sure.values())


def test_languages_against_one_text_at_a_time(spark, odd):
    docs = spark.createDataFrame(spoken(6, 300) + [(900 + k, t, None) for k, t in enumerate(["a", "ß!", "日本", "12", "The HOUSE"])], "doc_id bigint, text string, lang string")
    extra = docs.withColumn("lang", F.when(F.col("doc_id") % 11 == 0, "nl").otherwise(F.col("lang")))  # three languages in a family
    model = langid.fit(extra)
    assert max(map(len, model.families)) == 3
    for df in (docs, odd.where("length(text) < 10000 or text is null")):
        text = {r.doc_id: r.text for r in df.collect()}
        for r in langid.predict(df, model).collect():
            lang, score = plain_language(model, text[r.doc_id])
            assert r.lang_pred == lang and abs(r.score - score) < 1e-4
