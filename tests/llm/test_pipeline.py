"""The pipeline against a brute-force version of every stage."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F
from test_passages import brute_exact, brute_near
from test_tokens import brute_plan, spoken

import corpus_pipeline
from tessera.llm import queries
from tessera.llm.queries import MIX_REPEATS, tokenizer_file

TOKENIZER_FILE = tokenizer_file()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(4)
    docs = [(i, t, lang, rng.choice(["hot"] * 5 + ["a", "b"]), len(t)) for i, t, lang in spoken(5, 120)]
    docs += [(200 + k, docs[k][1].replace(" ", "  "), docs[k][2], "a", 1) for k in range(15)]
    for k in range(12):
        w = [f"long{k % 3}w{j}" for j in range(80)]
        w[rng.randrange(80)] = f"edit{k}"
        docs.append((300 + k, " ".join(w), "en", "b", 1))
    return docs + [(400, None, None, "a", 0), (401, "12 !!", None, "a", 5), (402, "", "en", None, 0)]


def expected(docs):
    from tokenizers import Tokenizer

    docs = [d for d in docs if any(c.isalpha() for c in d[1] or "")]
    exact = {r[0] for r in brute_exact([(d[0], d[1]) for d in docs]) if r[0] == r[1]}
    docs = [d for d in docs if d[0] in exact]
    near = {r[0] for r in brute_near([(d[0], d[1]) for d in docs]) if r[3]}
    docs = [d for d in docs if d[0] in near]
    _, copies = brute_plan([(d[0], d[3], d[1]) for d in docs], repeats=MIX_REPEATS)
    tool = Tokenizer.from_file(TOKENIZER_FILE)
    out = []
    for d in docs:
        ids = tool.encode(d[1], add_special_tokens=False).ids
        out += [(d[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest())] * copies[d[0]]
    return Counter(out)


def test_run_against_brute_force(spark, tmp_path):
    docs = corpus()
    os.makedirs(f"{tmp_path}/sf")
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/sf/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/sf")
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == expected(docs)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(*d, "x", "y", "z") for d in corpus()], SCHEMA + ", kept string, at string, mix_id string")
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = stage(spark, spark.read.parquet(path), str(tmp_path))
        if name != "bpe":
            assert docs.columns == [*SCHEMA.replace(",", "").split()[::2], "kept", "at", "mix_id"]


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], SCHEMA)
    for k, docs in enumerate((rows, rows.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{k}{name}"
            docs.write.parquet(path)
            docs = stage(spark, spark.read.parquet(path), str(tmp_path))
        assert docs.count() == (0 if k else docs.count())


def test_documents_without_an_id_are_not_lost(spark, tmp_path):
    from tokenizers import Tokenizer

    unnamed = ["unnamed text", "quite another unnamed text", "ONE", "negative  id text here ok"]  # the last two equal texts with ids
    rows = [(i, t) for i, t in [*[(None, t) for t in unnamed], *ODD]]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    text = dict(ODD)
    want = [(None, t) for t in unnamed[:2]] + [(i, text[i]) for i in (-5, 4, 5, 7, 8, 10, 12)]
    near = corpus_pipeline.near(spark, corpus_pipeline.exact(spark, corpus_pipeline.language_id(spark, docs, ""), ""), "")
    assert Counter((r.doc_id, r.text) for r in near.collect()) == Counter(want)
    tool = Tokenizer.from_file(TOKENIZER_FILE)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(tool.encode(t, add_special_tokens=False).ids)) for i, t in want)


def test_rows_that_share_an_id_are_judged_one_by_one(spark, tmp_path):
    """Near copies and rows without tokens don't stay because another row of their id does."""
    base, other = ([f"{c}{k}" for k in range(60)] for c in "ab")
    rows = [(1, " ".join(base)), (5, " ".join(base) + " more"), (5, " ".join(other)), (6, " ".join(other) + " more"), (None, " ".join(base) + " again"), (6, "quite another text")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    near = corpus_pipeline.near(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in near.collect()) == Counter([rows[0], rows[2], rows[5]])
    docs = spark.createDataFrame([(1, "some words here", "en", "s", 1), (1, " ", "en", "s", 1), (1, None, "en", "s", 1), (2, "more words", "en", None, 1)], SCHEMA)
    assert {(r.doc_id, r.text) for r in corpus_pipeline.mix(spark, docs, "").collect()} == {(1, "some words here"), (2, "more words")}


def test_queries_and_sql_have_the_same_names():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 13))


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_language_query_on_held_out_rows(spark):
    got = queries.op8_langid(spark, SF).join(queries.documents(spark, SF).select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95
