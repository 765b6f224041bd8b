"""The driver's contract, and every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = __import__("tessera.queries", fromlist=["queries"])


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(OWN.queries()))
def test_query_matches_sql(spark, duck, name):
    df = OWN.queries()[name](spark, SF)
    cols = sorted(df.columns)
    near = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    if name not in OWN.oracle_sql():
        return
    con = duck.execute(OWN.oracle_sql()[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in con.fetchall()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: _key(map(near, r))), sorted(want, key=lambda r: _key(map(near, r))), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and abs(x - y) <= 2e-5 * max(1, abs(y))
