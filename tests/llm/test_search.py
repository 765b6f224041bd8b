"""Exact top-k search against all scores in numpy, and the odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import topk_search


def plain(rows, k, asks):
    """rows: (vec_id, integer vector); all scores in Python integers."""
    out = []
    for i, (q, v) in enumerate(rows):
        if not asks(q):
            continue
        scores = [(-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), c is None, c, j) for j, (c, w) in enumerate(rows) if j != i and len(w) == len(v)]
        best = sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0, x[3]))[:k]
        out += [(q, r + 1, c, -s) for r, (s, _, c, _) in enumerate(best)]
    return sorted(out, key=str)


def found(spark, rows, k, asks):
    df = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in rows], "vec_id bigint, v array<bigint>")
    return sorted((tuple(r) for r in topk_search.top_k(df, asks, k).collect()), key=str)


@pytest.mark.parametrize(("dims", "spread", "blocks"), [(64, 40, 1 << 10), (7, 3, 16), (1, 2, 16), (64, 1 << 27, 64)])
def test_equals_all_scores(spark, monkeypatch, dims, spread, blocks):
    monkeypatch.setattr(topk_search, "LEAST_BLOCK", blocks)
    rng = np.random.default_rng(dims)
    centres = rng.integers(-spread, spread + 1, (9, dims))
    v = centres[rng.integers(0, 9, 500)] + rng.integers(-2, 3, (500, dims))
    v[100:260] = v[100]  # a third of the rows are copies
    rows = [(int(i), x) for i, x in zip(rng.permutation(500), v, strict=True)]
    assert found(spark, rows, 20, F.col("vec_id") % 20 == 0) == plain(rows, 20, lambda q: q % 20 == 0)


def test_several_groups_of_queries_and_waves(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 8)
    monkeypatch.setattr(topk_search, "PAIRS", 32)
    rng = np.random.default_rng(3)
    rows = [(i, x) for i, x in enumerate(rng.integers(-9, 10, (200, 10)))]
    assert found(spark, rows, 3, F.col("vec_id") % 4 == 0) == plain(rows, 3, lambda q: q % 4 == 0)


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-50, 50, (40, 64)), rng.integers(-50, 50, (60, 64))
    exact = a @ b.T
    bounds = [topk_search.statistics(a, s) @ topk_search.statistics(b, s).T for s in topk_search.SEGMENTS]
    assert (bounds[-1] >= exact - 1e-6).all()
    assert all((x >= y - 1e-6).all() for x, y in zip(bounds, bounds[1:], strict=False))


def test_bounds_rule_out_most_of_clustered_vectors():
    rng = np.random.default_rng(2)
    base = np.repeat(rng.normal(0, 40, (30, 4)), 16, axis=1)
    v = np.rint(np.repeat(base, 100, axis=0) + rng.normal(0, 4, (3000, 64))).astype(np.int64)
    alive = np.ones((30, 3000), bool)
    best = np.sort(v[::100] @ v.T, axis=1)[:, -20]
    for s in topk_search.SEGMENTS:
        alive &= topk_search.statistics(v[::100], s) @ topk_search.statistics(v, s).T >= best[:, None]
    assert alive.mean() < 0.1


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.01]), (0, [0.5, -0.01]), (20, [0.25, 1.0]), (None, [0.5, 0.5]), (-20, [1.0]), (3, [2.0]), (4, None), (40, [nan, 1.0]), (60, [inf, 1.0]), (80, [None, 1.0]), (100, [-inf, 0.0]), (120, [1e300, 1.0]), (140, []), (7, []), (160, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, v string, dim int")
    got = sorted((tuple(r) for r in topk_search.top_k(topk_search.quantised(df), F.col("vec_id") % 20 == 0, 3).collect()), key=str)
    fit = [(i, np.floor(np.array(v) * 64).astype(int)) for i, v in rows if v is not None and i not in (40, 60, 80, 100, 120)]
    assert got == plain(fit, 3, lambda q: q is not None and q % 20 == 0)
    assert topk_search.top_k(topk_search.quantised(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0
    assert topk_search.top_k(topk_search.quantised(df), F.col("vec_id") == 999).count() == 0
