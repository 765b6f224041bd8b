"""Product quantisation (4) against brute force."""

import math
import random

import numpy as np
import pytest
from conftest_llm import rows_of

from tessera.llm import pq_dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, cosine=0.9):
    ok = {}
    for k, (_, v, *_) in enumerate(rows):
        if v and None not in v and all(math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            x = x / np.abs(x).max()
            ok[k] = x / math.sqrt(x @ x)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = [0] * len(rows)
    keys = list(ok)
    for a in keys:
        for b in keys:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine:
                n[a] += 1
                n[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k in range(len(rows)):
        least[root(k)] = min(least.get(root(k), rows[k][0]), rows[k][0])
    return sorted(((rows[k][0], n[k], least[root(k)], least[root(k)] == rows[k][0]) for k in range(len(rows))), key=str)


def clusters(seed, groups, width=16, noise=0.25):
    rng = np.random.default_rng(seed)
    rows = []
    for size in groups:
        c = rng.normal(size=width)
        for _ in range(size):
            rows.append((len(rows), (c + noise * rng.normal(size=width)).tolist(), 1))
    rng.shuffle(rows)
    return [(i * 3, v, lab) for i, (_, v, lab) in enumerate(rows)]


def as_float(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]


@pytest.mark.parametrize("lists", [1, 8])
def test_links_against_brute_force(spark, lists):
    rows = as_float(clusters(1, [40, 25, 10, 5, *[1] * 120]))
    rows += [(1000 + k, rows[0][1], 2) for k in range(30)] + [(2000, [2 * x for x in rows[1][1]], 0)]
    got = pq_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA), probes=8, lists=lists)
    assert rows_of(got, "vec_id", "n_links", "component_id", "kept") == brute(rows)


def test_blocks_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "BLOCK", 7)
    rows = as_float(clusters(2, [60, 20, *[1] * 40]))
    got = pq_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA), lists=2)
    assert rows_of(got, "vec_id", "n_links", "component_id", "kept") == brute(rows)


def test_one_probe_loses_nothing(spark):
    """Probes are only the least that is asked: the bounds ask the rest, and every link counts for both its ends."""
    rows = as_float(clusters(3, [50, 50, *[1] * 100], noise=0.3))
    got = pq_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA), probes=1, lists=12)
    assert rows_of(got, "vec_id", "n_links", "component_id", "kept") == brute(rows)


@pytest.mark.parametrize("lists", [None, 300])
def test_planted_pairs_just_within_reach(spark, lists):
    """Pairs at a cosine of 0.90 to 0.95 in a spread cloud, over hundreds of lists and over the lists taken by default."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 24))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(1, keepdims=True) * x
    aside /= np.sqrt((aside * aside).sum(1, keepdims=True))
    cos = np.linspace(0.9, 0.95, len(x))[:, None]
    rows = as_float([(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * aside]))])
    unit = np.array([v for _, v, _ in rows])
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    got = pq_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA), lists=lists).orderBy("vec_id").collect()
    assert want.sum() > 2500
    assert [r.n_links for r in got] == want.tolist()


def test_lists_grow_with_the_vectors():
    assert [pq_dedup.list_count(n) for n in (0, 500, 8192, 65536, 10**6)] == [1, 1, 32, 32, 488]
    counts = [pq_dedup.list_count(10**k) for k in range(3, 12)]
    assert counts == sorted(counts) and pq_dedup.list_count(10**9) > 3 * pq_dedup.MANY_LISTS


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 2.0], 1), (8, [2.0, 4.0], 1), (9, [1.0, 2.0, 0.0], 1), (7, [1.0, 2.0], 1), (10, [-1.0, -2.0], 1), (11, [1e-30, 2e-30], 1), (12, [1e30, 2e30], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = pq_dedup.near_vectors(df.withColumnRenamed("label", "rep"))
    assert rows_of(got, "vec_id", "n_links", "component_id", "kept") == brute(rows)
    assert pq_dedup.near_vectors(df.limit(0)).count() == 0
    assert pq_dedup.near_vectors(df.where("vec_id < 7")).where("n_links > 0").count() == 0


def test_recall_on_a_spread_cloud(spark):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(700)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in base[i % 700]], 0) for i in range(1400)]
    rows = as_float(rows)
    got = sum(r.n_links for r in pq_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    want = sum(r[1] for r in brute(rows))
    assert want and got >= 0.9 * want


def test_a_hot_group_over_many_lists_is_found_whole(spark):
    """A third of the rows are near copies, which k-means spreads over far more than 16 of the lists."""
    rng = np.random.default_rng(6)
    hot, n = rng.normal(size=64), 3000
    x = np.concatenate([hot + 0.2 * rng.normal(size=(n // 3, 64)), rng.normal(size=(n - n // 3, 64))]).astype(np.float32).astype(float)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    got = pq_dedup.near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA), lists=90).orderBy("vec_id").collect()
    assert want[: n // 3].min() > 900
    assert [r.n_links for r in got] == want.tolist()
