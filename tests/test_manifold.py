"""The plane that keeps neighbours: its parts against numpy, and what it keeps beside two principal components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clustering, manifold, models


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, f array<double>")


def nearest(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return d, np.argsort(d, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("block", [4096, 17])
def test_neighbours_equal_numpy(spark, block):
    x = np.random.default_rng(1).integers(0, 6, (90, 4)).astype(float)
    d, near = nearest(x, 7)
    got = sorted((r.src, r.rk, r.dst, round(r.d, 9)) for r in manifold.feature_knn(frame(spark, x), 7, block).collect())
    assert got == [(i, k + 1, int(j), round(float(d[i, j]), 9)) for i in range(90) for k, j in enumerate(near[i])]


def test_bandwidths_meet_their_target_and_weights_are_joined(spark):
    x = np.random.default_rng(2).normal(size=(60, 3))
    k = 10
    d, near = nearest(x, k)
    p = np.zeros((60, 60))
    for i in range(60):
        own = d[i, near[i]] - d[i, near[i]].min()
        lo, hi = 0.0, 1e6
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if np.exp(-own / mid).sum() > np.log2(k) else (mid, hi)
        p[i, near[i]] = np.exp(-own / mid)
    want = p + p.T - p * p.T
    got = manifold.fuzzy_graph(manifold.feature_knn(frame(spark, x), k), k).collect()
    assert {(r.u, r.v) for r in got} == {(i, j) for i, j in zip(*np.nonzero(want), strict=True) if i < j}
    assert max(abs(r.w - want[r.u, r.v]) for r in got) < 1e-6


def test_equal_points_have_weights(spark):
    got = manifold.fuzzy_graph(manifold.feature_knn(frame(spark, np.zeros((5, 2))), 3), 3).collect()
    assert got and all(r.w == 1 for r in got)


def test_curve_is_near_what_it_is_fitted_to():
    a, b = manifold.curve(0.1)
    x = np.linspace(0.01, 3, 100)
    assert np.abs(1 / (1 + a * x ** (2 * b)) - np.where(x < 0.1, 1, np.exp(-(x - 0.1)))).max() < 0.08


def test_more_neighbours_are_kept_than_by_two_components(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 6, (12, 20))
    x = np.repeat(centres, 25, axis=0) + rng.normal(size=(300, 20))
    rows = frame(spark, x)
    near = manifold.feature_knn(models.principal_components(rows, 20), 10).cache()
    keep = lambda plane: manifold.preserved(near, manifold.feature_knn(plane.select("id", F.array("x", "y").alias("f")), 10))
    ours, theirs = keep(manifold.embed(rows, 10)), keep(clustering.embedded(rows))
    assert ours > theirs + 0.05, (ours, theirs)
