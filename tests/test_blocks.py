"""Louvain in blocks: the whole graph is partitioned, no task holds it, and modularity stays near that of one task."""

import numpy as np
import pytest

from tessera.operators import clustering, graphs, kernels


def _lattice(n, shift=0):
    at = np.arange(n * n).reshape(n, n)
    pairs = np.concatenate([np.stack([at[:, :-1].ravel(), at[:, 1:].ravel()], 1), np.stack([at[:-1].ravel(), at[1:].ravel()], 1), np.stack([at[:-1, :-1].ravel(), at[1:, 1:].ravel()], 1)])
    return pairs + shift


@pytest.mark.parametrize("placed", [True, False])
def test_large_groups_are_partitioned_in_blocks(spark, monkeypatch, placed):
    n = 24
    perm = np.random.default_rng(0).permutation(n * n)  # ids that don't go by place
    rows = [("big", int(perm[a]), int(perm[b])) for a, b in _lattice(n)] + [("small", a + 10_000, b + 10_000) for a, b in _lattice(4).tolist()]
    e = spark.createDataFrame(rows, "macro string, u bigint, v bigint")
    places = spark.createDataFrame([(int(perm[i]), float(i % n), float(i // n)) for i in range(n * n)], "id bigint, x double, y double") if placed else None
    sizes = spark.sparkContext.accumulator(0)
    own, most = graphs.louvain, 300

    def watched(nodes, pairs, *rest):
        if len(pairs) > most * 1.5:
            sizes.add(1)
        return own(nodes, pairs, *rest)

    monkeypatch.setattr(graphs, "louvain", watched)
    one = graphs.communities(e, "macro").cache()
    assert one.count() == n * n + 16 and sizes.value > 0
    sizes.value = 0
    got = graphs.communities(e, "macro", places=places, most=most).cache()
    assert got.count() == got.select("id").distinct().count() == n * n + 16 and sizes.value == 0
    q = [graphs.modularity(e.where("macro = 'big'"), x.where("macro = 'big'")).first().q for x in (one, got)]
    assert q[1] > q[0] - 0.03
    key = lambda x: sorted(map(tuple, x.where("macro = 'small'").collect()))
    assert key(got) == key(one)
    labels = sorted(r.community for r in got.where("macro = 'big'").select("community").distinct().collect())
    assert labels == list(range(len(labels)))


def test_scaled_features_form_no_row_for_each_position(spark):
    rng = np.random.default_rng(1)
    f = np.concatenate([rng.normal(size=(40, 3)), np.ones((40, 1)), rng.normal(size=(40, 1))], 1)
    got = clustering.scaled(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(f)], "id bigint, f array<double>"))
    assert "LeftSemi" not in got._jdf.queryExecution().optimizedPlan().toString()
    keep = f[:, [0, 1, 2, 4]]
    want = (keep - keep.mean(0)) / keep.std(0)
    assert np.allclose([r.f for r in got.orderBy("id").collect()], want)


def _edges_and_pixels(spark):
    rng = np.random.default_rng(2)
    p = rng.random((12, 2)) * 8
    rows = [(i, j, float(np.hypot(*(p[j] - p[i]))), *map(float, (*p[i], *p[j])), 2.5, 1.3) for i in range(12) for j in range(12) if i != j and np.hypot(*(p[j] - p[i])) < 4] + [(90, 91, 0.0, 1.0, 1.0, 1.0, 1.0, 2.5, 1.3)]
    e = spark.createDataFrame(rows, "src long, dst long, d double, x1 double, y1 double, x2 double, y2 double, r double, sigma double")
    return e, spark.createDataFrame([(y, x, float(rng.normal()), float(rng.normal())) for y in range(9) for x in range(9)], "y int, x int, a double, b double")


def test_edges_stay_in_one_tile(spark):
    from pyspark.sql import functions as F

    e, px = _edges_and_pixels(spark)
    met = kernels._meet(e, px, (F.col("x1"), F.col("y1")), F.col("r"))
    side = [line for line in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.lstrip().startswith(":")]
    assert any("src#" in line for line in side) and not any("Generate" in line for line in side)
    own = met.where("(x - x1) * (x - x1) + (y - y1) * (y - y1) <= r * r")
    want = e.crossJoin(px).where("(x - x1) * (x - x1) + (y - y1) * (y - y1) <= r * r")
    key = lambda df: sorted((r.src, r.dst, r.y, r.x) for r in df.collect())
    assert key(own) == key(want) and len(key(own)) > 200


def test_corridor_and_cap_are_pooled_in_sums_by_edge(spark):
    e, px = _edges_and_pixels(spark)
    bare = px.select("y", "x")
    want = {(r.src, r.dst): r for r in kernels.pooled(kernels.combined(kernels.corridor_weights(e, bare), kernels.cap_weights(e, bare)), px, ["a", "b"]).collect()}
    pool = kernels.pool(e, px, ["a", "b"], "corridor")
    got = {(r.src, r.dst): r for r in pool.collect()}
    assert set(got) == set(want) and len(got) > 20
    assert all(got[k].n == want[k].n and np.allclose([got[k].a, got[k].b], [want[k].a, want[k].b], rtol=1e-9) for k in want)
    assert pool._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_directions_of_bands_are_summed_within_the_row(spark):
    e, px = _edges_and_pixels(spark)
    bands = spark.createDataFrame([("b1", 0.3, 0.7), ("b2", 1.2, 0.5), ("b3", 2.4, 0.1)], "band string, theta double, kappa double")
    made = kernels.wv4_kernel(e, px, {"b1": ("a", "b"), "b2": ("b", None), "b3": ("a", None)}, bands, 1.0)
    shape = made._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in shape.split("_terms")[0] and shape.count("Aggregate [src") == 1
    half = kernels.half_disk(e, px, ["a", "b"])
    p = half.selectExpr("src", "dst", "stack(2, 'b1', 0.8 * a + 0.2 * b, 'b2', b) as (band, p)")
    want = {(r.src, r.dst): r for r in kernels.angular_kernel(e, p, bands, 1.0).collect()}
    got = {(r.src, r.dst): r for r in made.collect()}
    assert set(got) == set(want) and all(np.allclose(got[k][2:], want[k][2:], equal_nan=True) for k in want)
