"""Analytic and property tests of the tissue operators."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import graphs, interactions, kernels, models, normalise, raster, scoring, spatial, stats, tuning, wavelets, zones
from tessera.plans.components import components
from tessera.sources import tables


def lattice(spark, n=5):
    return spark.createDataFrame([(i, float(i % n), float(i // n)) for i in range(n * n)], "id bigint, x double, y double")


def cloud(spark, n=200, seed=0):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 10, (n, 2))
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xy)], "id bigint, x double, y double"), xy


def distances(xy):
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    return d


def test_lattice(spark):
    p = lattice(spark)
    assert spatial.spacing(p) == 1
    deg = {r.id: r.degree for r in graphs.degrees_at(p, 1.5).collect()}
    assert deg[12] == 8 and deg[0] == 3
    assert graphs.largest_share(p, spatial.radius_pairs(p, 1.5)).first().n_components == 1


@pytest.mark.parametrize("k", [1, 5, 40])
def test_nearest_matches_brute_force(spark, k):
    p, xy = cloud(spark)
    d = distances(xy)
    got = {(r.src, r.rk): (r.dst, r.d) for r in spatial.knn(p, k).collect()}
    order = np.argsort(d, axis=1, kind="stable")
    for i in range(len(xy)):
        for r in range(k):
            assert got[i, r + 1][0] == order[i, r] and abs(got[i, r + 1][1] - d[i, order[i, r]]) < 1e-12


def test_nearest_with_few_points_and_clumps(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0), (2, 1000.0, 0.0)], "id bigint, x double, y double")
    assert spatial.knn(p, 5).count() == 6
    assert spatial.knn(p.limit(1), 3).count() == 0 and spatial.knn(p.limit(0), 3).count() == 0
    assert {r.d for r in spatial.opposite_nearest(p.withColumn("z", F.lit(1)), "z").collect()} == {float("inf")}


def test_two_blobs_have_two_components(spark):
    p = spark.createDataFrame([(i, i % 3 + 100.0 * (i >= 9), float(i // 3 % 3)) for i in range(15)], "id bigint, x double, y double")
    r = graphs.largest_share(p, spatial.radius_pairs(p, 1.5)).first()
    assert (r.n_components, r.largest, round(r.share, 3)) == (2, 9, 0.6)


@pytest.mark.parametrize("seed", [0, 1])
def test_components_match_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(i, i + 1) for i in range(500, 560)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in e:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(e, "a bigint, b bigint"), "a", "b").collect()}
    touched = {x for a, b in e if a != b for x in (a, b)}
    assert got == {x: root(x) for x in touched}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_degree_bounds(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 50.0, 0.0)], "id bigint, x double, y double")
    assert spatial.bounded_graph(p, 1.0, 2.2, 1, 2).where("src = 2").count() == 1
    assert spatial.bounded_graph(p, 1.0, 2.2, 1, 2, r_max_rel=5).where("src = 2").count() == 0
    e = spatial.radius_pairs(p, 100)
    assert spatial.within_or_all(e, 0.5).count() == e.count() and spatial.within_or_all(e, 2).count() == 2


def test_small_rules(spark):
    row = spark.range(1).select(C.hill(F.lit(2.0), 2.0).alias("h"), C.tf_gain(F.lit(1e9)).alias("t"), C.mode_of(F.lit("Gap Junction")).alias("m"), C.mode_of(F.lit("Chemokine")).alias("s"), C.mode_of(F.lit("?")).alias("n"), C.gene_name(F.lit(" ab.c.12 ")).alias("g"), C.is_complex(F.lit("A_B")).alias("c"), *(v.alias(k) for k, v in zip("ab", C.sigma_floor(F.lit(1.0), F.lit(0.1)), strict=True))).first()
    assert abs(row.h - 0.5) < 1e-9 and row.t == 2 - 0 or row.t <= 2
    assert (row.m, row.s, row.n, row.g, row.c) == ("mb", "secreted", None, "AB.C", True)
    assert row.a == 1.0 and abs(row.b - 0.68**2) < 1e-12
    r = [x[0] for x in spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double").select(F.rint("v")).collect()]
    assert r == [0, 2, 2]
    with pytest.raises(ValueError):
        scoring.Params.of(prune_percentile=0.5)


def test_quantile_higher_and_bh(spark):
    ten = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert scoring.upper_quantile(ten, "v", 0.9).first().q == 9
    p = spark.createDataFrame([(v,) for v in (0.01, 0.02, 0.03, 0.04)], "p double")
    assert [round(r.padj, 9) for r in stats.bh(p, "p").collect()] == [0.04] * 4
    q = [r.padj for r in stats.bh(spark.createDataFrame([(float(v),) for v in np.random.default_rng(0).uniform(size=50)], "p double"), "p").orderBy("p").collect()]
    assert q == sorted(q)


def test_two_means(spark):
    r = stats.two_means(spark.createDataFrame([("a", v) for v in (0.0, 1.0, 10.0, 11.0, float("nan"))] + [("b", 3.0)] * 2 + [("c", None)], "g string, v double"), "v", "g").collect()
    assert {x.g: x.t for x in r} == {"a": 5.5, "b": 3.0}


def test_ari(spark):
    same = spark.createDataFrame([(i % 3, (i % 3) * 10) for i in range(30)], "a int, b int")
    assert stats.ari(same, "a", "b").first().ari == 1
    mixed = spark.createDataFrame([(i % 2, i // 2 % 2) for i in range(40)], "a int, b int")
    assert abs(stats.ari(mixed, "a", "b").first().ari) < 0.1


def test_constant_gene_is_zero(spark):
    ex = spark.createDataFrame([(i, "g", 4.0) for i in range(5)] + [(0, "h", None), (1, "h", 2.0)], "spot_id bigint, gene string, value double")
    got = {(r.spot_id, r.gene): r.value for r in normalise.winsor_minmax(ex, "gene", "value", False).collect()}
    assert all(v == 0 for (_, g), v in got.items() if g == "g") and got[0, "h"] is None
    assert normalise.winsor_minmax(ex, "gene", "value", True).where("value is null").count() == 0


def test_undirected_and_prune(spark):
    e = spark.createDataFrame([(1, 2, 0.4), (2, 3, 1.0), (3, 2, 0.5)], "src bigint, dst bigint, w double")
    assert {(r.u, r.v): r.s for r in graphs.undirected(e).collect()} == {(1, 2): 0.2, (2, 3): 0.75}
    t = spark.createDataFrame([(i, i + 1, float(i)) for i in range(10)], "src bigint, dst bigint, total double")
    assert scoring.prune(t, 0.5).count() == 10 and scoring.prune(t, 0.5).where("total > 0").count() == 5


def test_hops(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(6)], "src bigint, dst bigint")
    nodes, inner = graphs.h_hop(e, spark.createDataFrame([(3,)], "id bigint"), 2)
    assert {r.id: r.hop for r in nodes.collect()} == {3: 0, 2: 1, 4: 1, 1: 2, 5: 2} and inner.count() == 4
    assert graphs.h_hop(e, spark.createDataFrame([(3,)], "id bigint"), 9, weak=False)[0].count() == 4


def test_louvain_finds_cliques(spark):
    pairs = [(a + s, b + s) for s in (0, 10, 20) for a in range(5) for b in range(a)] + [(0, 10), (10, 20)]
    e = spark.createDataFrame([("m", a, b) for a, b in pairs], "macro string, u bigint, v bigint")
    got = graphs.communities(e, "macro")
    parts = {}
    for r in got.collect():
        parts.setdefault(r.community, set()).add(r.id // 10)
    assert len(parts) == 3 and all(len(x) == 1 for x in parts.values())
    assert graphs.modularity(e, got).first().q > 0.5


@pytest.mark.parametrize("name", ["wv22", "wv23", "wv24", "wv32", "wv42_orth"])
def test_wavelets_invert(spark, name):
    m = len(wavelets.bank(name))
    h, w = 4 * m * m, 5 * m * m
    rng = np.random.default_rng(0)
    img = rng.normal(size=(h, w))
    px = spark.createDataFrame([(y, x, float(img[y, x])) for y in range(h) for x in range(w)], "y int, x int, v double")
    bands = wavelets.multi_level(px, name, h, w, 2, pad=False)
    back = wavelets.multi_inverse(bands, name, h, w, 2).collect()
    assert len(back) == h * w and max(abs(r.v - img[r.y, r.x]) for r in back) < (1e-9 if name != "wv42_orth" else 1e-4)
    flat = wavelets.level(px.withColumn("v", F.lit(1.0)), name, h, w).where("bi > 0 or bj > 0").agg(F.max(F.abs("v"))).first()[0]
    assert flat < (1e-9 if name != "wv42_orth" else 1e-5)


def test_level_equals_matrix_product(spark):
    b, h, w = wavelets.bank("wv32"), 12, 18
    img = np.random.default_rng(1).normal(size=(h, w))

    def matrix(n):
        out = np.zeros((n, n))
        r = n // len(b)
        for m in range(len(b)):
            for i in range(r):
                for k in range(b.shape[1]):
                    out[m * r + i, (i * len(b) + k) % n] = b[m, k]
        return out

    full = matrix(h) @ img @ matrix(w).T
    px = spark.createDataFrame([(y, x, float(img[y, x])) for y in range(h) for x in range(w)], "y int, x int, v double")
    for r in wavelets.level(px, "wv32", h, w).collect():
        assert abs(r.v - full[r.bi * 4 + r.y, r.bj * 6 + r.x]) < 1e-12
    with pytest.raises(ValueError):
        wavelets.level(px, "wv22", 11, 18)


# Published concentrations of level-1 bands.
KAPPA = {
    "wv22": {(0, 1): 0.691, (1, 0): 0.691, (1, 1): 0.0}, "wv23": {(0, 1): 0.710, (1, 0): 0.710}, "wv24": {(0, 1): 0.720, (1, 0): 0.720},
    "wv32": {(0, 1): 0.696, (0, 2): 0.853, (1, 2): 0.374}, "wv42": {(0, 1): 0.689, (0, 2): 0.841, (0, 3): 0.873, (1, 2): 0.409, (1, 3): 0.485, (2, 3): 0.108},
    "wv44": {(0, 1): 0.794, (0, 2): 0.781, (0, 3): 0.907, (1, 2): 0.014, (1, 3): 0.346, (2, 3): 0.374},
}


@pytest.mark.parametrize("name", list(KAPPA))
def test_band_concentration(name):
    got = {(i, j): k for i, j, _, k in wavelets.orientation(name)}
    assert all(abs(got[b] - k) <= 6e-4 for b, k in KAPPA[name].items())


def test_reflected_padding_and_crop(spark):
    px = spark.createDataFrame([(y, x, float(10 * y + x)) for y in range(3) for x in range(5)], "y int, x int, v double")
    pads = wavelets.padding(3, 5, 2, 2)
    got = np.zeros((4, 8))
    for r in wavelets.reflect_pad(px, 3, 5, pads).collect():
        got[r.y, r.x] = r.v
    want = np.pad(np.array([[10 * y + x for x in range(5)] for y in range(3)], float), (pads[:2], pads[2:]), mode="reflect")
    assert (got == want).all()
    assert wavelets.max_levels(8, 12, 2) == 2 and wavelets.dyadic_levels(64, 32) == 4


def test_morphology(spark):
    mask = spark.createDataFrame([(y, x) for y in range(2, 7) for x in range(2, 7) if (y, x) != (4, 4)] + [(9, 9)], "y int, x int")
    closed = raster.close(mask, 1, 12, 12)
    assert closed.where("y = 4 and x = 4").count() == 1
    assert raster.objects(mask, 12).select("object").distinct().count() == 2
    assert raster.largest_object(mask, 12).count() == 24 and raster.drop_small(mask, 12, 5).count() == 24
    assert raster.fill_holes(mask, 12, 12, 5).where("y = 4 and x = 4").count() == 1
    assert raster.boundary(mask.where("y = 9"), 12, 12).count() == 4
    far = spark.createDataFrame([(0, 1.0, 11.0), (1, 4.0, 3.0)], "id bigint, x double, y double")
    assert raster.rescue(mask, far, 1.0, 12, 12).count() == 25 + 4


def test_raster_helpers(spark):
    p = spark.createDataFrame([(0, 0.2, 0.9), (1, 1.0, 0.0)], "id bigint, x double, y double")
    assert raster.map_to_grid(p, 11, 21).where("id = 1").first().x == 10
    b = raster.bounds(p)
    assert b["x1"] == 2.0 and raster.cell_size(b, 4) == ((2.0 - 0.2) / 4, 1.9 / 4)
    grid = spark.createDataFrame([(i, j, float(i * 10 + j)) for i in range(4) for j in range(4)], "i int, j int, v double")
    assert raster.upsample(p, grid, b, 4, 10, 10).count() == 2
    rgb = spark.createDataFrame([(0, 0, 255.0, 0.0, 128.0)], "y int, x int, r double, g double, b double")
    long = raster.stack(rgb, ["r", "g", "b"])
    assert raster.normalised_rgb(long).agg(F.max("v")).first()[0] == 1.0
    assert raster.channels(long, ["r", "g", "b"]).first().b == 128.0
    lab = spark.range(1).select(*(c.alias(n) for c, n in zip(C.rgb_to_lab(F.lit(1.0), F.lit(1.0), F.lit(1.0)), "lab", strict=True))).first()
    assert abs(lab.l - 100) < 0.1 and abs(lab.a) < 0.1 and abs(lab.b) < 0.1
    flat = raster.flatten(spark.createDataFrame([(0, 1, 5.0), (0, 0, 4.0), (1, 0, 9.0)], "y int, x int, v double"), spark.createDataFrame([(0, 1), (1, 0)], "y int, x int"))
    assert [(r.ord, r.v) for r in flat.orderBy("ord").collect()] == [(0, 5.0), (1, 9.0)]
    bands = spark.createDataFrame([(1, 0, 1, i, j, 1.0) for i in range(4) for j in range(4)] + [(2, 1, 1, 0, 0, 2.0), (1, 0, 0, 0, 0, 9.0)], "level int, bi int, bj int, y int, x int, v double")
    assert {r.name for r in raster.resample_bands(p, bands, 4, 8, 8).collect()} <= {"L1_B01", "L2_B11"}


def test_isotropic_where_no_pixels(spark):
    p = lattice(spark, 3)
    e = kernels.framed(spatial.radius_pairs(p, 1.1), p, 1.0, "fixed", r_rel=0.5, sigma_rel=0.3)
    far = spark.createDataFrame([(500, 500, 1.0, 2.0, 3.0)], "y int, x int, eh double, ev double, ed double")
    got = kernels.wv2_kernel(e, far, 1.0, 1.0).collect()
    assert {(r.a, r.ratio, r.theta) for r in got} == {(1.0, 0.0, 0.0)} and all(abs(r.k - math.exp(-0.5 * r.d**2)) < 1e-12 for r in got)
    for policy in ("edge", "edge_clip", "adaptive"):
        assert kernels.framed(spatial.radius_pairs(p, 1.1), p, 1.0, policy).where("r <= 0").count() == 0
    with pytest.raises(ValueError):
        C.pool_size("none", F.lit(1.0), F.lit(1.0))


def test_scores_with_and_without_null(spark):
    p, _ = cloud(spark, 60)
    spots = p.withColumnRenamed("id", "spot_id")
    rng = np.random.default_rng(2)
    ex = spark.createDataFrame([(i, g, float(v)) for i in range(60) for g, v in zip("ABCD", rng.integers(0, 5, 4), strict=True) if v], "spot_id bigint, gene string, value double")
    lr = spark.createDataFrame([(0, "A", "B", "p", "Secreted Signaling"), (1, "C", "D", "q", "Cell-Cell Contact"), (2, "A", "Z", "q", "x")], "pair_id bigint, ligand string, receptor string, pathway string, ligand_annotation string")
    e = kernels.iso(spatial.bounded_graph(p, spatial.spacing(p)), spatial.spacing(p))
    plain = scoring.score_all(spots, e, ex, lr, params=scoring.Params(n_null=0))
    null = scoring.score_all(spots, e, ex, lr, params=scoring.Params(n_null=30, pool_size=3))
    a = {(r.src, r.dst, r.pair_id): r.s for r in plain["ccc_edge_pair"].collect()}
    b = {(r.src, r.dst, r.pair_id): r.s for r in null["ccc_edge_pair"].collect()}
    assert a.keys() == b.keys() and all(0 <= b[k] <= a[k] for k in a) and {k[2] for k in a} <= {0, 1}
    assert plain["ccc_edge_pathway"].select("pathway").distinct().count() == 2 and plain["meta"]["h"] > 0
    pairs = scoring.known_pairs(lr, ex)
    draws = scoring.draw_table(scoring.pools(pairs, scoring.gene_means(ex, 60), 3), 7, 1)
    one = {(r.src, r.dst, r.pair_id): r.tau for r in scoring.null_thresholds(plain["edges"], ex, pairs, draws, 0.01).collect()}
    two = {(r.src, r.dst, r.pair_id): r.tau for r in scoring.null_thresholds_many(plain["edges"], ex, pairs, draws, 0.01).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-12 for k in one)


def test_mann_whitney_against_ranks(spark):
    rng = np.random.default_rng(3)
    v, lab = rng.integers(0, 4, 40).astype(float), rng.integers(0, 2, 40)
    ex = spark.createDataFrame([(i, "g", float(x)) for i, x in enumerate(v) if x], "spot_id bigint, gene string, value double")
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lab)], "spot_id bigint, cluster int")
    r = {x.cluster: x for x in stats.two_sided(stats.mann_whitney(ex, labels)).collect()}
    rank = pd.Series(v).rank().to_numpy()
    n1 = (lab == 1).sum()
    assert abs(r[1].u - (rank[lab == 1].sum() - n1 * (n1 + 1) / 2)) < 1e-9
    assert abs(r[0].u + r[1].u - n1 * (40 - n1)) < 1e-9 and abs(r[0].p - r[1].p) < 1e-12 and 0 < r[0].p <= 1


def test_robust_z_is_bounded(spark):
    rows = spark.createDataFrame([(i, i + 1, float(v)) for i, v in enumerate(np.random.default_rng(0).pareto(1, 300))], "src bigint, dst bigint, m double")
    z = scoring.robust_z(rows, 0.6, 3.0)
    assert z.where("abs(z) > 3.0000001").count() == 0
    assert 0 < scoring.beta_plus(z).first().beta <= 0.08
    assert scoring.beta_plus(z.withColumn("z", F.lit(-1.0))).first().beta == 0


def test_zones_of_one_small_island(spark):
    p = lattice(spark, 12).withColumn("label12", F.when((F.col("x").between(4, 6)) & (F.col("y").between(4, 6)), 2).otherwise(1))
    got = {r.zone: r.n for r in zones.zoning(p).groupBy("zone").agg(F.count("*").alias("n")).collect()}
    assert got["tumour_core"] == 1 and got["tumour_edge"] == 8 and sum(got.values()) == 144
    hot = zones.one_hot(zones.zoning(p), "zone", ["tumour_core"])
    assert hot.agg(F.sum("zone_tumour_core")).first()[0] == 1


def test_smoothing_and_denoising_flip_a_lone_label(spark):
    p = lattice(spark, 9).withColumn("label", F.when(F.col("id") == 40, 5).otherwise(1)).withColumn("macro", F.lit("m"))
    assert {r.label for r in zones.smooth(p, "label", 8).collect()} == {1}
    assert {r.label for r in zones.denoise(p, "macro", "label").collect()} == {1}


def test_niche_ids_merge_small_ones(spark):
    rows = [(i, "a", 0, [0.0]) for i in range(12)] + [(20 + i, "a", 1, [5.0]) for i in range(11)] + [(40, "a", 2, [4.5])] + [(50 + i, "b", 0, [1.0]) for i in range(3)]
    got = {r.id: (r.micro_id, r.micro_name) for r in zones.niche_ids(spark.createDataFrame(rows, "id bigint, macro string, local int, f array<double>")).collect()}
    assert got[0] == (0, "a:0") and got[40] == (1, "a:1") and got[50] == (2, "b:0")


def test_model_losses(spark):
    pts = spark.createDataFrame([(i, k, float(v)) for i in range(6) for k, v in enumerate(((i % 2) * 4, i * 0.1))], "id bigint, pos int, v double")
    centres = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.2), (1, 0, 4.0), (1, 1, 0.2)], "cluster int, pos int, v double")
    q = models.soft_assignment(pts, centres)
    p = models.target_distribution(q)
    sums = [r[1] for r in q.groupBy("id").agg(F.sum("q")).collect()] + [r[1] for r in p.groupBy("id").agg(F.sum("p")).collect()]
    assert all(abs(s - 1) < 1e-12 for s in sums) and models.kl_divergence(p, q).first().loss >= 0
    assert models.info_nce(pts, spark.createDataFrame([(1, 3), (3, 1)], "src bigint, dst bigint")).first().loss > 0
    both = pts.withColumn("view", F.lit("a"))
    assert models.reconstruction_loss(both, both).first().loss == 0
    joint = models.joint_features([(spark.createDataFrame([(1, [1.0])], "id bigint, f array<double>"), 2.0), (spark.createDataFrame([(1, [3.0])], "id bigint, f array<double>"), 1.0)]).first()
    assert list(joint.f) == [2.0, 3.0]
    doubled = models.apply_model(spark.range(3), lambda df: df.assign(id=df.id * 2), "id bigint")
    assert sorted(r.id for r in doubled.collect()) == [0, 2, 4]


def test_search_sorts_trials(spark):
    p, _ = cloud(spark, 40)
    spots = p.withColumnRenamed("id", "spot_id")
    ex = spark.createDataFrame([(i, g, float((i * k) % 7 + 1)) for i in range(40) for k, g in enumerate("ABC", 1)], "spot_id bigint, gene string, value double")
    lr = spark.createDataFrame([(0, "A", "B", "p", "secreted")], "pair_id bigint, ligand string, receptor string, pathway string, ligand_annotation string")
    e = kernels.iso(spatial.bounded_graph(p, spatial.spacing(p)), spatial.spacing(p))
    got = tuning.search(spots, e, ex, lr, fast=1, refine=1, n_null=(3, 4)).collect()
    assert len(got) == 2 and got[0].penalty <= got[1].penalty < 1e9 and {r.stage for r in got} == {"fast", "refined"}
    assert json.loads(got[0].params)["pool_size"] in (1000, 1200) and all(r.error is None for r in got)


def test_search_space_and_penalty(spark):
    rng = np.random.default_rng(1)
    draws = [tuning.sampled(rng) for _ in range(800)]
    share = lambda k, v: np.mean([d[k] == v for d in draws])
    assert abs(share("beta_max", 0.08) - 0.45) < 0.06 and abs(share("deg_min", 10) - 0.6) < 0.06 and abs(share("k_for_Wr", 1) - 0.7) < 0.06
    assert all(0.65 <= d["prune_frac"] <= 0.85 and d["n_null"] == 200 for d in draws)
    again = tuning.refined(draws[0])
    assert {k for k in again if again[k] != draws[0][k]} == {"n_null", "pool_size"} and again["n_null"] == 1000 and again["pool_size"] == 1200
    rows = spark.createDataFrame([(1, 3.0, None), (2, None, float("nan")), (3, 1.0, 0.0)], "trial int, components double, gate_big double")
    assert [r.penalty for r in tuning.penalised(rows).orderBy("trial").collect()] == [10, 0, 1.5]


def test_a_broken_job_ends_the_search(spark, monkeypatch):
    def broken(*a):
        raise MemoryError

    monkeypatch.setattr(tuning, "sanity", broken)
    none = spark.createDataFrame([], "pair_id bigint")
    with pytest.raises(MemoryError):
        tuning.search(none, none, none, none, fast=1)


def test_rows_are_numbered_in_order(spark):
    from tessera.plans.numbering import number_rows

    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(5)
    got = number_rows(df, "n", ["v"]).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1000)) and [r.v for r in got] == sorted(r.v for r in got)
    assert number_rows(df.limit(0), "n", ["v"]).count() == 0


def test_erfc(spark):
    from math import erfc

    xs = [k / 50 for k in range(0, 1000)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erfc(F.col("x")).alias("e")).collect()
    assert all(abs(r.e - erfc(r.x)) <= 1e-9 * erfc(r.x) + 1e-300 for r in got)


def test_components_of_many_edges_have_a_fingerprint_without_overflow(spark):
    """Hashes of 40 million edges, combined as the rounds combine them."""
    from tessera.plans import components as module

    assert "bit_xor" in open(module.__file__).read()
    assert spark.range(40_000_000).agg(F.count("*"), F.bit_xor(F.xxhash64("id", F.lit(1)))).first()[0] == 40_000_000


def test_tables_go_and_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from tessera.plans import workspace

    one = workspace.materialise(spark.range(5), "one")
    two = workspace.materialise(one.where("id > 1"), "two", instead_of=(one,))
    assert two.count() == 3 and not workspace.exists(spark, one._tessera_path) and workspace.exists(spark, two._tessera_path)
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://x", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))))
    with pytest.raises(RuntimeError, match="checkpoint"):
        workspace.shared_dir(far)


def test_pools_reach_as_far_as_their_edges(spark):
    """Edges of unlike lengths, and corridors longer than they are wide: no pixel is lost to the tiles."""
    p = spark.createDataFrame([(1, 2.0, 2.0), (2, 22.0, 2.0), (3, 2.0, 5.0)], "id bigint, x double, y double")
    e = spark.createDataFrame([(1, 2, 20.0), (1, 3, 3.0)], "src bigint, dst bigint, d double")
    px = spark.range(30 * 30).select((F.col("id") % 30).cast("int").alias("x"), (F.col("id") / 30).cast("int").alias("y"), F.lit(1.0).alias("v"))
    framed = kernels.framed(e, p, 1.0, "edge", k=1.0, c=0.5)
    got = {r.dst: r.n for r in kernels.half_disk(framed, px, ["v"]).collect()}
    disk = lambda x0, y0, r, ahead: sum((x - x0) ** 2 + (y - y0) ** 2 <= r * r and ahead(x - x0, y - y0) for x in range(30) for y in range(30))
    assert got == {2: disk(2, 2, 20, lambda dx, dy: dx >= 0), 3: disk(2, 2, 3, lambda dx, dy: dy >= 0)}
    row = {r.dst: r.n for r in kernels.corridor_weights(framed, px).groupBy("dst").agg(F.count("*").alias("n")).collect()}
    assert row[2] == sum(abs(y - 2) <= 10 for x in range(2, 23) for y in range(30))


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "coords.csv").write_text(" Barcode ,X,Y\nb0,1.5,2\nb1,2.5,3\nb2,x,4\n")
    c = tables.coords_strict(spark, f"{tmp_path}/coords.csv").orderBy("spot_id").collect()
    assert [(r.spot_id, r.barcode, r.xy_key) for r in c[:2]] == [(0, "b0", "2_2"), (1, "b1", "2_3")] and c[2].x is None
    assert tables.coords_auto(spark, str(tmp_path)).count() == 3
    (tmp_path / "other.csv").write_text("n,a,b\nq,1,2\nr,3,4\n")
    first = tables.coords_any(tables.csv(spark, f"{tmp_path}/other.csv"), "last").orderBy("spot_id").first()
    assert (first.x, first.y) == (1.0, 2.0)
    with pytest.raises(ValueError):
        tables.coords_strict(spark, f"{tmp_path}/other.csv")
    (tmp_path / "expr.csv").write_text("gene,b0,b1,b9,b3,b4,b5\nG1.2,1,2,3,4,5,6\nG1.2,7,,3,4,5,6\nG2,n,2,3,4,5,6\n")
    wide = tables.csv(spark, f"{tmp_path}/expr.csv")
    long = tables.expr_long(wide)
    spots = tables.coords_named(spark, f"{tmp_path}/coords.csv")
    got = {(r.spot_id, r.gene): r.value for r in tables.aligned_expr(long, spots).collect()}
    assert got[0, "G1.2"] == 7 and got[1, "G1.2"] == 2 and got[0, "G2"] == 0 and got[2, "G2"] == 0
    assert {r.gene for r in tables.gene_set(wide).collect()} == {"G1", "G2"}
    (tmp_path / "lr.csv").write_text("ligand,receptor,pathway,ligand_annotation\nA,B,p,Secreted\n ,B,p,x\nC,D,q,integrin\n")
    lr = tables.lr_tables(spark, [f"{tmp_path}/lr.csv"] * 2)
    assert sorted(r["mode"] for r in lr.collect()) == ["mb", "mb", "secreted", "secreted"]
    with pytest.raises(ValueError):
        interactions.union([lr.drop("pathway")])
    (tmp_path / "db.csv").write_text("i,l,r,p,a,t\n1,a.1,b,P,n,T\n")
    assert tables.lr_database(tables.csv(spark, f"{tmp_path}/db.csv")).first().ligand == "A"
    (tmp_path / "tf.csv").write_text("spot,T1,T2\n2_2,1,2\n9_9,5,5\n")
    assert tables.tf_activity(tables.csv(spark, f"{tmp_path}/tf.csv"), spots).agg(F.sum("value")).first()[0] == 3
    (tmp_path / "img.csv").write_text("i,a,b\n0,1,2\n1,3,4\n")
    assert {(r.y, r.x): r.v for r in tables.raster(tables.csv(spark, f"{tmp_path}/img.csv")).collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}
    for name in ("L1_B01_a", "L1_B10_a", "L2_B01_a"):
        spark.createDataFrame([(0, 0, 1.0)], "y int, x int, v double").write.parquet(f"{tmp_path}/bands/{name}.parquet")
    b = tables.bands(spark, f"{tmp_path}/bands/*.parquet")
    assert {(r.level, r.bi, r.bj) for r in tables.with_second_level(b).collect()} == {(1, 0, 1), (1, 1, 0), (2, 0, 1), (2, 1, 0)}
    for name in ("L1_ang15", "L1_ang-75", "L2_ang15"):
        spark.createDataFrame([(0, 0, 1.0, 0.0)], "y int, x int, re double, im double").write.parquet(f"{tmp_path}/dt/{name}.parquet")
    assert {r.angle for r in tables.angles(spark, f"{tmp_path}/dt/*.parquet").collect()} == {15}
    e = spark.createDataFrame([(1, 2, 0.5)], "src bigint, dst bigint, k double")
    tables.save_kernel(e, {"h": 1.0, "family": "wv2"}, f"{tmp_path}/kernel")
    back, meta = tables.load_kernel(spark, f"{tmp_path}/kernel")
    assert back.count() == 1 and meta["family"] == "wv2"
    macro = spark.createDataFrame([("b0", "m")], "spot string, macro string")
    with pytest.raises(ValueError):
        tables.coverage(spots.select(F.col("barcode").alias("spot")), macro)
    micro = tables.micro(spark.createDataFrame([("s", "m", 3)], "spot string, macro string, micro_id int")).first()
    assert micro.micro_name == "3"
    assert tables.labels(spark.createDataFrame([("q", 4)], "name string, Class int")).first().label == 4


def test_clusters_of_separate_features(spark):
    from tessera.operators import clustering

    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in (10 * (i % 3) + rng.normal(), rng.normal() + 5 * (i % 3 == 1), 1.0)]) for i in range(90)]
    f = spark.createDataFrame(rows, "id bigint, f array<double>")
    truth = f.select("id", (F.col("id") % 3).alias("truth"))
    spots = f.select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    got = clustering.grid(f, f, spots, truth, weights=(1.0,), ks=(8,), resolutions=(0.3,)).first()
    assert got.ari_pre > 0.6 and got.classes >= 3
    assert tuning.best_configurations(spark.createDataFrame([(1, 0.2), (2, 0.9)], "k int, ari_post double"), n=1).first().k == 2
    macro = f.select("id", F.when(F.col("id") < 80, "a").otherwise("b").alias("macro"))
    niches = clustering.micro_niches(f, macro, k=8)
    assert niches.count() == 90 and niches.where("micro_name like 'b:%'").select("micro_id").distinct().count() == 1
    assert clustering.scaled(f).first().f is not None and len(clustering.scaled(f).first().f) == 2
    assert abs(clustering.share_of(truth, "truth").agg(F.sum("share")).first()[0] - 1) < 1e-12


@pytest.mark.parametrize("small", [10, 1 << 20])
def test_quantiles_of_large_columns(spark, small):
    from tessera.plans.order_stats import quantile

    rng = np.random.default_rng(0)
    for v in (rng.normal(size=3000), np.repeat([1.0, 2.0, 2.0, 7.0], 400), np.arange(1000) // 300 * 1.0):
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "m double").repartition(3)
        for q in (0.0, 0.1, 0.5, 0.77, 1.0):
            assert abs(quantile(df, "m", q, small=small) - np.quantile(v, q)) < 1e-9
            assert quantile(df, "m", q, True, small) == np.quantile(v, q, method="higher")
    assert quantile(df.limit(0), "m", 0.5) is None
