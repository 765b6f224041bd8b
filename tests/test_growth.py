"""Steps whose work has to grow with the input: results against plain Python, and plans without the steps that didn't."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import autoencoder, clustering, models, raster, scoring, spatial, stats
from tessera.plans.workspace import materialise, measured_joins


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rates_by_group_run_from_the_last_rank(spark):
    rng = np.random.default_rng(1)
    rows = [(g, round(float(v), 2)) for g in ("a", "b", None) for v in rng.uniform(size=37)] + [("c", 0.5)]
    got = stats.bh(spark.createDataFrame(rows, "g string, p double"), "p", ["g"], block=8)
    assert "unboundedfollowing" not in plan(got).lower()
    for g in ("a", "b", "c", None):
        p = sorted(v for k, v in rows if k == g)
        want = {v: min([1.0, *(p[j] * len(p) / (j + 1) for j in range(i, len(p)))]) for i, v in reversed(list(enumerate(p)))}
        own = [r for r in got.collect() if r.g == g]
        assert len(own) == len(p) and all(math.isclose(r.padj, want[r.p]) for r in own)


def test_nearest_on_a_column_forms_no_pairs(spark):
    rng = np.random.default_rng(2)
    labels = [(k, float(k % 3), float(v)) for k, v in enumerate(rng.integers(0, 60, 200))] + [(900, 7.0, 1.0), (901, 0.0, None), (902, 0.0, float("nan")), (5, 1.0, 2.0)]
    points = [(k, float(k % 2), float(v)) for k, v in enumerate(rng.permutation(np.repeat(np.arange(0, 60, 4), 4)))] + [(999, 0.0, None)]
    got = spatial.nearest_same_x(spark.createDataFrame(labels, "ord long, x double, y double"), spark.createDataFrame(points, "ord long, x double, y double"))
    assert all("y#" in line or "_y#" in line for line in plan(got).splitlines() if "Join" in line)
    want = []
    for o, x, y in labels:
        near = [(abs(y - py), k, py) for k, px, py in points if px == x and py is not None] if y is not None and y == y else []
        want.append((o, x, min(near)[2] if near else None))
    key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0)
    assert sorted(((r.ord, r.x, r.y_near) for r in got.collect()), key=key) == sorted(want, key=key)


def test_steps_of_the_tissue_mask_do_not_nest(spark):
    rng = np.random.default_rng(3)
    rgb = spark.createDataFrame([(y, x, *map(float, rng.uniform(size=3))) for y in range(8) for x in range(8)], "y int, x int, r double, g double, b double")
    got = raster.tissue_mask(rgb, 8, 8, least=4)
    assert len(plan(got).splitlines()) < 40
    assert got.count() == got.distinct().count() > 0


def test_scores_above_drawn_pairs_are_formed_within_the_row(spark):
    e = spark.createDataFrame([(1, 2, 0.5, 0.9, 1.0, 1.0), (2, 1, 0.7, 0.8, 0.0, 1.1), (1, 3, 0.2, 0.3, 1.0, 1.0)], "src long, dst long, k double, radial double, contact double, g double")
    ex = spark.createDataFrame([(1, "a", 2.0), (1, "b", 0.5), (2, "a", 1.0), (2, "b", 3.0), (2, "c", 0.1)], "spot_id long, gene string, value double")
    pairs = spark.createDataFrame([(0, "mb", "a", "b", "p"), (1, "secreted", "b", "c", "q")], "pair_id long, mode string, ligand string, receptor string, pathway string")
    draws = spark.createDataFrame([(0, 0, "b", "c"), (0, 1, "c", "z"), (1, 0, "a", "a")], "pair_id long, t int, gl string, gr string")
    gains = spark.createDataFrame([(2, 1.5)], "spot_id long, gain double")
    key = lambda df: sorted((r.src, r.dst, r.pair_id, round(r.s, 12)) for r in df.collect())
    plain = scoring.raw_scores(e, ex, pairs, 0.01)
    assert key(scoring.raw_scores(e, ex, pairs, 0.01, draws=draws)) == key(scoring.above_null(plain, scoring.null_thresholds(e, ex, pairs, draws, 0.01)))
    assert key(scoring.raw_scores(e, ex, pairs, 0.01, gains)) == key(scoring.modulate(plain, gains))


def test_blocks_of_the_autoencoder_come_a_few_at_a_time(spark, tmp_path):
    rows = [(k, 1, [0.5], [0], [0], [1], [0], [0], [1.0]) for k in range(50)]
    spark.createDataFrame(rows, autoencoder._BLOCK).coalesce(1).write.parquet(str(tmp_path / "blocks"))
    blocks, names = spark.read.parquet(str(tmp_path / "blocks")), ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(c) for c in names]
    got = autoencoder._over(blocks, lambda row: np.array([1.0, float(row.name >= 4), row["block"]]))
    assert got.tolist() == [50.0, 0.0, 1225.0]
    assert [spark.conf.get(c) for c in names] == before


def test_draws_that_pairs_share_are_formed_once_with_the_same_quantiles():
    rng = np.random.default_rng(4)
    plan = [(p, "mb", 0, 9, 2, 7) for p in range(20)]
    left, right, counts = scoring.shared_draws(plan, 9, 100, 3)
    assert len(left) <= 63 and (counts.sum(0) == 100).all()
    a, b = rng.integers(0, 4, (30, 9)).astype(float), rng.normal(size=(30, 9))
    for picks in ([94, 95], [0, 1], [50, 51]):
        got = scoring.from_top(a[:, left] * b[:, right], counts, [99 - k for k in picks])
        for k, (pair, _, l0, ln, r0, rn) in enumerate(plan):
            both = a[:, scoring.drawn(pair, 0, l0, ln, 100, 3)] * b[:, scoring.drawn(pair, 1, r0, rn, 100, 3)]
            want = np.partition(both, picks, axis=1)[:, picks]
            assert (got[0][:, k] == want[:, 0]).all() and (got[1][:, k] == want[:, 1]).all()
    assert scoring.shared_draws([(0, "mb", 0, 900, 0, 900)], 900, 100, 3) is None


def test_scores_carry_names_sections_and_gains_without_another_join(spark):
    e = spark.createDataFrame([(1, 2, 0.5, 0.9, 1.0, 1.0, "s"), (2, 1, 0.7, 0.8, 0.0, 1.1, "s"), (3, 4, 0.2, 0.3, 1.0, 1.0, "t")], "src long, dst long, k double, radial double, contact double, g double, section string")
    ex = spark.createDataFrame([(k, g, float(k)) for k in range(1, 5) for g in "abc"], "spot_id long, gene string, value double")
    pairs = spark.createDataFrame([(0, "mb", "a", "b", "p"), (1, "secreted", "b", "c", "q")], "pair_id long, mode string, ligand string, receptor string, pathway string")
    gains = spark.createDataFrame([(2, 1.5), (4, 1.2)], "spot_id long, gain double")
    names = ["ligand", "receptor", "pathway"]
    got = scoring.raw_scores(e, ex, pairs, 0.01, gains, names, keep=["section"], by=["section", "src"])
    want = scoring.modulate(scoring.raw_scores(e, ex, pairs, 0.01), gains).join(pairs.select("pair_id", *names), "pair_id").join(e.select("src", "dst", "section"), ["src", "dst"])
    cols = ["src", "dst", "pair_id", "s", *names, "section"]
    key = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert key(got) == key(want) and len(key(got)) == 6
    assert plan(got).count("Join") < plan(want).count("Join")


def test_thresholds_of_pairs_with_few_and_many_draws_are_taken_together(spark):
    rng = np.random.default_rng(6)
    e = spark.createDataFrame([(k, k % 3, *map(float, rng.random(2)), float(k % 2), 1.1) for k in range(3, 9)], "src long, dst long, k double, radial double, contact double, g double")
    ex = spark.createDataFrame([(k, g, float(rng.integers(0, 5))) for k in range(9) for g in "abcd"], "spot_id long, gene string, value double")
    pairs = spark.createDataFrame([(0, "mb", "a", "b", "p"), (1, "secreted", "b", "c", "q"), (2, "secreted", "c", "a", "q")], "pair_id long, mode string, ligand string, receptor string, pathway string")
    draws = spark.createDataFrame([(p, t, *map(str, rng.choice(list("abcd"), 2))) for p, n in ((0, 5), (1, 2), (2, 5)) for t in range(n)], "pair_id long, t int, gl string, gr string")
    key = lambda df: sorted((r.src, r.dst, r.pair_id, round(r.tau, 12)) for r in df.collect())
    assert key(scoring.null_thresholds_many(e, ex, pairs, draws, 0.01)) == key(scoring.null_thresholds(e, ex, pairs, draws, 0.01))


def test_later_rounds_of_neighbours_spread_the_queries_left(spark):
    rng = np.random.default_rng(8)
    rows = [(k, *map(float, p), int(k % 9 == 0)) for k, p in enumerate(rng.random((150, 2)) * 5)]
    p = spark.createDataFrame(rows, "id long, x double, y double, kind int")
    for r in (0.4, 1.7):
        one, other = (spatial.near_pairs(p.where("id < 50"), p, r, ["kind"], spread_a=s) for s in (False, True))
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    got = sorted((r.src, r.rk, r.dst) for r in spatial.nearest(p, p, 3, ["kind"]).collect())
    want = [(a[0], k, b) for a in rows for k, (_, b) in enumerate(sorted((float(np.hypot(a[1] - b[1], a[2] - b[2])), b[0]) for b in rows if b[0] != a[0] and b[3] == a[3])[:3], 1)]
    assert got == sorted(want)


def shuffled(spark) -> int:
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(spark._jsc.sc().statusStore().executorList(False).apply(k).totalShuffleWrite() for k in range(spark._jsc.sc().statusStore().executorList(False).size()))


def test_what_an_end_expresses_is_not_shuffled_with_every_edge(spark, tmp_path):
    rng = np.random.default_rng(9)
    n, genes, near = 1200, [f"g{k}" for k in range(30)], 12
    value = {(s, g): float(rng.uniform(0.1, 2)) for s in range(-n // 2, n // 2) if s % 100 for g in genes}
    links = [(s, s + o, float(rng.uniform()), 1.0, 1.0, 1.0) for s in range(-n // 2, n // 2) for o in range(1, near + 1)]
    lr = [(k, "secreted" if k % 2 else "mb", genes[k], genes[-1 - k], "p") for k in range(30)]
    spark.createDataFrame(links, "src long, dst long, k double, radial double, contact double, g double").write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([(*k, v) for k, v in value.items()], "spot_id long, gene string, value double").write.parquet(str(tmp_path / "x"))
    e, ex = spark.read.parquet(str(tmp_path / "e")), spark.read.parquet(str(tmp_path / "x"))
    pairs = spark.createDataFrame(lr, "pair_id long, mode string, ligand string, receptor string, pathway string")
    before = shuffled(spark)
    keep = {"keep": [scoring.TILE]} if hasattr(scoring, "TILE") else {}
    got = {(r.src, r.dst): r.total for r in scoring.edge_totals(scoring.raw_scores(e, ex, pairs, 0.01, **keep)).collect()}
    assert shuffled(spark) - before < 2_000_000
    score = lambda x: x / (0.01 + x + 1e-12)
    want = {(s, t): sum(score((w if m != "mb" else c) * value[s, a] * value[t, b]) for _, m, a, b, _ in lr) for s, t, w, _, c, _ in links if (s, a0 := genes[0]) in value and (t, a0) in value}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_tiles_hold_edges_of_any_ids(spark):
    rows = [("a", "b"), ("b", "a"), ("a", "z"), ("a", "a"), ("a", "b"), (None, "a")]
    e = spark.createDataFrame([(s, t, 0.5, 1.0, 1.0, 1.0) for s, t in rows], "src string, dst string, k double, radial double, contact double, g double")
    ex = spark.createDataFrame([("a", "l", 2.0), ("b", "r", 3.0), ("a", "r", 1.0), ("z", "other", 1.0)], "spot_id string, gene string, value double")
    pairs = spark.createDataFrame([(0, "mb", "l", "r")], "pair_id long, mode string, ligand string, receptor string")
    got = scoring.raw_scores(e, ex, pairs, 1.0)
    assert got.columns == ["src", "dst", "pair_id", "s"]
    assert sorted((r.src, r.dst, round(r.s, 6)) for r in got.collect()) == [("a", "a", round(2 / 3, 6)), ("a", "b", round(6 / 7, 6)), ("a", "b", round(6 / 7, 6))]


def test_edges_and_their_reverses_are_summed_once(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.25), (3, 1, 1.0), (2, 2, 4.0), (1, 2, 0.125)], "src long, dst long, w double")
    both = scoring.scatter_add(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "w")
    got = scoring.scatter_both(e, "w")
    assert got.columns == both.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, both.collect()))
    assert plan(got).count("Union") == 0


def _flooded(there):
    """Smallest pixel and size of the 4-connected part of each pixel."""
    out, h, w = {}, *there.shape
    for y, x in zip(*np.nonzero(there), strict=True):
        if (y, x) not in out:
            part, todo = {(y, x)}, [(y, x)]
            while todo:
                a, b = todo.pop()
                new = {(p, q) for p, q in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)) if 0 <= p < h and 0 <= q < w and there[p, q]} - part
                part |= new
                todo += new
            out |= {p: (y * w + x, len(part)) for p in part}
    return {(int(y), int(x)): (int(o), n) for (y, x), (o, n) in out.items()}


def test_parts_are_found_in_tiles_and_only_sides_are_joined(spark, monkeypatch):
    monkeypatch.setattr(raster, "TILE", 5)
    own, joined = raster.components, []
    monkeypatch.setattr(raster, "components", lambda e, a, b: joined.append(e.count()) or own(e, a, b))
    h, w = 23, 17
    there = np.random.default_rng(4).random((h, w)) < 0.58
    mask = spark.createDataFrame([(int(y), int(x)) for y, x in zip(*np.nonzero(there), strict=True)], "y int, x int")
    want, away = _flooded(there), _flooded(~there)
    pixels = lambda df: sorted((r.y, r.x) for r in df.collect())
    assert {(r.y, r.x): r.object for r in raster.objects(mask, w).collect()} == {p: o for p, (o, _) in want.items()}
    assert pixels(raster.drop_small(mask, w, 6)) == sorted(p for p, (_, n) in want.items() if n >= 6)
    assert pixels(raster.fill_holes(mask, w, h, 6)) == sorted([*want, *(p for p, (_, n) in away.items() if n < 6)])
    best = min((-n, o) for o, n in want.values())[1]
    assert pixels(raster.largest_object(mask, w)) == sorted(p for p, (o, _) in want.items() if o == best)
    assert max(joined) <= 4 * w + 3 * h  # pairs of pixels over the sides of tiles
    assert raster.largest_object(mask.where("y < 0"), w).count() == 0


def test_tissue_mask_does_not_depend_on_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = np.where(np.add.outer(np.arange(31) // 6, np.arange(29) // 7) % 2, 0.85, 0.3) + 0.1 * rng.random((31, 29))
    rgb = spark.createDataFrame([(y, x, float(v[y, x]), float(v[y, x]), float(v[y, x])) for y in range(31) for x in range(29) if rng.random() < 0.95], "y int, x int, r double, g double, b double")
    got = []
    for tile in (6, 512):
        monkeypatch.setattr(raster, "TILE", tile)
        got.append({(r.y, r.x) for r in raster.tissue_mask(rgb, 29, 31, least=4).collect()})
    assert got[0] == got[1] and 20 < len(got[0]) < 31 * 29


def test_prepared_scores_are_sorted_only_where_a_pair_reaches_the_quantile(spark):
    rng = np.random.default_rng(6)
    n, own = 30, {}
    for pair, share in ((0, 0.4), (1, 0.02), (2, 0.0)):
        own |= {(i, j, pair): float(rng.random()) if rng.random() < share else 0.0 for i in range(n) for j in range(n)}
    rows = spark.createDataFrame([(*k, s) for k, s in own.items()], "src bigint, dst bigint, pair_id bigint, s double")
    want = {}
    for pair in range(3):
        cells = np.array([own[i, j, pair] if i != j else 0.0 for i in range(n) for j in range(n)])
        want |= {(i, j, pair): min(own[i, j, pair] / max(np.quantile(cells, 0.95), 1e-8), 1.0) for i in range(n) for j in range(n) if i != j}
    got = {(r.src, r.dst, r.pair_id): r.w for r in models.ccc_prep(rows, n).collect()}
    assert set(got) == set(want) and all(abs(got[k] - w) < 1e-9 for k, w in want.items())
    few = rows.where("pair_id > 0")
    lean = models.ccc_prep(few, n, most=44)  # 45 of 900 cells lie above the quantile
    assert "Window" not in plan(lean) and "Join" not in plan(lean)
    assert {(r.src, r.dst, r.pair_id): r.w for r in lean.collect()} == {k: w for k, w in got.items() if k[2]}


def test_scores_of_an_edge_are_brought_together_once(spark):
    rows = spark.createDataFrame([(1, 2, 5, 0.5), (1, 2, 5, 0.7), (1, 2, 9, 0.1), (2, 1, 9, 0.3), (3, 3, 5, 1.0), (1, 3, 5, -1.0)], "src bigint, dst bigint, pair_id bigint, w double")
    got = autoencoder._edges(rows, [5, 9])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.src, r.dst): (round(r.total, 9), r.pos, r.w) for r in got.collect()} == {(1, 2): (0.8, [0, 1], [0.7, 0.1]), (2, 1): (0.3, [1], [0.3])}


def test_tables_are_broadcast_by_their_measured_size_only(spark):
    """A table whose file says little of its rows isn't broadcast by the plan."""
    rows = materialise(spark.range(200_000).select(F.col("id"), (F.col("id") % 2).alias("k")), "rows")
    joined = lambda: rows.join(materialise(rows, "other").withColumnRenamed("k", "l"), "id")._jdf.queryExecution().sparkPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in joined()
    with measured_joins(spark):
        assert "BroadcastHashJoin" not in joined()
        assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == before
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before and "BroadcastHashJoin" in joined()
    got = clustering.micro_niches(spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "id bigint, f array<double>"), spark.createDataFrame([(i, "ab"[i % 2]) for i in range(60)], "id bigint, macro string"), k=4)
    assert hasattr(got, "_tessera_path") and got.count() == 60 and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
