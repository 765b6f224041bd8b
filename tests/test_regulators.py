"""Regulators of target genes against boosted trees grown one by one on the whole table."""

import numpy as np
import pytest

from tessera.operators import regulators


def rows_of(spark, x, names, keep=lambda v: v != 0):
    return spark.createDataFrame([(i, g, float(x[i, k])) for i in range(len(x)) for k, g in enumerate(names) if keep(x[i, k])], "spot_id bigint, gene string, value double")


def one_by_one(x, names, regs, target, trees, depth, rate, least):
    """Plain greedy trees: every split at every value of every regulator, spot by spot."""
    cols = [names.index(r) for r in sorted(regs) if r != target]
    y = x[:, names.index(target)] - x[:, names.index(target)].mean()
    told = dict.fromkeys((names[c] for c in cols), 0.0)

    def grow(at, level):
        best = None
        s = y[at].sum()
        if level < depth:
            for c in cols:
                for cut in np.unique(x[at, c])[:-1]:
                    low = at[x[at, c] <= cut]
                    high = at[x[at, c] > cut]
                    if min(len(low), len(high)) >= least:
                        gain = y[low].sum() ** 2 / len(low) + y[high].sum() ** 2 / len(high) - s * s / len(at)
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, c, low, high)
        if best is None or best[0] <= 1e-9 * (1 + abs(s)):
            return [(at, y[at].mean())]
        told[names[best[1]]] += best[0]
        return grow(best[2], level + 1) + grow(best[3], level + 1)

    for _ in range(trees):
        for at, mean in grow(np.arange(len(x)), 0):
            y[at] -= rate * mean
    whole = sum(told.values())
    return {(r, target): v / whole for r, v in told.items() if v > 0}


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 5, (120, 6)).astype(float)
    x[:, 4] = 3 * x[:, 0] + x[:, 1] * (x[:, 2] > 2) + rng.normal(size=120)
    x[:, 5] = np.where(x[:, 3] > 1, x[:, 0], -x[:, 2]) + rng.normal(size=120)
    return x, list("ABCDST")


@pytest.mark.parametrize(("cells", "size", "depth"), [(1 << 21, 1 << 24, 3), (1, 400, 2), (200, 900, 1)])
def test_equal_to_trees_one_by_one(spark, made, monkeypatch, cells, size, depth):
    x, names = made
    monkeypatch.setattr(regulators, "CELLS", cells)
    monkeypatch.setattr(regulators, "CHUNK_BYTES", size)
    got = {(r.regulator, r.target): r.importance for r in regulators.importance(rows_of(spark, x, names), list("ABCD"), trees=4, depth=depth, rate=0.3, least=3).collect()}
    want = {k: v for t in names for k, v in one_by_one(x, names, "ABCD", t, 4, depth, 0.3, 3).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_planted_regulators_come_first(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.gamma(2, 2, (400, 8)), 3)
    x[:, 6] = 2 * x[:, 1] + rng.normal(size=400)
    x[:, 7] = x[:, 3] * (x[:, 4] > 4) + 0.1 * rng.normal(size=400)
    names = [f"g{k}" for k in range(8)]
    rows = regulators.importance(rows_of(spark, x, names), names[:6], ["g6", "g7"], trees=6).collect()
    by = {t: sorted(((r.importance, r.regulator) for r in rows if r.target == t), reverse=True) for t in ("g6", "g7")}
    assert by["g6"][0][1] == "g1" and {r for _, r in by["g7"][:2]} == {"g3", "g4"}
    assert all(sum(v for v, _ in by[t]) == pytest.approx(1) for t in by)


def test_jobs_do_not_grow_with_genes(spark, made, monkeypatch):
    x, names = made
    monkeypatch.setattr(regulators, "CELLS", 1)
    counts = []
    for targets in (["S"], names):
        spark.sparkContext.setJobGroup(f"regulators-{len(targets)}", "")
        regulators.importance(rows_of(spark, x, names), list("ABCD"), targets, trees=2, depth=2)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"regulators-{len(targets)}")))
    spark.sparkContext.setJobGroup("", "")
    assert 0 < counts[1] <= counts[0] + 4


def test_missing_repeated_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    base = [(i, "R", float(i % 2)) for i in range(20)] + [(i, "T", float(i % 2)) for i in range(20)] + [(i, "flat", 1.0) for i in range(20)]
    odd = [(None, "R", 1.0), (3, None, 1.0), (4, "R", nan), (4, "T", None), (6, "R", inf), (5, "R", 0.0)]
    df = spark.createDataFrame(base + odd, "spot_id bigint, gene string, value double")
    got = [tuple(r) for r in regulators.importance(df, ["R", "absent"], trees=2).collect()]
    assert got == [("R", "T", 1.0)]
    wider = regulators.importance(df, ["R"], ["T", "absent"], spark.range(40).withColumnRenamed("id", "spot_id"), trees=2).collect()
    assert [tuple(r) for r in wider] == got
    assert regulators.importance(df.where("false"), ["R"]).count() == 0
    assert regulators.importance(df, ["absent"]).count() == 0
    assert regulators.importance(df, ["R"], ["R"]).count() == 0
    with pytest.raises(ValueError):
        regulators.importance(df, ["R"], bins=1)
