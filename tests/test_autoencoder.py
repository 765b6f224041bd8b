"""The autoencoder: gradients against finite differences, the tables behind it against numpy, fitting, saving and going on."""

import numpy as np
import pytest

from tessera.operators import autoencoder as ae

SMALL = ae.Config(embed=4, units=6, hidden=7, clusters=3, epochs=12, batch=512, dec_every=4, rate=5e-3)


def block(rng, n=9, width=7, pairs=3, seeds=6):
    cells = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (30, 2)) if a != b})
    src, dst = (np.array(c) for c in zip(*cells, strict=True))
    rank = np.array([sum(s == a for s in src[:k]) + 1 for k, a in enumerate(src)])
    edge = np.repeat(np.arange(len(src)), 2)
    pair = np.tile([0, 2], len(src)) if pairs > 2 else np.zeros(2 * len(src), int)
    return ae.Block(seeds, rng.normal(size=(n, width)), src, dst, rank, edge, pair, rng.random(len(edge)))


@pytest.fixture
def made(spark):
    rng = np.random.default_rng(5)
    group = rng.integers(0, 3, 60)
    tf, one = rng.normal(size=(60, 5)) + 3 * group[:, None], np.eye(3)[group]
    rows = {"tf": tf, "onehot": one}
    views = {k: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, f array<double>") for k, x in rows.items()}
    cells = [(int(a), int(b), f"p{k}", float(rng.random())) for a, b in rng.integers(0, 60, (300, 2)) if a != b and group[a] == group[b] for k in range(2)]
    cells = list({c[:3]: c for c in cells}.values())
    return views, spark.createDataFrame(cells, "src bigint, dst bigint, pair_id string, w double"), rows, cells


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_gradients_equal_finite_differences(dropout):
    rng = np.random.default_rng(3)
    c = ae.replace(SMALL, dropout=dropout, positives=2, reconstruction=1.3, laplacian=0.7, contrast=0.9, dec=0.8)
    views = {"tf": 4, "onehot": 3}
    model = ae.Model(views, list("abc"), c, {}, {})
    p = {k: v + rng.normal(0, 0.1, v.shape) for k, v in ae.initial(views, 3, c).items()}
    frozen, mass = {k: v + rng.normal(0, 0.05, v.shape) for k, v in p.items()}, rng.random(3) + 1
    b = block(rng)
    run = lambda: ae.block_gradients(p, model, b, 20, frozen, mass, np.random.default_rng(1))
    g = run()[0]
    for name, w in p.items():
        for at in rng.choice(w.size, min(w.size, 6), replace=False):
            cell, h = np.unravel_index(at, w.shape), 1e-5
            was = w[cell]
            w[cell] = was + h
            up = run()[1][0]
            w[cell] = was - h
            down = run()[1][0]
            w[cell] = was
            assert g[name][cell] == pytest.approx((up - down) / (2 * h), rel=2e-4, abs=1e-7), (name, cell)


def test_one_block_is_the_whole_graph_and_agrees_with_latent(spark, made):
    views, ccc, rows, cells = made
    model = ae.fit(views, ccc, ae.replace(SMALL, epochs=1, neighbours=60))
    mean, scale = model.scaling["tf"]
    assert np.allclose(mean, rows["tf"].mean(0)) and np.allclose(scale, rows["tf"].std(0))
    x = np.concatenate([(rows["tf"] - mean) / scale, rows["onehot"]], axis=1)
    edges = sorted({c[:2] for c in cells})
    at, src, dst = {e: k for k, e in enumerate(edges)}, *(np.array(c) for c in zip(*edges, strict=True))
    b = ae.Block(60, x, src, dst, np.ones(len(src)), np.array([at[c[:2]] for c in cells]), np.array([int(c[2][1]) for c in cells]), np.array([c[3] for c in cells]))
    want = ae.block_latent(model.weights, model, b)
    got = {r.id: r.f for r in ae.latent(model, views, ccc).collect()}
    assert sorted(got) == list(range(60))
    assert max(np.abs(np.array(got[i]) - want[i]).max() for i in range(60)) < 1e-9
    start = ae.Model(model.views, model.pairs, model.config, model.scaling, ae.initial(model.views, 2, model.config))
    blocks = ae._blocks(ae._scaled(ae._joint(views), model), ae._edges(ccc, model.pairs), model.config)
    mass = ae._shares(ae.block_latent(start.weights, start, b), start.weights["centres"])[0].sum(0)
    assert blocks.count() == 1 and np.allclose(ae._mass(blocks, start), mass)


@pytest.mark.parametrize("batch", [512, 16])
def test_loss_falls_and_groups_come_apart(spark, made, batch):
    views, ccc, rows, _ = made
    model = ae.fit(views, ccc, ae.replace(SMALL, batch=batch, dropout=0.0, epochs=15))
    told = [h["total"] for h in model.history]
    assert len(told) == 15 and told[-1] < 0.8 * told[0]
    assert model.history[-1]["reconstruction"] < model.history[0]["reconstruction"]
    z = np.array([r.f for r in ae.latent(model, views, ccc).orderBy("id").collect()])
    group = rows["onehot"].argmax(1)
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    same = group[:, None] == group[None]
    assert d[same].mean() < 0.5 * d[~same].mean()


def test_saved_loaded_and_gone_on_from(spark, made, tmp_path):
    views, ccc, *_ = made
    model = ae.fit(views, ccc, ae.replace(SMALL, epochs=3))
    ae.save(spark, model, str(tmp_path))
    ae.save(spark, model, str(tmp_path))
    back = ae.load(spark, str(tmp_path))
    assert back.config == model.config and back.views == model.views and back.pairs == model.pairs and back.history == model.history
    assert all(np.array_equal(back.weights[k], v) for k, v in model.weights.items()) and set(back.weights) == set(model.weights)
    one, two = (ae.latent(m, views, ccc).orderBy("id").collect() for m in (model, back))
    assert max(np.abs(np.array(a.f) - np.array(b.f)).max() for a, b in zip(one, two, strict=True)) < 1e-9
    on = ae.fit(views, ccc, ae.replace(SMALL, epochs=2), start=back)
    assert len(on.history) == 5 and on.history[3]["total"] < model.history[0]["total"]


def test_same_seed_gives_the_same_weights_and_patience_ends(spark, made):
    views, ccc, *_ = made
    a, b = (ae.fit(views, ccc, ae.replace(SMALL, epochs=2, batch=16)) for _ in range(2))
    assert all(np.allclose(a.weights[k], b.weights[k], rtol=0, atol=1e-10) for k in a.weights)
    still = ae.fit(views, ccc, ae.replace(SMALL, epochs=9, rate=0.0, dropout=0.0, patience=2))
    assert len(still.history) == 3


def test_missing_views_scores_and_neighbours(spark):
    nan = float("nan")
    tf = spark.createDataFrame([(1, [1.0, nan]), (2, [2.0, None]), (3, None), (4, [0.0, 1.0]), (None, [1.0, 1.0])], "id bigint, f array<double>")
    gene = spark.createDataFrame([(1, [1.0]), (2, [5.0]), (3, [1.0]), (4, [1.0])], "id bigint, f array<double>")
    ccc = spark.createDataFrame([(1, 2, 7, 0.5), (1, 2, 7, 0.4), (1, 3, 7, 1.0), (2, 2, 7, 1.0), (2, 1, 8, nan), (2, 1, 8, None), (2, 1, 7, -1.0)], "src bigint, dst bigint, pair_id bigint, w double")
    views = {"tf": tf, "gene": gene}
    model = ae.fit(views, ccc, ae.replace(SMALL, epochs=2))
    got = {r.id: r.f for r in ae.latent(model, views, ccc).collect()}
    assert sorted(got) == [1, 2, 4] and np.isfinite(list(got.values())).all()
    none = ae.fit(views, ccc.where("false"), ae.replace(SMALL, epochs=1))
    assert none.pairs == [] and ae.latent(none, views, ccc.where("false")).count() == 3
    with pytest.raises(ValueError, match="no spot"):
        ae.fit({"tf": tf.where("false")}, ccc, SMALL)
    with pytest.raises(ValueError, match="differ in length"):
        ae.fit({"tf": tf.union(spark.createDataFrame([(9, [1.0])], tf.schema))}, ccc, SMALL)
