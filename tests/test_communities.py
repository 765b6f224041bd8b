"""Leiden over edge tables: planted groups, connectedness, and modularity against Louvain's."""

import numpy as np
import pandas as pd

from tessera.operators import communities, graphs


def planted(rng, blocks, size, inner, outer):
    n = blocks * size
    a = rng.integers(0, n, inner)
    pairs = np.concatenate([np.stack([a, a // size * size + rng.integers(0, size, inner)], 1), rng.integers(0, n, (outer, 2))])
    return np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)


def modularity(e, label):
    k = np.bincount(e.ravel(), minlength=len(label))
    _, c = np.unique(label, return_inverse=True)
    return (label[e[:, 0]] == label[e[:, 1]]).mean() - ((np.bincount(c, k) / (2 * len(e))) ** 2).sum()


def parts(e, label):
    """Connected parts of all communities together."""
    root = np.arange(len(label))
    for _ in range(len(label)):
        new = root.copy()
        for a, b in e[label[e[:, 0]] == label[e[:, 1]]]:
            new[a] = new[b] = min(new[a], new[b])
        if (new == root).all():
            break
        root = new
    return len(np.unique(root))


def test_groups_are_partitioned_at_once(spark):
    """Two graphs in one call: clear blocks are found, faint ones at least as well as by Louvain; loops and doubled edges don't matter."""
    rng = np.random.default_rng(5)
    graph = {"clear": planted(rng, 6, 20, 900, 60), "faint": planted(rng, 5, 30, 500, 250)}
    shift = {"clear": 0, "faint": 1000}
    rows = pd.concat([pd.DataFrame({"u": e[:, 0] + shift[g], "v": e[:, 1] + shift[g], "macro": g, "w": 0.5}) for g, e in graph.items()])
    rows = pd.concat([rows, rows.rename(columns={"u": "v", "v": "u"}), pd.DataFrame({"u": [3], "v": [3], "macro": ["clear"], "w": [9.0]})])
    got = communities.leiden(spark.createDataFrame(rows), "macro").toPandas()
    for g, e in graph.items():
        own = got[got.macro == g]
        assert set(own.id) == set(np.unique(e) + shift[g])
        label = np.full(e.max() + 1, -1)
        label[own.id - shift[g]] = own.community
        met = np.unique(e)
        assert parts(e, label) - (len(label) - len(met)) == len(set(own.community))  # every community is one part
        assert all(own.groupby("community").id.min() == own.groupby("community").community.first())
        assert modularity(e, label) >= modularity(e, graphs.louvain(np.arange(e.max() + 1), e, np.ones(len(e)))) - 1e-9
        if g == "clear":
            assert len(set(map(tuple, np.stack([label[met], met // 20], 1)))) == 6


def test_no_edges(spark):
    assert communities.leiden(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
