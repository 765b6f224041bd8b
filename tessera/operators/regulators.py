"""What regulators tell about target genes: boosted trees of all targets, grown level by level in shared passes.

Regulators are binned once.  A pass takes every chunk of spots with every group
of targets: a task sums residuals by node, regulator and bin, Spark adds up the
tasks' sums, and for each group the best splits are read off them.  The driver
gets a split for each node of each target.  The number of Spark jobs goes with
trees and depth, not with genes; no task holds all spots or all targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import dbl
from tessera.plans.numbering import number_rows
from tessera.plans.workspace import discard, materialise

CELLS = 1 << 21  # sums that a task holds for a group of targets
CHUNK_BYTES = 1 << 24  # of one chunk's bins and values


def _leaves(reg: np.ndarray, at: np.ndarray, binned: np.ndarray, levels: int) -> np.ndarray:
    """Places in the heap of (spots, targets) after so many levels; a node without a split passes all on to its left."""
    node = np.zeros((len(binned), len(reg)), np.int64)
    rows, cols = np.arange(len(binned))[:, None], np.arange(len(reg))[None]
    for _ in range(levels):
        r = reg[cols, node]
        node = 2 * node + 1 + ((r >= 0) & (binned[rows, np.maximum(r, 0)] > at[cols, node]))
    return node


def _sums(binned: np.ndarray, residual: np.ndarray, node: np.ndarray, nodes: int, bins: int) -> np.ndarray:
    """(regulators, bins, nodes, 2, targets): counts and sums of residuals."""
    inside = node[:, None, :] == np.arange(nodes)[None, :, None]
    x = np.stack([inside, inside * residual[:, None, :]], axis=2).reshape(len(binned), -1).astype(float)
    out = np.zeros((binned.shape[1], bins, x.shape[1]))
    for r in range(binned.shape[1]):
        order = np.argsort(binned[:, r], kind="stable")
        there, first = np.unique(binned[order, r], return_index=True)
        out[r, there] = np.add.reduceat(x[order], first, axis=0)
    return out.reshape(binned.shape[1], bins, nodes, 2, -1)


def _best(sums: np.ndarray, own: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Regulator (-1: none), bin, gain and the means left and right, each (nodes, targets).  own: a target's place among the regulators or -1.

    The gain is what a split takes off the sum of squares; ties go to the first
    regulator, then the lowest bin.  Both sides have ``least`` spots or more.
    """
    left = sums.cumsum(1)[:, :-1]
    whole = sums[0].sum(0)
    n, s = left[:, :, :, 0], left[:, :, :, 1]
    m, t = whole[None, None, :, 0] - n, whole[None, None, :, 1] - s
    with np.errstate(all="ignore"):
        gain = np.where((n >= least) & (m >= least), s * s / n + t * t / m - (whole[:, 1] ** 2 / whole[:, 0])[None, None], -np.inf)
    for col in np.flatnonzero(own >= 0):
        gain[own[col], :, :, col] = -np.inf
    flat = gain.reshape(-1, *gain.shape[2:])
    if not len(flat):
        flat = np.full((1, *gain.shape[2:]), -np.inf)
    pick = flat.argmax(0)
    top = np.take_along_axis(flat, pick[None], 0)[0]
    good = top > 1e-9 * (1 + np.abs(whole[:, 1]))
    with np.errstate(all="ignore"):
        mean = np.where(whole[:, 0] > 0, whole[:, 1] / np.maximum(whole[:, 0], 1), 0.0)
        low, high = mean.copy(), mean.copy()
        if gain.size:
            get = lambda a: np.take_along_axis(a.reshape(flat.shape), pick[None], 0)[0]
            low, high = np.where(good, get(s) / get(n), mean), np.where(good, get(t) / get(m), mean)
    per = max(1, gain.shape[1])
    return np.where(good, pick // per, -1), np.where(good, pick % per, 0), np.where(good, top, 0.0), low, high


def importance(expr: DataFrame, regulators: list[str], targets: list[str] | None = None, spots: DataFrame | None = None, trees: int = 20, depth: int = 3, rate: float = 0.1, bins: int = 32, least: int = 5) -> DataFrame:
    """(regulator, target, importance) of expr (spot_id, gene, value): shares of what the splits of a target's trees explain, 1 in all.

    A spot without a row for a gene has 0 there; ``spots`` (spot_id) adds spots
    without any row.  Rows of one spot and gene are added up; null, NaN and
    infinite values count as 0, rows without a gene or a spot are left out.  targets: all
    genes if left out.  A gene never tells about itself.  Bins end at quantiles
    of a regulator's values, and at 0; these are exact below 10,000 different
    values and approximate above.  Targets that nothing explains have no row.
    No chance is involved.
    """
    if not 2 <= bins <= 256 or depth < 1 or trees < 1 or least < 1:
        raise ValueError("2 to 256 bins, and depth, trees and least from 1")
    spark = expr.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.col("value").cast("double")
    v = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), dbl(0)).otherwise(v)
    rows = materialise(expr.where("spot_id is not null and gene is not null").groupBy("spot_id", "gene").agg(F.sum(v).alias("v")), "values")
    genes = [r.gene for r in rows.select("gene").distinct().orderBy("gene").collect()]
    regs, outs = sorted(set(regulators) & set(genes)), genes if targets is None else sorted(set(targets) & set(genes))
    at = {g: k for k, g in enumerate(sorted({*regs, *outs}))}  # nothing else goes into the chunks
    schema = "regulator string, target string, importance double"
    if not regs or not outs:
        return spark.createDataFrame([], schema)

    # bins of the regulators, chunks of spots, groups of targets
    asked = [k / (bins - 1) for k in range(1, bins - 1)]
    told = rows.join(spark.createDataFrame([(g,) for g in regs], "gene string"), "gene").groupBy("gene").agg(F.percentile_approx("v", asked or [0.5], 10_000).alias("e"))
    ends = {r.gene: np.unique([*(r.e if bins > 2 else []), 0.0]) for r in told.collect()}
    size = max(1, CHUNK_BYTES // (len(regs) + 8 * len(outs)))
    per = max(1, CELLS // (len(regs) * bins * 2 * 2 ** (depth - 1)))
    groups = [list(range(k, min(k + per, len(outs)))) for k in range(0, len(outs), per)]
    known = rows.select("spot_id").distinct() if spots is None else spots.select("spot_id").unionByName(rows.select("spot_id")).where("spot_id is not null").distinct()
    numbered = number_rows(known, "nr", ["spot_id"])
    index = spark.createDataFrame(list(at.items()), "gene string, i int")
    each = rows.join(index, "gene").groupBy("spot_id").agg(F.collect_list("i").alias("i"), F.collect_list("v").alias("v"))
    packed = numbered.join(each, "spot_id", "left").select(F.floor(F.col("nr") / size).alias("chunk"), "nr", "i", "v")
    reg_at, out_at = [at[g] for g in regs], [at[g] for g in outs]

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("nr")
        x = np.zeros((len(own), len(at)))
        for k, (i, v) in enumerate(zip(own["i"], own["v"], strict=True)):
            if i is not None:
                x[k, i] = v
        binned = np.stack([np.searchsorted(ends[g], x[:, k]) for g, k in zip(regs, reg_at, strict=True)], axis=1).astype(np.uint8)
        y = x[:, out_at]
        chunk = int(own["chunk"].iloc[0])
        return pd.DataFrame([(chunk, g, len(own), binned.tobytes() if g < 0 else y[:, groups[g]].tobytes()) for g in range(-1, len(groups))], columns=["chunk", "grp", "n", "data"])

    chunks = materialise(packed.groupBy("chunk").applyInPandas(pack, "chunk bigint, grp int, n int, data binary"), "chunks", (rows,))
    slices = -(-parts // len(groups))
    side = chunks.where("grp < 0").select("chunk", F.col("data").alias("b"))
    both = chunks.where("grp >= 0").join(side, "chunk").repartition(parts, "grp", F.col("chunk") % slices).sortWithinPartitions("grp")

    n = numbered.count()
    total = dict(chunks.where("grp >= 0").mapInPandas(_column_sums({g: len(own) for g, own in enumerate(groups)}), "grp int, v array<double>").groupBy("grp").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect())
    base = np.concatenate([np.asarray(total[g]) for g in range(len(groups))]) / n
    place = {g: k for k, g in enumerate(regs)}
    own_at = np.array([place.get(g, -1) for g in outs])
    width = max(len(e) for e in ends.values()) + 1
    forest: list[tuple] = []
    gains: dict[tuple[int, int], float] = {}
    for _ in range(trees):
        reg, cut = np.full((len(outs), 2**depth - 1), -1), np.zeros((len(outs), 2**depth - 1), int)
        value = np.zeros((len(outs), 2**depth))
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            found = _level(both, groups, forest, (reg, cut), base, rate, level, len(regs), width, own_at, least)
            for g, out in found:
                r, b, gain, low, high = np.asarray(out).reshape(5, nodes, len(groups[g]))
                cols = groups[g]
                reg[cols, first : first + nodes], cut[cols, first : first + nodes] = r.T.astype(int), b.T.astype(int)
                for k, c in zip(*np.nonzero(r >= 0), strict=True):
                    key = (int(r[k, c]), cols[c])
                    gains[key] = gains.get(key, 0.0) + float(gain[k, c])
                if level == depth - 1:
                    value[cols] = np.stack([low, high], axis=1).reshape(2 * nodes, -1).T
        forest.append((reg, cut, value))
    discard(chunks)
    whole = np.zeros(len(outs))
    for (_, t), gain in gains.items():
        whole[t] += gain
    return spark.createDataFrame([(regs[r], outs[t], float(gain / whole[t])) for (r, t), gain in sorted(gains.items())], schema)


def _column_sums(widths: dict[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            for r in own.itertuples():
                yield pd.DataFrame({"grp": [r.grp], "v": [np.frombuffer(r.data).reshape(r.n, widths[r.grp]).sum(0)]})

    return run


def _level(both: DataFrame, groups: list, forest: list, tree: tuple, base: np.ndarray, rate: float, level: int, n_regs: int, bins: int, own_at: np.ndarray, least: int) -> list:
    """(group, best splits of its nodes at this level) from one pass over chunks and groups."""
    nodes, first = 2**level, 2**level - 1

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grp, sums = None, None
        for own in batches:
            for r in own.itertuples():
                cols = groups[r.grp]
                binned = np.frombuffer(r.b, np.uint8).reshape(r.n, n_regs)
                left = np.frombuffer(r.data).reshape(r.n, len(cols)) - base[cols]
                for reg, cut, value in forest:
                    leaf = _leaves(reg[cols], cut[cols], binned, reg.shape[1].bit_length()) - reg.shape[1]
                    left = left - rate * value[cols][np.arange(len(cols))[None], leaf]
                got = _sums(binned, left, _leaves(tree[0][cols], tree[1][cols], binned, level) - first, nodes, bins)
                if r.grp != grp:
                    if grp is not None:
                        yield pd.DataFrame({"grp": [grp], "v": [sums.ravel()]})
                    grp, sums = r.grp, got
                else:
                    sums = sums + got
        if grp is not None:
            yield pd.DataFrame({"grp": [grp], "v": [sums.ravel()]})

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            for r in own.itertuples():
                cols = groups[r.grp]
                sums = np.asarray(r.v).reshape(n_regs, bins, nodes, 2, len(cols))
                yield pd.DataFrame({"grp": [r.grp], "v": [np.stack(_best(sums, own_at[cols], least)).ravel().astype(float)]})

    added = both.mapInPandas(add, "grp int, v array<double>").groupBy("grp").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    return [(r.grp, r.v) for r in added.mapInPandas(choose, "grp int, v array<double>").collect()]
