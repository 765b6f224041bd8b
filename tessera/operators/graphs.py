"""Graphs in edge lists: components, neighbourhoods, summaries, refinement, communities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import dbl
from tessera.plans.components import components
from tessera.plans.numbering import number_rows
from tessera.plans.order_stats import quantile
from tessera.plans.workspace import materialise

from . import spatial
from .communities import _moves

#: A task of Louvain holds up to about so many edges (some 150 bytes each in its dictionaries).
MOST, LEVELS = 250_000, 20


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node; direction doesn't matter, single nodes are their own component."""
    return nodes.select("id").distinct().join(components(edges, "src", "dst").withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("id", F.coalesce("component", "id").alias("component"))


def largest_share(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_components, largest (nodes), share of all nodes."""
    sizes = weak_components(nodes, edges).groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_components"), F.max("n").alias("largest"), (F.max("n") / F.sum("n")).alias("share"))


def h_hop(edges: DataFrame, seeds: DataFrame, hops: int = 2, weak: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, hop) within some hops of the seeds, and the edges among them."""
    step = edges.select("src", "dst")
    if weak:
        step = step.unionByName(step.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = materialise(seeds.select("id").distinct().withColumn("hop", F.lit(0)), "hops")
    front = seen
    for k in range(1, hops + 1):
        new = front.join(step, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(k))
        front = materialise(new, "front")
        if not front.head(1):
            break
        seen = seen.unionByName(front)
    ids = seen.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return seen, inner


def undirected(edges: DataFrame, weight: str = "w") -> DataFrame:
    """(u, v, s), u < v: half the sum of the weights either way."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg((dbl(0.5) * F.sum(weight)).alias("s"))


def prune_by_scores(edges: DataFrame, scores: DataFrame, q: float, eps: float = 1e-12) -> DataFrame:
    """Edges whose score w (0 if absent) reaches the quantile, or eps if the quantile is no more and any score exceeds it."""
    w = edges.join(scores.select("src", "dst", "w"), ["src", "dst"], "left").withColumn("w", F.coalesce("w", dbl(0)))
    w = materialise(w, "scored-edges")
    cut, top = quantile(w, "w", q), w.agg(F.max("w")).first()[0]
    if cut is None:
        return w
    return w.where(F.col("w") >= dbl(eps if cut <= eps < top else cut))


def symmetric_knn(points: DataFrame, k: int) -> DataFrame:
    """(u, v), u < v: pairs either of which is among the other's k nearest, each once."""
    e = spatial.knn(points, k)
    return e.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def degrees_at(points: DataFrame, radius: float) -> DataFrame:
    """(id, degree): number of other points within the radius, 0 included."""
    n = spatial.radius_pairs(points, radius).groupBy("src").agg(F.count("*").alias("n"))
    return points.select("id").join(n, F.col("id") == F.col("src"), "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))


def _four(rows: DataFrame, col: str, name: str) -> DataFrame:
    stats = rows.agg(F.min(col).cast("double").alias("a"), F.expr(f"percentile({col}, 0.5D)").alias("b"), F.expr(f"percentile({col}, 0.9D)").alias("c"), F.max(col).cast("double").alias("d"))
    return stats.select(F.expr(f"stack(4, '{name}_min', a, '{name}_med', b, '{name}_p90', c, '{name}_max', d) as (item, v)"))


def report(points: DataFrame, edges: DataFrame, h: float, radius: float, a_cap: float = 3.0) -> DataFrame:
    """(item, v): size, lengths over h, degrees, shares of long edges, components and kernel values of a graph with k.

    Edges that carry the anisotropy ``a`` and its ``ratio`` have their figures too,
    and the shares of edges that are isotropic or at the cap.
    """
    n = points.count()
    e = edges.withColumn("len", F.col("d") / dbl(h))
    out = points.select("id").join(e.groupBy("src").agg(F.count("*").alias("o")), F.col("id") == F.col("src"), "left").select(F.coalesce("o", F.lit(0)).cast("double").alias("out"))
    into = points.select("id").join(e.groupBy("dst").agg(F.count("*").alias("i")), F.col("id") == F.col("dst"), "left").select(F.coalesce("i", F.lit(0)).cast("double").alias("inn"))
    flat = e.agg(
        F.count("*").cast("double").alias("E"), (F.count("*") / dbl(n)).alias("k_mean"), F.avg((F.col("d") > dbl(radius)).cast("double")).alias("frac_beyond_R"), F.avg((F.col("len") > 2).cast("double")).alias("frac_beyond_2h"),
        *(F.max(F.isnan(c).cast("double")).alias(name) for c, name in (("k", "any_nan"), ("a", "any_nan_a"), ("ratio", "any_nan_r")) if c in e.columns), F.min(F.col("k").between(0, 1).cast("double")).alias("k_within_0_1"),
        *([F.avg((F.abs(F.col("a") - 1) < 1e-6).cast("double")).alias("frac_isotropic"), F.avg((F.col("a") > a_cap - 1e-6).cast("double")).alias("frac_near_cap")] if "a" in e.columns else []),
    )
    parts = largest_share(points, edges).select(F.col("n_components").cast("double").alias("components"), F.col("largest").cast("double").alias("largest"))
    at = {r: materialise(degrees_at(points, r * h).select(F.col("degree").cast("double").alias("degree")), "degrees") for r in (2.0, 2.2)}
    deg = [at[r].agg(F.avg("degree").alias(f"degree_{r}h"), F.avg((F.col("degree") < 10).cast("double")).alias(f"under10_{r}h"), F.avg((F.col("degree") > 18).cast("double")).alias(f"over18_{r}h")) for r in (2.0, 2.2)]
    rows = _four(e, "len", "len").unionByName(_four(out, "out", "out")).unionByName(_four(into, "inn", "in")).unionByName(_four(e, "k", "kernel"))
    for r in (2.0, 2.2):
        rows = rows.unionByName(_four(at[r], "degree", f"degree_{r}h".replace(".", "_")))
    for c, name in (("a", "a"), ("ratio", "r")):
        rows = rows.unionByName(_four(e, c, name)) if c in e.columns else rows
    for one in (flat, parts, *deg):
        pairs = ", ".join(f"'{c.replace('.', '_')}', `{c}`" for c in one.columns)
        rows = rows.unionByName(one.select(F.expr(f"stack({len(one.columns)}, {pairs}) as (item, v)")))
    sized = points.sparkSession.createDataFrame([("N", float(n)), ("h", float(h))], "item string, v double")
    return rows.unionByName(sized)


def hints(items: dict[str, float]) -> list[str]:
    """What the figures of a report ask for."""
    out = []
    if items.get("components", 1) > 1:
        out.append("more than one component: raise the radius or the least degree")
    if items.get("k_mean", 12) < 10:
        out.append("few neighbours: raise the radius")
    if items.get("k_mean", 12) > 18:
        out.append("many neighbours: lower the radius or the largest degree")
    if items.get("frac_isotropic", 0) > 0.9:
        out.append("nearly all edges are isotropic: check the bands or lower the least anisotropy")
    return out


@dataclass
class Tuned:
    alpha: float
    degree: float
    share: float


def tune_alpha(points: DataFrame, h: float, alpha: float, degrees: tuple[float, float] = (12, 22), share: float = 0.9, rounds: int = 12, bounds: tuple[float, float] = (0.9, 4.0)) -> tuple[Tuned, DataFrame]:
    """Bisection on the radius over h until the mean out-degree is in range and the largest component holds enough.

    The widest graph is made once; each round filters it.
    """
    widest = materialise(spatial.radius_pairs(points, bounds[1] * h), "widest")
    n = points.count()
    low, high = bounds
    got = Tuned(alpha, 0.0, 0.0)
    for _ in range(rounds):
        own = widest.where(F.col("d") <= dbl(alpha * h))
        degree = own.count() / max(n, 1)
        if not degree:
            got, low = Tuned(alpha, 0.0, 0.0), alpha
            alpha = min(max(1.25 * alpha, alpha + 0.1), bounds[1])
            continue
        part = largest_share(points, own).first()["share"]
        got = Tuned(alpha, degree, part)
        if degrees[0] <= degree <= degrees[1] and part >= share:
            break
        if degree > degrees[1]:
            high = alpha
        else:
            low = alpha
        alpha = (low + high) / 2
    return got, widest.where(F.col("d") <= dbl(got.alpha * h))


def refine(points: DataFrame, label: str, scores: DataFrame, q: float = 0.5, fallback: float = 2.3) -> dict:
    """Spacing by class, radius from the knee, tuned graph, edges pruned by their scores, undirected summary."""
    by = spatial.class_spacing(points, label).agg(F.expr("percentile(h, 0.5)")).first()[0]
    h = by or spatial.spacing(points)
    found = spatial.knee(spatial.pooled_knn(points), h).first()[0]
    tuned, first = tune_alpha(points, h, found or fallback)
    kept = prune_by_scores(first, scores, q)
    return {"edges0": first, "edges": kept, "undirected": undirected(kept), "meta": {"h": h, "alpha0": found or fallback, "alpha": tuned.alpha, "degree": tuned.degree, "lcc": tuned.share}}


def louvain(nodes: np.ndarray, pairs: np.ndarray, weights: np.ndarray, resolution: float = 1.0, seed: int = 0, degrees: np.ndarray | None = None, total: float | None = None, levels: int | None = None) -> np.ndarray:
    """Community of each node by greedy modularity with aggregation; numpy on one group's graph, or on a block of it.

    degrees, total: of the nodes and of all nodes of the group, if edges to other blocks count as well.  levels: aggregations at most.
    """
    n = len(nodes)
    at = {v: i for i, v in enumerate(nodes.tolist())}
    u, v = (np.array([at[x] for x in pairs[:, k].tolist()], int) for k in (0, 1)) if len(pairs) else (np.zeros(0, int), np.zeros(0, int))
    home, rng = np.arange(n), np.random.default_rng(seed)
    w, given = weights.astype(float), total
    while levels is None or levels > 0:
        m = max(int(home.max(initial=-1)) + 1, 0)
        links: list[dict[int, float]] = [{} for _ in range(m)]
        loops = np.zeros(m)
        for a, b, x in zip(u, v, w, strict=True):
            if a == b:
                loops[a] += x
            else:
                links[a][b] = links[a].get(b, 0.0) + x
                links[b][a] = links[b].get(a, 0.0) + x
        degree = np.array([sum(d.values()) for d in links]) + 2 * loops if degrees is None else np.bincount(home, degrees, m)
        total = degree.sum() if given is None else given
        if not total:
            return home
        group, size = np.arange(m), degree.copy()
        moved = False
        for _ in range(20):
            change = 0
            for i in rng.permutation(m):
                near: dict[int, float] = {}
                for j, x in links[i].items():
                    near[group[j]] = near.get(group[j], 0.0) + x
                own = group[i]
                size[own] -= degree[i]
                gain = {g: x - resolution * degree[i] * size[g] / total for g, x in near.items()}
                best = max(sorted(gain), key=gain.get, default=own)
                stay = near.get(own, 0.0) - resolution * degree[i] * size[own] / total
                if gain.get(best, -np.inf) <= stay + 1e-12:
                    best = own
                group[i] = best
                size[best] += degree[i]
                change += best != own
            moved |= change > 0
            if not change:
                break
        if not moved:
            return home
        _, dense = np.unique(group, return_inverse=True)
        home, u, v = dense[home], dense[u], dense[v]
        levels = levels if levels is None else levels - 1
    return home


def communities(edges: DataFrame, group: str, resolution: float = 1.0, seed: int = 0, places: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """(id, group, community) by Louvain within each group; edges carry (group, u, v), and no node is in two groups.

    A task holds the graph of one group of up to about ``most`` edges.  Larger ones are put together in levels first (see
    ``_levels``), until what is left of them is as small; places (id, x, y), if known, tell which nodes go together.
    """
    edges = edges if hasattr(edges, "_tessera_path") else materialise(edges.select(group, "u", "v"), "communities")
    sizes = edges.groupBy(group).agg(F.count("*").alias("n"))
    large = materialise(sizes.where(F.col("n") > most).select(F.col(group).alias("_group")), "large")
    if not large.head(1):
        return _communities(edges, group, resolution, seed)
    mine = F.col(group).eqNullSafe(F.col("_group"))
    small = _communities(edges.join(F.broadcast(large), mine, "left_anti"), group, resolution, seed)
    return small.unionByName(_levels(edges.join(F.broadcast(large), mine, "left_semi"), group, resolution, seed, places, most))


def _communities(edges: DataFrame, group: str, resolution: float, seed: int) -> DataFrame:
    kind = edges.schema[group].dataType.simpleString()

    def run(df: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(df[["u", "v"]].to_numpy())
        label = louvain(nodes, df[["u", "v"]].to_numpy(), np.ones(len(df)), resolution, seed)
        return pd.DataFrame({"id": nodes, group: df[group].iloc[0], "community": label})

    return edges.groupBy(group).applyInPandas(run, f"id bigint, {group} {kind}, community bigint")


def _ranked(edges: DataFrame, group: str, places: DataFrame | None) -> DataFrame:
    """(id, g, r): nodes numbered along a curve through their places (a Z curve on 2^16 steps), or in the order of their ids."""
    nodes = edges.select(F.col(group).alias("g"), F.explode(F.array("u", "v")).alias("id")).distinct()
    if places is None:
        return number_rows(nodes, "r", ["g", "id"])
    own = nodes.join(places.select("id", "x", "y"), "id", "left")
    ends = own.agg(*(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max)))).first()

    def spread(c: str):
        low, high = ends[f"lo{c}"] or 0.0, ends[f"hi{c}"] or 0.0
        z = F.coalesce(F.floor((F.col(c) - dbl(low)) / dbl((high - low) or 1.0) * dbl(65535)), F.lit(0)).cast("bigint")
        for bits, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            z = z.bitwiseOR(F.shiftleft(z, bits)).bitwiseAND(F.lit(mask).cast("bigint"))
        return z

    return number_rows(own.select("id", "g", spread("x").bitwiseOR(F.shiftleft(spread("y"), 1)).alias("z")), "r", ["g", "z", "id"]).drop("z")


def _block_moves(links: DataFrame, nodes: DataFrame, resolution: float, seed: int, levels: int | None) -> DataFrame:
    """(u, c): Louvain on the links (g, b, u, v, w) and nodes (g, b, u, k, m2) of each block b; c is the least node of a community."""
    rows = links.select("g", "b", "u", "v", "w", dbl(0).alias("m2")).unionByName(nodes.select("g", "b", "u", F.lit(-1).cast("bigint").alias("v"), F.col("k").alias("w"), "m2"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        own = df.v.to_numpy() < 0
        node, pair = df[own].sort_values("u"), df[~own].sort_values(["u", "v"])
        ids = node.u.to_numpy()
        label = louvain(ids, pair[["u", "v"]].to_numpy(), pair.w.to_numpy(), resolution, seed, node.w.to_numpy(), node.m2.iloc[0], levels)
        _, first, at = np.unique(label, return_index=True, return_inverse=True)
        return pd.DataFrame({"u": ids, "c": ids[first][at]})

    return rows.groupBy("g", "b").applyInPandas(run, "u bigint, c bigint")


def _levels(edges: DataFrame, group: str, resolution: float, seed: int, places: DataFrame | None, most: int) -> DataFrame:
    """The communities of groups whose graphs are too large for one task.

    Nodes are numbered by place and cut in blocks.  A level lets them move within their block, by gains that count all edges and
    the group's whole weight, and makes each community a node, named after its least member and so still in order.  Where blocks
    tell little apart (a level leaves more than half of the edges), nodes move in rounds of joins over the whole graph.  Once a
    group's graph has no more than ``most`` edges, it is finished in one task.
    """
    rank = materialise(_ranked(edges, group, places), "ranks")
    number = lambda c, to: rank.select(F.col("id").alias(c), F.col("r").alias(to), *(["g"] if c == "u" else []))
    ends = edges.where("u <> v").select("u", "v").join(number("u", "a"), "u").join(number("v", "b"), "v")
    links = materialise(ends.groupBy("g", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum(dbl(1)).alias("w")), "links")
    k = links.select("g", F.explode(F.array("u", "v")).alias("u"), "w").groupBy("g", "u").agg(F.sum("w").alias("k"))
    start = rank.select("g", F.col("r").alias("u")).join(k.drop("g"), "u", "left").withColumn("k", F.coalesce("k", dbl(0)))
    m2 = links.groupBy(F.col("g").alias("_g")).agg((2 * F.sum("w")).alias("m2"))
    nodes = materialise(start.join(F.broadcast(m2), F.col("g").eqNullSafe(F.col("_g")), "left").select("g", "u", "k", F.coalesce("m2", dbl(0)).alias("m2")), "nodes")
    home = rank.select("id", "g", F.col("r").alias("u"))
    span = F.broadcast(materialise(nodes.groupBy(F.col("g").alias("_g")).agg(F.min("u").alias("_lo"), (F.max("u") + 1).alias("_hi")), "spans"))
    for level in range(LEVELS):
        count = F.broadcast(materialise(links.groupBy(F.col("g").alias("_h")).agg(F.count("*").alias("_n")), "sizes"))
        blocks = span.join(count, F.col("_g").eqNullSafe(F.col("_h")), "left").select("_g", "_lo", "_hi", F.ceil(F.coalesce("_n", F.lit(0)) / dbl(most)).alias("_blocks"))
        last = not blocks.where("_blocks > 1").head(1)
        block = F.floor((F.col("u") - F.col("_lo")) * F.greatest("_blocks", F.lit(1)) / (F.col("_hi") - F.col("_lo"))).cast("bigint")
        placed = materialise(nodes.join(F.broadcast(blocks), F.col("g").eqNullSafe(F.col("_g"))).withColumn("b", block).select("g", "b", "u", "k", "m2"), "placed")
        inner = links.join(placed.select("u", "b"), "u").join(placed.select(F.col("u").alias("v"), F.col("b").alias("_b")), "v").where("b = _b").drop("_b")
        to = materialise(_block_moves(inner, placed, resolution, seed, None if last else 1), "moves")
        home, links, nodes, before, after = _put_together(home, links, nodes, to)
        if last:
            break
        if after > before / 2:
            both = links.select("u", "v", "w").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
            got = _moves(both, nodes.select(F.col("u").alias("id"), "k", "m2", F.col("u").alias("c")), resolution, seed + level)
            to = materialise(got.select(F.col("id").alias("u"), "c"), "moves")
            home, links, nodes, _, left = _put_together(home, links, nodes, to)
            if left == after:
                break
    names = home.select("g", "u").distinct().select(F.col("u").alias("_u"), (F.row_number().over(Window.partitionBy("g").orderBy("u")) - 1).cast("bigint").alias("community"))
    return home.join(names, F.col("u") == F.col("_u")).select("id", F.col("g").alias(group), "community")


def _put_together(home: DataFrame, links: DataFrame, nodes: DataFrame, to: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """Homes, links and nodes once nodes are their communities (u, c), and how many links there were and are."""
    now = home.join(to, "u").select("id", "g", F.col("c").alias("u"))
    over = links.join(to.withColumnRenamed("c", "a"), "u").join(to.select(F.col("u").alias("v"), F.col("c").alias("b")), "v").where("a <> b")
    over = materialise(over.groupBy("g", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("w").alias("w")), "links")
    own = nodes.join(to, "u").groupBy("g", F.col("c").alias("u")).agg(F.sum("k").alias("k"), F.min("m2").alias("m2"))
    return materialise(now, "homes"), over, materialise(own, "nodes"), links.count(), over.count()


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, q: of a partition (id, community) of an undirected graph (u, v)."""
    own = edges.join(labels.select(F.col("id").alias("u"), F.col("community").alias("cu")), "u").join(labels.select(F.col("id").alias("v"), F.col("community").alias("cv")), "v")
    m = F.broadcast(own.agg(F.count("*").alias("m")))
    inner = own.where("cu = cv").groupBy(F.col("cu").alias("c")).agg(F.count("*").alias("inner"))
    ends = own.select(F.explode(F.array("cu", "cv")).alias("c")).groupBy("c").agg(F.count("*").alias("deg"))
    terms = ends.join(inner, "c", "left").join(m)
    return terms.agg(F.sum(F.coalesce("inner", F.lit(0)) / F.col("m") - dbl(resolution) * F.pow(F.col("deg") / (2 * F.col("m")), dbl(2))).alias("q"))


def degree_rank(edges: DataFrame) -> DataFrame:
    """(src, n, rk): sources by out-degree."""
    return edges.groupBy("src").agg(F.count("*").alias("n")).withColumn("rk", F.rank().over(Window.orderBy(F.desc("n"))))
