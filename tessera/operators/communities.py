"""Leiden communities over edge tables: moves, refinement and aggregation are rounds of joins, so no graph is in one task.

Quality is modularity with a resolution, by group: several graphs that share no edge are partitioned at once,
each with its own total weight.  A level has three phases.

* Moves.  Each node weighs the communities of its neighbours; of those that gain by a move, half (by a hash of node
  and round) go to the best.  Halving keeps neighbours from swapping places for ever.  Rounds go on until none gains, or
  until a round moves so few that the next level can see to them.
* Refinement.  Within a community every node starts alone.  Nodes that are well connected to the community and still
  alone join the best sub-community that is well connected itself and that a coin says stays put in this
  round; so sub-communities only grow by neighbours of members that stay, and are connected.
* Aggregation.  Sub-communities become the nodes of the next level and start in the community of the level before.

Levels end when nothing can be put together.  A community that moves have left in several parts is split into
them, which never lowers modularity.  Labels are the smallest node of each community.  A node without edges isn't
in an edge table and so has no label.  Loops don't count; parallel edges add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import dbl
from tessera.plans.components import components
from tessera.plans.workspace import discard, materialise

ROUNDS, LEVELS, EPS = 16, 12, 1e-12
#: A round of moves is the last if it moves fewer than this share of the nodes.
FEW = 0.002
#: Refinement ends after two rounds that move no more than this share of the nodes; the next level sees to the rest.
QUIET = 0.01


def _coin(*cols: str | Column) -> Column:
    """True for half of the keys."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(1 << 17)) != 0


def _weigh(edges: DataFrame, nodes: DataFrame, resolution: float) -> DataFrame:
    """(id, k, m2, c, best, gain, stay): for each node the community that gains most, and what its own is worth."""
    totals = nodes.groupBy("c").agg(F.sum("k").alias("total"))
    ends = nodes.select(F.col("id").alias("v"), F.col("c").alias("to"))
    near = edges.join(ends, "v").select(F.col("u").alias("id"), "to", "w").unionByName(nodes.select("id", F.col("c").alias("to"), dbl(0).alias("w")))
    near = near.groupBy("id", "to").agg(F.sum("w").alias("inner"))
    each = near.join(nodes, "id").join(totals.withColumnRenamed("c", "to"), "to")
    own = F.col("to") == F.col("c")
    worth = F.col("inner") - dbl(resolution) * F.col("k") * (F.col("total") - F.when(own, F.col("k")).otherwise(dbl(0))) / F.col("m2")
    best = F.max(F.struct(worth.alias("gain"), (-F.col("to")).alias("less")))  # of equal ones the smallest
    return each.groupBy("id", "k", "m2", "c").agg(best.alias("b"), F.max(F.when(own, worth)).alias("stay")).select("id", "k", "m2", "c", (-F.col("b.less")).alias("best"), F.col("b.gain").alias("gain"), "stay")


def _moves(edges: DataFrame, nodes: DataFrame, resolution: float, seed: int) -> DataFrame:
    n = nodes.count()
    for turn in range(ROUNDS):
        seen = _weigh(edges, nodes, resolution)
        wants = (F.col("gain") > F.col("stay") + dbl(EPS)) & (F.col("best") != F.col("c"))
        goes = wants & _coin("id", F.lit(turn), F.lit(seed))
        made = materialise(seen.select("id", "k", "m2", F.when(goes, F.col("best")).otherwise(F.col("c")).alias("c"), wants.alias("wants")), "moves")
        wanted = made.where("wants").count()
        discard(nodes)
        nodes = made
        if wanted <= FEW * n:
            break
    return nodes.select("id", "k", "m2", "c")


def _refined(edges: DataFrame, nodes: DataFrame, resolution: float, seed: int) -> DataFrame:
    """nodes with s, the sub-community, named after one of its nodes."""
    u, v = (nodes.select(F.col("id").alias(x), F.col("c").alias(f"c{x}")) for x in "uv")
    inner = materialise(edges.join(u, "u").join(v, "v").where("cu = cv").select("u", "v", "w"), "inner-edges")
    totals = nodes.groupBy("c").agg(F.sum("k").alias("total"))
    touch = inner.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("touch"))
    well = lambda weight, to: F.coalesce(F.col(to), dbl(0)) >= dbl(resolution) * F.col(weight) * (F.col("total") - F.col(weight)) / F.col("m2") - dbl(EPS)
    placed = nodes.join(totals, "c").join(touch, "id", "left").select("id", "k", "m2", "c", "total", well("k", "touch").alias("well"), F.col("id").alias("s"), F.lit(False).alias("moved"))
    placed, quiet = materialise(placed, "refined"), 0
    count = placed.count()
    for turn in range(ROUNDS):
        subs = placed.select(F.col("id").alias("v"), F.col("s").alias("to"))
        flow = inner.join(subs, "v").join(placed.select(F.col("id").alias("u"), "s"), "u").where("s <> to")
        outer = flow.groupBy(F.col("s").alias("to")).agg(F.sum("w").alias("outer"))
        sums = placed.groupBy(F.col("s").alias("to")).agg(F.sum("k").alias("sum"), F.min("total").alias("total"), F.min("m2").alias("m2"), F.count("*").alias("members"))
        heads = sums.join(outer, "to", "left").where(well("sum", "outer") & _coin("to", F.lit(turn), F.lit(seed + 1))).select("to", "sum")
        alone = placed.join(sums.where("members = 1").select(F.col("to").alias("s")), "s", "left_semi").where(F.col("well") & ~_coin("s", F.lit(turn), F.lit(seed + 1)))
        near = flow.groupBy(F.col("u").alias("id"), "to").agg(F.sum("w").alias("inner")).join(heads, "to").join(alone.select("id", "k", "m2"), "id")
        gain = F.col("inner") - dbl(resolution) * F.col("k") * F.col("sum") / F.col("m2")
        chosen = near.withColumn("gain", gain).where(F.col("gain") > dbl(EPS)).groupBy("id").agg(F.max(F.struct("gain", (-F.col("to")).alias("less"))).alias("b")).select("id", (-F.col("b.less")).alias("new"))
        made = materialise(placed.join(chosen, "id", "left").select("id", "k", "m2", "c", "total", "well", F.coalesce("new", "s").alias("s"), F.col("new").isNotNull().alias("moved")), "refined", instead_of=(placed,))
        placed = made
        quiet = quiet + 1 if placed.where("moved").count() <= QUIET * count else 0
        if quiet == 2:  # both sides of the coin have found next to nothing
            break
    discard(inner)
    return placed.select("id", "k", "m2", "c", "s")


def leiden(edges: DataFrame, group: str | None = None, resolution: float = 1.0, seed: int = 0, passes: int = 2) -> DataFrame:
    """(id, community), and the group if there is one, of every node of undirected edges (u, v, perhaps w and a group).

    Ids are bigints, and no node is in two groups.  The same edges give the same communities.  Each pass starts from
    the communities of the one before, with all nodes free to move again; the best of them counts.
    """
    weight = F.col("w").cast("double") if "w" in edges.columns else dbl(1)
    label = F.col(group) if group else F.lit(0)
    one = edges.where("u <> v").select(label.alias("g"), F.least("u", "v").cast("bigint").alias("u"), F.greatest("u", "v").cast("bigint").alias("v"), weight.alias("w"))
    one = one.groupBy("g", "u", "v").agg(F.sum("w").alias("w"))
    both = materialise(one.unionByName(one.select("g", F.col("v").alias("u"), F.col("u").alias("v"), "w")), "both-ways")
    degree = both.groupBy("g", F.col("u").alias("id")).agg(F.sum("w").alias("k"))
    total = both.groupBy(F.col("g").alias("_g")).agg(F.sum("w").alias("m2"))
    start = materialise(degree.join(total, F.col("g").eqNullSafe(F.col("_g"))).select("g", "id", "k", "m2"), "nodes")
    best, most, labels = None, None, start.select("id", F.col("id").alias("c"))
    for turn in range(passes):
        labels = _connected(both, _pass(both, start, labels, resolution, seed + 10_000 * turn))
        found = _quality(both, start, labels, resolution)
        if most is not None and found <= most + EPS:
            break
        best, most = labels, found
    return start.join(best, "id").select("id", *([F.col("g").alias(group)] if group else []), F.col("c").alias("community"))


def _pass(both: DataFrame, start: DataFrame, labels: DataFrame, resolution: float, seed: int) -> DataFrame:
    """(id, c): levels from single nodes up, from communities to start in."""
    nodes, links = start.join(labels, "id").select("id", "k", "m2", "c"), both.select("u", "v", "w")
    home = start.select("id", F.col("id").alias("node"))
    for level in range(LEVELS):
        nodes = materialise(_refined(links, _moves(links, nodes, resolution, seed + 100 * level), resolution, seed + 100 * level), "level")
        home = materialise(home.select("id", "node").join(nodes.select(F.col("id").alias("node"), F.col("s").alias("next"), "c"), "node").select("id", F.col("next").alias("node"), "c"), "home")
        if not nodes.where("id <> s").head(1):
            break
        a, b = (nodes.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")) for x in "uv")
        links = materialise(links.join(a, "u").join(b, "v").where("su <> sv").groupBy(F.col("su").alias("u"), F.col("sv").alias("v")).agg(F.sum("w").alias("w")), "links")
        nodes = materialise(nodes.groupBy("s").agg(F.sum("k").alias("k"), F.min("m2").alias("m2"), F.min("c").alias("c")).withColumnRenamed("s", "id"), "nodes")
    return home.select("id", "c")


def _inside(both: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges, each once, both of whose ends are in one community."""
    u, v = (labels.select(F.col("id").alias(x), F.col("c").alias(f"c{x}")) for x in "uv")
    return both.where("u < v").join(u, "u").join(v, "v").where("cu = cv")


def _connected(both: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, c): communities split into their connected parts, named after their smallest nodes."""
    parts = components(_inside(both, labels), "u", "v").select(F.col("id").alias("i"), "component")
    return materialise(labels.join(parts, F.col("id") == F.col("i"), "left").select("id", F.coalesce("component", "id").alias("c")), "labels")


def _quality(both: DataFrame, start: DataFrame, labels: DataFrame, resolution: float) -> float:
    """The modularities of all groups, added up."""
    share = _inside(both, labels).join(start.select(F.col("id").alias("u"), "m2"), "u").agg(F.sum(2 * F.col("w") / F.col("m2"))).first()[0] or 0.0
    sums = start.join(labels, "id").groupBy("g", "c").agg(F.sum("k").alias("k"), F.min("m2").alias("m2"))
    return share - resolution * (sums.agg(F.sum(F.pow(F.col("k") / F.col("m2"), dbl(2)))).first()[0] or 0.0)
