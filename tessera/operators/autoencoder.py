"""Autoencoder of spots over several views and their signalling: fitting, latent vectors, saved weights and manifest.

Each view goes through a small network; what a spot's neighbours look like,
weighted by a learnt mix of the pairs' scores, stands beside it in the latent
layer, and a decoder for each view reads that.  Spark cuts the spots into blocks
with their heaviest neighbours once and keeps them as a table.  An epoch is one
pass over it: a task adds up the gradients of its blocks, Spark sums those of
the tasks, and the driver, which holds the weights only, takes one Adam step.
A lost executor costs the blocks of its tasks, nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.columns import dbl
from tessera.plans.numbering import number_rows
from tessera.plans.workspace import discard, materialise

EPS = 1e-8
LOSSES = ("total", "reconstruction", "laplacian", "contrast", "clusters")


@dataclass(frozen=True)
class Config:
    """Sizes, loss weights and pace.

    batch and neighbours bound what a task holds: batch * (1 + neighbours) spots.
    Tables of at most ``batch`` spots, none with more neighbours, are one block:
    then an epoch is exactly a step over the whole graph.
    """

    embed: int = 32
    units: int = 64
    hidden: int = 128
    clusters: int = 30
    epochs: int = 40
    patience: int = 40
    rate: float = 7e-4
    batch: int = 256
    neighbours: int = 32
    positives: int = 18
    tau: float = 0.12
    reconstruction: float = 1.0
    laplacian: float = 0.08
    contrast: float = 0.25
    dec: float = 0.15
    dec_every: int = 10
    dropout: float = 0.15
    seed: int = 1
    as_is: tuple[str, ...] = ("gene", "onehot")  # views that aren't standardised
    narrow: tuple[str, ...] = ("onehot",)  # views with half the units


@dataclass
class Model:
    """views: width by name, in order.  pairs: pair ids in the order of the weights ``mix``.  scaling: (mean, scale) by view."""

    views: dict[str, int]
    pairs: list
    config: Config
    scaling: dict[str, tuple[np.ndarray, np.ndarray]]
    weights: dict[str, np.ndarray]
    history: list[dict] = field(default_factory=list)


# --- layers: each gives its output and what turns the output's gradient into the input's, adding the weights' to g


def _dense(p: dict, g: dict, name: str) -> Callable:
    def run(x):
        def back(d):
            g[f"{name}.w"] += x.T @ d
            g[f"{name}.b"] += d.sum(0)
            return d @ p[f"{name}.w"].T

        return x @ p[f"{name}.w"] + p[f"{name}.b"], back

    return run


def _gelu(x):
    """By the usual tanh form."""
    c = np.sqrt(2 / np.pi)
    t = np.tanh(c * (x + 0.044715 * x**3))
    return 0.5 * x * (1 + t), lambda d: d * (0.5 * (1 + t) + 0.5 * x * (1 - t * t) * c * (1 + 3 * 0.044715 * x * x))


def _norm(p: dict, g: dict, name: str) -> Callable:
    def run(x):
        r = 1 / np.sqrt(x.var(1, keepdims=True) + 1e-3)
        h = (x - x.mean(1, keepdims=True)) * r

        def back(d):
            g[f"{name}.gain"] += (d * h).sum(0)
            g[f"{name}.shift"] += d.sum(0)
            e = d * p[f"{name}.gain"]
            return r * (e - e.mean(1, keepdims=True) - h * (e * h).mean(1, keepdims=True))

        return h * p[f"{name}.gain"] + p[f"{name}.shift"], back

    return run


def _drop(rate: float, rng: np.random.Generator | None) -> Callable:
    def run(x):
        if rng is None or rate <= 0:
            return x, lambda d: d
        kept = (rng.random(x.shape) >= rate) / (1 - rate)
        return x * kept, lambda d: d * kept

    return run


def _through(x, *layers: Callable):
    backs = []
    for layer in layers:
        x, back = layer(x)
        backs.append(back)

    def back(d):
        for b in reversed(backs):
            d = b(d)
        return d

    return x, back


def _encoded(p: dict, g: dict, x, model: Model, rng=None):
    """Views side by side through their networks, normalised."""
    cuts = np.cumsum([0, *model.views.values()])
    outs, backs = [], []
    for k, v in enumerate(model.views):
        y, back = _through(x[:, cuts[k] : cuts[k + 1]], _dense(p, g, f"{v}.1"), _gelu, _norm(p, g, f"{v}.n1"), _drop(model.config.dropout, rng), _dense(p, g, f"{v}.2"), _gelu, _norm(p, g, f"{v}.n2"))
        outs.append(y)
        backs.append(back)
    y, joint = _norm(p, g, "features")(np.concatenate(outs, axis=1))
    ends = np.cumsum([o.shape[1] for o in outs])[:-1]

    def back(d):
        for b, part in zip(backs, np.split(joint(d), ends, axis=1), strict=True):
            b(part)

    return y, back


def _latent(p: dict, g: dict, both, model: Model, rng=None):
    return _through(both, _dense(p, g, "z.1"), _gelu, _norm(p, g, "z.n1"), _drop(model.config.dropout, rng), _dense(p, g, "z.2"), _norm(p, g, "latent"))


def _decoded(p: dict, g: dict, z, view: str):
    return _through(z, _dense(p, g, f"{view}.d1"), _gelu, _norm(p, g, f"{view}.dn"), _dense(p, g, f"{view}.d2"))


def _summed(to, n: int, s, x, of, chunk: int = 16_384):
    """out[to] += s * x[of] edge by edge, a stretch of edges at a time."""
    out, order = np.zeros((n, x.shape[1])), np.argsort(to, kind="stable")
    for at in range(0, len(order), chunk):
        own = order[at : at + chunk]
        rows, first = np.unique(to[own], return_index=True)
        out[rows] += np.add.reduceat(s[own, None] * x[of[own]], first, axis=0)
    return out


def _shares(z, centres):
    """Student's t shares of the clusters, with what their gradients need."""
    gap = z[:, None] - centres[None]
    t = 1 / (1 + (gap * gap).sum(2))
    return t / t.sum(1, keepdims=True), t, gap


def _targets(q, mass):
    f = q * q / (mass + EPS)
    return f / (f.sum(1, keepdims=True) + EPS)


@dataclass
class Block:
    """Spots, the first ``seeds`` of them its own, and the edges among them; scores by edge and pair."""

    seeds: int
    x: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    rank: np.ndarray
    edge: np.ndarray
    pair: np.ndarray
    w: np.ndarray


def _mixed(p: dict, b: Block):
    """Softmax of the pairs' weights, and each edge's score under it."""
    e = np.exp(p["mix"] - p["mix"].max())
    gamma = e / e.sum()
    return gamma, np.bincount(b.edge, weights=gamma[b.pair] * b.w, minlength=len(b.src))


def block_latent(p: dict, model: Model, b: Block):
    """Latent vectors of all spots of a block, nothing dropped."""
    idle = _zeros(p)
    y, _ = _encoded(p, idle, b.x, model)
    _, s = _mixed(p, b)
    return _latent(p, idle, np.concatenate([y, _summed(b.src, len(b.x), s, y, b.dst)], axis=1), model)[0]


def _zeros(p: dict) -> dict:
    return {k: np.zeros_like(v) for k, v in p.items()}


def block_gradients(p: dict, model: Model, b: Block, n: int, frozen: dict, mass, rng=None):
    """(gradients, losses) of a block's seeds, as parts of means over n spots.

    frozen and mass: the weights and the clusters' mass that the targets of the
    shares go by; targets are constants.
    """
    c, g = model.config, _zeros(p)
    m, k = len(b.x), b.seeds
    y, back_y = _encoded(p, g, b.x, model, rng)
    gamma, s = _mixed(p, b)
    z, back_z = _latent(p, g, np.concatenate([y, _summed(b.src, m, s, y, b.dst)], axis=1), model, rng)
    dz = np.zeros_like(z)

    rec, at = 0.0, 0
    for v, width in model.views.items():
        guess, back = _decoded(p, g, z[:k], v)
        off = guess - b.x[:k, at : at + width]
        at += width
        rec += (off * off).sum() / (n * width * width)
        dz[:k] += back(c.reconstruction * 2 * off / (n * width * width))

    own = b.src < k
    weight = np.bincount(b.edge, weights=b.w, minlength=len(b.src))[own] / max(1, len(p["mix"]))
    src, dst = b.src[own], b.dst[own]
    weight = weight / (np.bincount(src, weights=weight, minlength=k)[src] + EPS)
    gap = z[:k] - _summed(src, k, weight, z, dst)
    lap = (gap * gap).sum() / n
    d = c.laplacian * 2 * gap / n
    dz[:k] += d
    dz -= _summed(dst, m, weight, d, src)

    size = np.sqrt(np.maximum((z * z).sum(1, keepdims=True), 1e-12))
    u = z / size
    sim = u[:k] @ u.T / c.tau
    sim[np.arange(k), np.arange(k)] -= 1e9
    top = sim.max(1, keepdims=True)
    lse = top + np.log(np.exp(sim - top).sum(1, keepdims=True))
    near = b.rank[own] <= c.positives
    mask = np.zeros((k, m))
    mask[src[near], dst[near]] = 1.0
    count = mask.sum(1, keepdims=True)
    nce = -(mask * (sim - lse) / (count + EPS)).sum() / n
    d = c.contrast * (np.exp(sim - lse) * count - mask) / (count + EPS) / n / c.tau
    du = d.T @ u[:k]
    du[:k] += d @ u
    dz += (du - u * (du * u).sum(1, keepdims=True)) / size

    q, t, apart = _shares(z[:k], p["centres"])
    target = _targets(_shares(block_latent(frozen, model, b)[:k], frozen["centres"])[0], mass)
    dec = (target * (np.log(target + EPS) - np.log(q + EPS))).sum() / n
    dq = -c.dec * target / (q + EPS) / n
    d2 = -(dq - (dq * q).sum(1, keepdims=True)) / t.sum(1, keepdims=True) * t * t
    d = 2 * apart * d2[:, :, None]
    dz[:k] += d.sum(1)
    g["centres"] -= d.sum(0)

    dy, dmsg = np.split(back_z(dz), 2, axis=1)
    dy = dy + _summed(b.dst, m, s, dmsg, b.src)
    ds = np.concatenate([(dmsg[b.src[i : i + 16_384]] * y[b.dst[i : i + 16_384]]).sum(1) for i in range(0, max(1, len(b.src)), 16_384)])
    dgamma = np.bincount(b.pair, weights=ds[b.edge] * b.w, minlength=len(gamma))
    g["mix"] += gamma * (dgamma - (gamma * dgamma).sum())
    back_y(dy)
    total = c.reconstruction * rec + c.laplacian * lap + c.contrast * nce + c.dec * dec
    return g, np.array([total, rec, lap, nce, dec])


# --- weights


def initial(views: dict[str, int], pairs: int, c: Config) -> dict[str, np.ndarray]:
    """Weights before the first step: He's for layers with a curve behind them, Glorot's for the others."""
    rng, p = np.random.default_rng(c.seed), {}

    def dense(name, a, b, curved=True):
        spread = np.sqrt(2 / a) if curved else np.sqrt(2 / (a + b))
        p[f"{name}.w"], p[f"{name}.b"] = rng.normal(0, spread, (a, b)), np.zeros(b)

    def norm(name, a):
        p[f"{name}.gain"], p[f"{name}.shift"] = np.ones(a), np.zeros(a)

    wide = 0
    for v, width in views.items():
        u = c.units // 2 if v in c.narrow else c.units
        dense(f"{v}.1", width, u)
        dense(f"{v}.2", u, u)
        norm(f"{v}.n1", u)
        norm(f"{v}.n2", u)
        dense(f"{v}.d1", c.embed, c.hidden)
        norm(f"{v}.dn", c.hidden)
        dense(f"{v}.d2", c.hidden, width, False)
        wide += u
    norm("features", wide)
    dense("z.1", 2 * wide, c.hidden)
    norm("z.n1", c.hidden)
    dense("z.2", c.hidden, c.embed, False)
    norm("latent", c.embed)
    p["mix"], p["centres"] = np.zeros(max(1, pairs)), rng.normal(0, 0.1, (c.clusters, c.embed))
    return p


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


# --- tables


def _clean(f: str):
    return F.transform(f, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), dbl(0)).otherwise(v.cast("double")))


def _joint(views: dict[str, DataFrame]) -> DataFrame:
    """(id, one array for each view): spots that have all views.  Null and non-finite components count as 0."""
    out = None
    for k, df in enumerate(views.values()):
        own = df.where("id is not null and f is not null").select("id", _clean("f").alias(f"f{k}"))
        out = own if out is None else out.join(own, "id")
    return out


def _measured(joint: DataFrame, names: list[str], as_is: tuple[str, ...]) -> tuple[int, dict, dict]:
    """Number of spots, width of each view, and its mean and deviation; one row for the driver."""
    cols = [F.count("*").alias("n")]
    for k in range(len(names)):
        cols += [F.min(F.size(f"f{k}")).alias(f"a{k}"), F.max(F.size(f"f{k}")).alias(f"b{k}")]
    row = joint.agg(*cols).first()
    if not row.n:
        raise ValueError("no spot has all views")
    for k, v in enumerate(names):
        if row[f"a{k}"] != row[f"b{k}"] or not row[f"a{k}"]:
            raise ValueError(f"vectors of view {v} differ in length or are empty")
    got = joint.agg(*(Summarizer.metrics("mean", "variance").summary(array_to_vector(f"f{k}")).alias(f"s{k}") for k in range(len(names)))).first()
    scaling = {}
    for k, v in enumerate(names):
        width = row[f"a{k}"]
        if v in as_is:
            scaling[v] = (np.zeros(width), np.ones(width))
        else:
            s = got[f"s{k}"]
            scaling[v] = (s["mean"].toArray(), np.sqrt(s["variance"].toArray() * (row.n - 1) / row.n) + EPS)
    return row.n, {v: row[f"a{k}"] for k, v in enumerate(names)}, scaling


def _numbered(ccc: DataFrame, pairs: list) -> DataFrame:
    """(src, dst, pos, w): positive scores off the diagonal, repeated ones once, pos in the order of the pairs.

    Scores of an edge come to one place, and stay there for whatever is formed by edge.
    """
    spark, kind = ccc.sparkSession, ccc.schema["pair_id"].dataType.simpleString()
    numbers = spark.createDataFrame([(p, k) for k, p in enumerate(pairs)], f"pair_id {kind}, pos int")
    own = ccc.where("src <> dst and w > 0 and not isnan(w) and w < double('inf')").join(F.broadcast(numbers), "pair_id").select("src", "dst", "pos", "w")
    return own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "src", "dst").groupBy("src", "dst", "pos").agg(F.max("w").alias("w"))


def _edges(ccc: DataFrame, pairs: list) -> DataFrame:
    """(src, dst, total, pos, w): the scores of one edge side by side in the order of the pairs."""
    got = _numbered(ccc, pairs).groupBy("src", "dst").agg(F.sum("w").alias("total"), F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("_c"))
    return got.select("src", "dst", "total", F.col("_c.pos").alias("pos"), F.col("_c.w").alias("w"))


_BLOCK = "block bigint, seeds int, x array<float>, src array<int>, dst array<int>, rank array<int>, edge array<int>, pair array<int>, w array<double>"


def _blocks(spots: DataFrame, edges: DataFrame, c: Config) -> DataFrame:
    """One row for each ``batch`` spots in the order of ids, with their heaviest neighbours and the edges among all of these."""
    numbered = materialise(number_rows(spots, "nr", ["id"]).withColumn("block", F.floor(F.col("nr") / c.batch)).drop("nr"), "spots")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("total"), "dst"))
    known = edges.join(numbered.select(F.col("id").alias("dst")), "dst", "left_semi")
    kept = materialise(known.withColumn("rank", rank).where(F.col("rank") <= c.neighbours), "heaviest")
    seeds = numbered.select("block", "id", F.lit(1).alias("seed"))
    halo = kept.join(numbered.select(F.col("id").alias("src"), "block"), "src").select("block", F.col("dst").alias("id"), F.lit(0).alias("seed"))
    members = materialise(seeds.unionByName(halo).groupBy("block", "id").agg(F.max("seed").alias("seed")), "members")
    nodes = members.join(numbered.drop("block"), "id")
    inner = kept.join(members.select("block", F.col("id").alias("src")), "src").join(members.select("block", F.col("id").alias("dst")), ["block", "dst"], "left_semi")
    inner = materialise(inner, "inner", (kept,))

    def pack(key: tuple, nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values(["seed", "id"], ascending=[False, True])
        edges = edges.sort_values(["src", "dst"])
        at = pd.Series(np.arange(len(nodes)), index=nodes["id"].to_numpy())
        sizes = [len(p) for p in edges["pos"]]
        side = lambda name, kind: np.concatenate([np.asarray(v, kind) for v in edges[name]]) if len(edges) else np.zeros(0, kind)
        row = {"block": key[0], "seeds": int(nodes["seed"].sum()), "x": np.concatenate([np.asarray(v, np.float32) for v in nodes["x"]]), "src": at.reindex(edges["src"]).to_numpy(np.int32), "dst": at.reindex(edges["dst"]).to_numpy(np.int32)}
        row |= {"rank": edges["rank"].to_numpy(np.int32), "edge": np.repeat(np.arange(len(edges), dtype=np.int32), sizes), "pair": side("pos", np.int32), "w": side("w", float)}
        return pd.DataFrame([row])

    return materialise(nodes.groupBy("block").cogroup(inner.groupBy("block")).applyInPandas(pack, _BLOCK), "blocks", (numbered, members, inner))


def _block(row: pd.Series, width: int) -> Block:
    whole = {k: np.asarray(row[k], np.int64) for k in ("src", "dst", "rank", "edge", "pair")}
    return Block(int(row["seeds"]), np.asarray(row["x"], float).reshape(-1, width), w=np.asarray(row["w"], float), **whole)


def _scaled(joint: DataFrame, model: Model) -> DataFrame:
    """(id, x): all views as one standardised array."""
    width, mean = sum(model.views.values()), np.concatenate([model.scaling[v][0] for v in model.views])
    scale, names = np.concatenate([model.scaling[v][1] for v in model.views]), [f"f{k}" for k in range(len(model.views))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            x = np.array([np.concatenate(v) for v in own["f"]], float).reshape(-1, width) if len(own) else np.zeros((0, width))
            yield pd.DataFrame({"id": own["id"], "x": list((x - mean) / scale)})

    kind = joint.schema["id"].dataType.simpleString()
    return joint.select("id", F.array(*names).alias("f")).mapInPandas(run, f"id {kind}, x array<double>")


def _added(rows: DataFrame) -> np.ndarray:
    """Sum of arrays v, one from each task, added up in Spark."""
    return rows.agg(Summarizer.sum(array_to_vector("v")).alias("v")).select(vector_to_array("v").alias("v")).first().v


#: Blocks that a task reads and hands to Python at once; a block has some megabytes.
AT_ONCE = 4


def _over(blocks: DataFrame, f: Callable[[pd.Series], np.ndarray]) -> np.ndarray:
    """Sum of f over all blocks, which a task takes a few at a time, however many its files hold."""
    small = {"spark.sql.parquet.columnarReaderBatchSize": AT_ONCE, "spark.sql.execution.arrow.maxRecordsPerBatch": AT_ONCE}
    conf = blocks.sparkSession.conf
    before = {k: conf.get(k) for k in small}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = None
        for own in batches:
            for _, row in own.iterrows():
                got = f(row)
                sums = got if sums is None else sums + got
        if sums is not None:
            yield pd.DataFrame({"v": [sums]})

    try:
        for k, v in small.items():
            conf.set(k, str(v))
        return np.asarray(_added(blocks.mapInPandas(run, "v array<double>")))
    finally:
        for k, v in before.items():
            conf.set(k, v)


def _pass(blocks: DataFrame, model: Model, n: int, frozen: dict, mass: np.ndarray, epoch: int) -> tuple[dict, np.ndarray]:
    """Gradients and losses over all blocks."""
    width, p = sum(model.views.values()), model.weights

    def run(row: pd.Series) -> np.ndarray:
        rng = np.random.default_rng([model.config.seed, epoch, int(row["block"])])
        g, losses = block_gradients(p, model, _block(row, width), n, frozen, mass, rng)
        return np.concatenate([losses, _flat(g)])

    got = _over(blocks, run)
    return _shaped(got[len(LOSSES) :], p), got[: len(LOSSES)]


def _mass(blocks: DataFrame, model: Model) -> np.ndarray:
    """Sum of all spots' cluster shares."""
    width, p = sum(model.views.values()), model.weights

    def run(row: pd.Series) -> np.ndarray:
        b = _block(row, width)
        return _shares(block_latent(p, model, b)[: b.seeds], p["centres"])[0].sum(0)

    return _over(blocks, run)


# --- use


def fit(views: dict[str, DataFrame], ccc: DataFrame, config: Config = Config(), start: Model | None = None) -> Model:  # noqa: B008
    """Fit on views (id, f array) and prepared scores (src, dst, pair_id, w) (``models.ccc_prep``).

    Spots without all views are left out, as are edges to them; ids are unique.
    Scores that are null, non-finite or not positive count as absent, repeated
    ones once, by the largest.  Within a block the contrast compares its spots
    with those of the block; neighbours beyond ``neighbours`` and the
    neighbours' own neighbours outside the block only count in ``latent``.
    start: a fitted model to go on from.  The weights kept are those after the
    step of the least loss.
    """
    joint = materialise(_joint(views), "views")
    if start is None:
        n, widths, scaling = _measured(joint, list(views), config.as_is)
        pairs = [r.pair_id for r in ccc.select("pair_id").where("pair_id is not null").distinct().orderBy("pair_id").collect()]  # a weight each
        model = Model(widths, pairs, config, scaling, initial(widths, len(pairs), config))
    else:
        n, model = joint.count(), replace(start, config=config, history=list(start.history))
    blocks = _blocks(_scaled(joint, model), _edges(ccc, model.pairs), config)
    frozen, mass = model.weights, _mass(blocks, model)
    flat, best, least, wait = _flat(model.weights), model.weights, np.inf, 0
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for epoch in range(1, config.epochs + 1):
        g, losses = _pass(blocks, model, n, frozen, mass, epoch)
        if not np.isfinite(losses).all():
            raise FloatingPointError(f"loss of epoch {epoch} isn't finite: take a smaller rate")
        step = _flat(g)
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step * step
        flat = flat - config.rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-7)
        model = replace(model, weights=_shaped(flat, model.weights), history=[*model.history, {"epoch": epoch} | dict(zip(LOSSES, map(float, losses), strict=True))])
        if epoch % config.dec_every == 0:
            frozen, mass = model.weights, _mass(blocks, model)
        if losses[0] < least - 1e-5:
            best, least, wait = model.weights, losses[0], 0
        else:
            wait += 1
        if wait >= config.patience:
            break
    discard(joint, blocks)
    return replace(model, weights=best)


def latent(model: Model, views: dict[str, DataFrame], ccc: DataFrame) -> DataFrame:
    """(id, f): latent vectors over all neighbours of each spot, however many; without neighbours their share is 0."""
    p, idle, width = model.weights, _zeros(model.weights), sum(model.views.values())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            x = np.array(list(own["x"]), float).reshape(-1, width)
            yield pd.DataFrame({"id": own["id"], "y": list(_encoded(p, idle, x, model)[0])})

    spots = _scaled(_joint({v: views[v] for v in model.views}), model)
    kind = spots.schema["id"].dataType.simpleString()
    coded = materialise(spots.mapInPandas(encode, f"id {kind}, y array<double>"), "encoded")
    gamma = np.exp(p["mix"] - p["mix"].max())
    pairs = ccc.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(gamma / gamma.sum())], "pos int, gamma double")
    scored = _numbered(ccc, model.pairs).join(F.broadcast(pairs), "pos")
    scored = scored.groupBy("src", "dst").agg(F.sum(F.col("gamma") * F.col("w")).alias("s"))
    near = scored.join(coded.select(F.col("id").alias("dst"), array_to_vector("y").alias("y")), "dst")
    told = near.groupBy(F.col("src").alias("id")).agg(Summarizer.sum(F.col("y"), F.col("s")).alias("_m")).select("id", vector_to_array("_m").alias("m"))
    wide = len(p["features.gain"])

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            y = np.array(list(own["y"]), float).reshape(-1, wide)
            m = np.array([np.zeros(wide) if v is None else v for v in own["m"]], float).reshape(-1, wide)
            yield pd.DataFrame({"id": own["id"], "f": list(_latent(p, idle, np.concatenate([y, m], axis=1), model)[0])})

    return coded.join(told, "id", "left").mapInPandas(head, f"id {kind}, f array<double>")


def save(spark: SparkSession, model: Model, path: str) -> None:
    """Weights as ``path``/weights (Parquet), sizes, loss by epoch and settings as ``path``/manifest (JSON); replaces what stands there."""
    rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in model.weights.items()]
    rows += [(f"scaling/{v}/{k}", list(s.shape), s.tolist()) for v, both in model.scaling.items() for k, s in zip(("mean", "scale"), both, strict=True)]
    spark.createDataFrame(rows, "name string, shape array<int>, v array<double>").write.mode("overwrite").parquet(f"{path}/weights")
    told = {"views": model.views, "pairs": model.pairs, "config": asdict(model.config), "history": model.history}
    told |= {"epochs_done": len(model.history), "best_total_loss": min((h["total"] for h in model.history), default=None)}
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> Model:
    told = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first().value)
    rows = {r.name: np.array(r.v).reshape(r.shape) for r in spark.read.parquet(f"{path}/weights").collect()}
    scaling = {v: (rows.pop(f"scaling/{v}/mean"), rows.pop(f"scaling/{v}/scale")) for v in told["views"]}
    config = Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in told["config"].items()})
    return Model(told["views"], told["pairs"], config, scaling, rows, told["history"])
