"""Near-duplicate vectors by product quantisation.

Vectors are scaled to length one; equal ones collapse into a class first, so
a vector that thousands share is searched once.  Coarse centroids cut the space
into inverted lists; the residual against a vector's centroid is coded in
``PARTS`` subspaces of 256 codewords each.  Both are fitted on the driver from
about ``SAMPLE`` classes, or ``SAMPLE_A_LIST`` for each list, drawn by a hash of
the vector.  There is a list for every 2,048 vectors, and beyond 4,096 lists as
many as grow with the square root of the vectors: centroids fit a driver at any size.

Every class is indexed, and asks every list that may hold a vector within reach
of the threshold.  Only two bounds rule a list out: its centroid is further away
than its radius and the reach, or the plane between its centroid and the
class's own is further away than the reach.  So no link is lost at any number of
lists.  Where vectors are spread evenly in many dimensions the bounds rule out
little, and the search costs what comparing all classes costs.

Lists are cut in blocks, and up to ``SPAN`` blocks make a group.  A pair of groups
is a tile, one task, to which a class is sent once, with a bit for each block of
the other group whose list it asks: so a vector travels as often as there are
groups with a list that it asks, not as there are such blocks.  In a tile a pair
of blocks meets once, with those classes of each that ask the other's list: squared distances come from one table per query
and subspace (asymmetric: the query is not coded).  The code of x is off x by a
known error e, so |q - x| is at least the table distance less e; only pairs that
this bound leaves within reach are reranked, by exact cosine in double
precision.  So the search is exact, and a pair counts for both its ends.

A pair of blocks returns, for each vector, how many it links to, and a forest that
connects what is linked, never the pairs themselves.

Where the bounds rule out nothing, n classes of w components make n * n / (4096 * SPAN)
rows of 8 w + 60 bytes: 0.9 TB for ten million of 64 (some 12,000 tiles), 90 TB for
a hundred million; at about a nanosecond for a pair that is 14 and 1,400 hours of a core.

Vectors that are null, zero, or hold null or non-finite components link with
nothing.  Vectors of different lengths are never linked.  Rows that repeat a
vec_id and its vector are vectors of their own; rows that repeat a vec_id with
another vector share its links.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.components import components
from tessera.plans.workspace import materialise

from .text import mix

#: Vectors that centroids are fitted on, or so many for each list if those are more.
SAMPLE, SAMPLE_A_LIST = 20_000, 20
PARTS = 16
#: A list holds LIST classes or more while there are fewer than FEW_LISTS lists, and LONG_LIST beyond: each list asked is a row.
LIST, FEW_LISTS, LONG_LIST = 256, 32, 2048
#: Beyond this many lists their number grows with the square root of the vectors.
MANY_LISTS = 4096
BLOCK = 4096
#: Blocks of a group at most, and groups that there are at least, if there are so many blocks.
SPAN, LEAST_GROUPS = 16, 12
#: Room for rounding: of single-precision distances, and of squared ones that choose a class's own list.
SLACK = 1e-4


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        full = n > 0
        c[full] = sums[full] / n[full, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int, block: int = 4096) -> np.ndarray:
    """The k nearest centroids of each row, nearest first."""
    out = np.empty((len(x), min(k, len(c))), np.int64)
    norm = (c * c).sum(1)
    for at in range(0, len(x), block):
        d = norm - 2 * (x[at : at + block] @ c.T)
        if k == 1:
            out[at : at + block, 0] = d.argmin(1)
            continue
        part = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
        out[at : at + block] = np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(1, kind="stable"), 1)
    return out


class Quantiser:
    """Coarse centroids and codewords of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        x = sample.astype(np.float32)
        self.width = x.shape[1]
        self.cuts = np.linspace(0, self.width, min(PARTS, self.width) + 1).astype(int)
        self.coarse = kmeans(x, lists)
        residual = x - self.coarse[nearest(x, self.coarse, 1)[:, 0]]
        self.words = [kmeans(np.ascontiguousarray(residual[:, a:b]), 256, 8, i) for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False))]

    def code(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of vectors in their lists, and how far each is from its code."""
        residual = x.astype(np.float32) - self.coarse[home]
        codes = np.stack([nearest(np.ascontiguousarray(residual[:, a:b]), w, 1)[:, 0] for (a, b), w in zip(zip(self.cuts, self.cuts[1:], strict=False), self.words, strict=True)], 1).astype(np.uint8)
        back = np.concatenate([w[codes[:, j]] for j, w in enumerate(self.words)], 1)
        return codes, np.sqrt(((residual - back) ** 2).sum(1))

    def distances(self, queries: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded vectors of one list, by table look-up."""
        residual = queries.astype(np.float32) - self.coarse[home]
        total = np.zeros((len(codes), len(queries)), np.float32)
        some = np.empty_like(total)
        for j, w in enumerate(self.words):
            own = residual[:, self.cuts[j] : self.cuts[j + 1]]
            table = (own * own).sum(1) - 2 * w @ own.T + (w * w).sum(1)[:, None]
            total += np.take(table, codes[:, j], axis=0, out=some, mode="clip")  # whole rows: one for each code
        return total.T


class Bounds:
    """Radius and blocks of each list."""

    def __init__(self, lists: int, found: list):
        self.radius, self.blocks = np.zeros(lists), np.zeros(lists, np.int64)
        for r in found:
            self.radius[r.home], self.blocks[r.home] = r.radius, -(-r.size // BLOCK)
        self.first = np.cumsum(self.blocks) - self.blocks
        self.list_of = np.repeat(np.arange(lists), self.blocks)
        self.span = max(1, -(-len(self.list_of) // max(LEAST_GROUPS, -(-len(self.list_of) // SPAN))))

    def asked(self, x: np.ndarray, home: np.ndarray, coarse: np.ndarray, reach: float, probes: int) -> np.ndarray:
        """By row and list: may the list hold a vector within reach?"""
        c = coarse.astype(np.float64)
        norm = (c * c).sum(1)
        d = np.maximum((x * x).sum(1)[:, None] + norm - 2 * x @ c.T, 0)
        apart = np.sqrt(np.maximum(norm[home][:, None] + norm - 2 * c[home] @ c.T, 0)) + SLACK
        own = d[np.arange(len(x)), home][:, None]
        out = (np.sqrt(d) <= self.radius + reach) & (d - own - SLACK <= 2 * reach * apart)
        np.put_along_axis(out, nearest(x.astype(np.float32), coarse, probes), True, 1)
        out[np.arange(len(x)), home] = True
        return out & (self.blocks > 0)


def _usable():
    """(vec_id, unit, width): unit vectors as bytes; null where a vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()  # without the components of null lists
            x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            units = np.empty(len(lens), object)
            widths = np.zeros(len(lens), np.int32)
            begin = np.cumsum(lens) - lens
            for width in np.unique(lens[lens > 0]).tolist():
                rows = np.flatnonzero(lens == width)
                own = x[(begin[rows][:, None] + np.arange(width)).ravel()].reshape(-1, width)
                most = np.abs(own).max(1)
                fine = np.isfinite(own).all(1) & (most > 0)
                own = unit(own[fine] / most[fine][:, None])
                for i, v in zip(rows[fine].tolist(), own, strict=True):
                    units[i] = v.tobytes()
                widths[rows[fine]] = width
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary()), pa.array(widths)], ["vec_id", "unit", "width"])

    return run


def _coded(sent):
    """(home, own, rep, n, unit, code, error): each class with its list, how far it is from the centroid, and its code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                x = fixed(batch.column(2), np.float64)
                home = nearest(x.astype(np.float32), q.coarse, 1)[:, 0]
                codes, error = q.code(x, home)
                own = np.sqrt(((x - q.coarse[home].astype(np.float64)) ** 2).sum(1))
                coded = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(own), batch.column(0), batch.column(1), batch.column(2), coded, pa.array(error.astype(np.float64))], ["home", "own", "rep", "n", "unit", "code", "error"])

    return run


def _meetings(sent, reach: float, probes: int):
    """One row for each class and pair of groups it meets in: (p, q, side, rep, n, unit, code, error, block, asks), p <= q, side 0 from p.

    block: the class's own.  asks: a bit for each block of the other group whose list it asks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, bounds = sent.value
        span = bounds.span
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                home, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                x = fixed(batch.column(3), np.float64)
                mine = bounds.first[home] + (mix(rep.astype(np.uint64)) % bounds.blocks[home].astype(np.uint64)).astype(np.int64)
                row, other = np.nonzero(bounds.asked(x, home, quantiser.coarse, reach, probes)[:, bounds.list_of])
                new = np.append(True, (row[1:] != row[:-1]) | (other[1:] // span != other[:-1] // span))[: len(row)]
                asks = np.bitwise_or.reduceat(np.int64(1) << (other % span), np.flatnonzero(new))
                row, other = row[new], other[new] // span
                own = mine[row] // span
                p, q, side = np.minimum(own, other), np.maximum(own, other), (own > other).astype(np.int32)
                for k in range(0, len(row), 8192):
                    some = slice(k, k + 8192)
                    pick = pa.array(row[some])
                    yield pa.RecordBatch.from_arrays([pa.array(p[some]), pa.array(q[some]), pa.array(side[some]), *(batch.column(c).take(pick) for c in range(1, 6)), pa.array(mine[row[some]]), pa.array(asks[some])], MEETING)

    return run


MEETING = ["p", "q", "side", "rep", "n", "unit", "code", "error", "block", "asks"]


def fixed(column: pa.Array | pa.ChunkedArray, kind) -> np.ndarray:
    """Values of one length each as the rows of a matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(whole), -1)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            own = tuple(c[x] for c in cols)
            if held and own != key:
                yield pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _search(sent, cosine: float, reach: float):
    """(a, b, n): b > 0 an edge of a forest with n null; b null: a links to n vectors more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, bounds = sent.value
        span = bounds.span
        for table in _runs(batches, 2):
            p, q = (table.column(c)[0].as_py() for c in ("p", "q"))
            side, rep, n, error, block, asks = (table.column(c).to_numpy() for c in ("side", "rep", "n", "error", "block", "asks"))
            unit_of, codes = fixed(table.column("unit"), np.float64), fixed(table.column("code"), np.uint8)
            limit = (reach + error) ** 2 + SLACK
            of = {(s, b): np.flatnonzero((side == s) & (block == b)) for s in (0, 1) for b in np.unique(block[side == s]).tolist()}
            more = np.zeros(len(rep))
            links = []
            for one, two in ((i, j) for s, i in of if s == 0 for t, j in of if t == (0 if p == q else 1) and i <= j):
                qs, xs = of[0, one], of[0 if p == q else 1, two]
                qs, xs = qs[asks[qs] >> (two % span) & 1 == 1], xs[asks[xs] >> (one % span) & 1 == 1]
                if not len(qs) or not len(xs):
                    continue
                for at in range(0, len(qs), 256):
                    some = qs[at : at + 256]
                    i, j = np.nonzero(quantiser.distances(unit_of[some], bounds.list_of[two], codes[xs]) <= limit[xs])
                    once = (some[i] < xs[j] if one == two else True) & (rep[some[i]] != rep[xs[j]])
                    i, j = i[once], j[once]
                    if 20 * len(i) > len(some) * len(xs):
                        cos = (unit_of[some] @ unit_of[xs].T)[i, j]
                    else:
                        cos = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", unit_of[some[i[k : k + 8192]]], unit_of[xs[j[k : k + 8192]]]) for k in range(0, len(i), 8192))])
                    a, b = some[i[cos >= cosine]], xs[j[cos >= cosine]]
                    if len(a):
                        more += np.bincount(a, n[b], len(rep)) + np.bincount(b, n[a], len(rep))
                        links.append(np.array(forest(np.stack([rep[a], rep[b]], 1)), np.int64))
                if len(links) > 64:
                    links = [np.array(forest(np.concatenate(links)), np.int64)]
            if links:
                edges = forest(np.concatenate(links))
                has = np.flatnonzero(more)
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges] + rep[has].tolist(), pa.int64()), pa.array([e[1] for e in edges] + [None] * len(has), pa.int64()), pa.array([None] * len(edges) + more[has].astype(np.int64).tolist(), pa.int64())], ["a", "b", "n"])

    return run


def forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Edges of stars that connect what the pairs connect."""
    ids, flat = np.unique(pairs, return_inverse=True)
    u, v = flat.reshape(-1, 2).T
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, u, label[v])
        np.minimum.at(low, v, label[u])
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    return [(int(ids[i]), int(ids[label[i]])) for i in range(len(ids)) if label[i] != i]


def list_count(size: int) -> int:
    """Lists for so many different vectors."""
    few = max(1, min(size // LIST, FEW_LISTS), size // LONG_LIST)
    return few if few <= MANY_LISTS else max(MANY_LISTS, int(np.sqrt(size) * MANY_LISTS / np.sqrt(MANY_LISTS * LONG_LIST)))


def near_vectors(vectors: DataFrame, cosine: float = 0.9, probes: int = 1, lists: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding; nothing else is read).

    probes: so many nearest lists are asked even where the bounds rule them out.  Neither it nor lists changes a result.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(_usable(), "vec_id bigint, unit binary, width int")
    rows = materialise(rows, "units")
    classes = materialise(rows.where("width > 0").groupBy("width", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    edges, counts = [], []
    for width, size in sorted((r.width, r.n) for r in classes.groupBy("width").agg(F.count("*").alias("n")).collect()):
        own = classes.where(F.col("width") == width)
        count = lists or list_count(size)
        wanted = max(SAMPLE, SAMPLE_A_LIST * count)
        part = min(1.0, wanted / size)
        sample = own.where(F.pmod(F.xxhash64("unit"), F.lit(1 << 20)) < int(part * (1 << 20))).select("unit").limit(2 * wanted).toArrow().column(0).to_pylist() if part < 1 else own.select("unit").toArrow().column(0).to_pylist()
        x = np.frombuffer(b"".join(sorted(sample)), np.float64).reshape(-1, width)
        quantiser = Quantiser(x, count)
        sent = spark.sparkContext.broadcast(quantiser)
        coded = materialise(own.select("rep", "n", "unit").mapInArrow(_coded(sent), "home int, own double, rep bigint, n bigint, unit binary, code binary, error double"), "coded")
        bounds = Bounds(len(quantiser.coarse), coded.groupBy("home").agg(F.max("own").alias("radius"), F.count("*").alias("size")).collect())
        sent = spark.sparkContext.broadcast((quantiser, bounds))
        met = coded.select("home", "rep", "n", "unit", "code", "error").mapInArrow(_meetings(sent, reach, probes), "p bigint, q bigint, side int, rep bigint, n bigint, unit binary, code binary, error double, block bigint, asks bigint")
        grid = met.repartition("p", "q").sortWithinPartitions("p", "q")
        found = materialise(grid.mapInArrow(_search(sent, cosine, reach), "a bigint, b bigint, n bigint"), "vector-links", instead_of=(coded,))
        edges.append(found.where("b is not null").select("a", "b"))
        counts.append(found.where("b is null").select(F.lit(width).alias("w"), "a", "n"))
    one = classes.select("width", "unit", F.col("rep"), F.col("n").alias("same"))
    placed = rows.join(one, ["width", "unit"], "left")
    if not edges:
        return placed.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    all_edges, all_counts = edges[0], counts[0]
    for e, c in zip(edges[1:], counts[1:], strict=True):
        all_edges, all_counts = all_edges.unionByName(e), all_counts.unionByName(c)
    total = all_counts.groupBy("w", "a").agg(F.sum("n").alias("more"))
    parts = components(all_edges, "a", "b")
    joined = placed.join(total, (F.col("rep") == F.col("a")) & (F.col("width") == F.col("w")), "left").join(parts, F.col("rep") == F.col("id"), "left")
    out = joined.select("vec_id", F.coalesce(F.col("same") - 1 + F.coalesce("more", F.lit(0)), F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
