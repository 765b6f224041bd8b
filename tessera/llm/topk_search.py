"""Exact search for the k largest inner products, by segment statistics from coarse to fine.

A vector is cut in 1, 4 and then 16 segments.  For a segment of L components of
the query and of a candidate, with means m, m' and deviations s, s', the distance
is at least sqrt(L * ((m - m')**2 + (s - s')**2)), which says the same as: the
inner product is at most L * (m * m' + s * s').  Summed over the segments that
is a bound for the whole vectors, tighter the more segments there are.

Candidates lie in blocks by a hash of their row, queries too; each pair of blocks
is a tile, one cogrouped task.  In a tile the coarsest bounds of all its pairs
name the most promising candidates of each query, whose exact scores give a score
that any of the best k must reach; pairs whose bound is below it go, level by
level, and the rest are scored exactly in integers.  A tile returns k rows for a
query at most.

Tiles come in two waves.  A sixteenth of the blocks goes first; the k-th best
score there is each query's threshold in the rest, so later tiles rule out more
and return what beats it only.

Scores are integers, so a pair is given up only if its bound is below the
threshold by half and by what rounding may add.  Ties go to the smaller vec_id,
null last, then to the row.  Rows are told apart by their place in a written
table, not by id: rows that repeat a vec_id or a vector are candidates of each
other.  Vectors of different lengths don't meet; those of one length do, also of
none.  Vectors that are null, hold null or non-finite components, or components
whose floor is beyond 2**28 (whose scores could leave 64 bits) take no part.  No
candidates give no rows; an empty table gives an empty one.  Further columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.workspace import discard, materialise

SEGMENTS = (1, 4, 16)
#: Rows of a block, at most about; and pairs of a tile looked at together.
BLOCK, PAIRS = 1 << 17, 1 << 21
#: Blocks of candidates are no smaller than this, to be worth a task.
LEAST_BLOCK = 1 << 10
FIRST_WAVE = 16
MOST = 1 << 28


def quantised(vectors: DataFrame, scale: float = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x as a double, for vectors that take part."""
    fit = lambda x: x.isNotNull() & ~F.isnan(x) & F.floor(x.cast("double") * scale).between(-MOST, MOST)
    good = vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", fit))
    return good.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Features of each vector whose inner products bound the vectors' own: mean and deviation of each segment, times the root of its length."""
    ends = np.unique(np.linspace(0, v.shape[1], segments + 1).astype(int))
    lens = np.diff(ends)
    if not len(lens):
        return np.zeros((len(v), 0))
    x = v.astype(float)
    total = np.add.reduceat(x, ends[:-1], axis=1)
    mean = total / lens
    spread = np.add.reduceat((x - np.repeat(mean, lens, axis=1)) ** 2, ends[:-1], axis=1)
    return np.hstack([total / np.sqrt(lens), np.sqrt(spread)])


def _products(a: np.ndarray, b: np.ndarray, alive: np.ndarray, none) -> np.ndarray:
    """Inner products of the pairs alive, ``none`` elsewhere: all at once, or one by one where few are left."""
    if alive.mean() > 0.05:
        return np.where(alive, a @ b.T, none)
    out = np.full(alive.shape, none, np.result_type(a, b))
    i, j = np.nonzero(alive)
    for at in range(0, len(i), 1 << 17):
        x, y = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
        out[x, y] = np.einsum("ij,ij->i", a[x], b[y])
    return out


def best_of_tile(asked: np.ndarray, asked_row: np.ndarray, floor: np.ndarray, held: np.ndarray, held_row: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score): of each query its k best candidates, or those that reach its floor, if fewer.

    asked, held: integer vectors.  Rows that are the same don't meet.  order: which of candidates with equal scores comes first.
    """
    levels = [(statistics(asked, s), statistics(held, s)) for s in SEGMENTS]
    room = 1e-9 * np.sqrt((asked.astype(float) ** 2).sum(1))[:, None] * np.sqrt((held.astype(float) ** 2).sum(1).max(initial=0)) + 0.5
    large = int(np.abs(asked).max(initial=0)) * int(np.abs(held).max(initial=0)) * max(1, asked.shape[1]) >= 1 << 53
    exact = (asked, held) if large else (asked.astype(float), held.astype(float))
    out = []
    step = max(1, min(PAIRS // max(1, len(held)), 4 * PAIRS // (k * max(1, asked.shape[1]))))
    for at in range(0, len(asked), step):
        own = slice(at, at + step)
        alive = asked_row[own, None] != held_row[None, :]
        least = floor[own].astype(float)
        for q, c in levels:
            bound = _products(q[own], c, alive, -np.inf)
            if bound.shape[1] > k:  # the most promising ones say what is to be reached
                top = np.argpartition(-bound, k - 1, axis=1)[:, :k]
                scores = np.einsum("ij,ikj->ik", exact[0][own], exact[1][top]).astype(float)
                reached = np.where(np.take_along_axis(alive, top, 1), scores, -np.inf).min(1)
                least = np.maximum(least, reached)
            alive &= bound >= least[:, None] - room[own]
        score = _products(exact[0][own], exact[1], alive, np.iinfo(np.int64).min if large else -np.inf)
        i, j = np.nonzero(alive & (score >= least[:, None] if not large else alive))
        s = score[i, j].astype(np.int64)
        by = np.lexsort((order[j], -s, i))
        i, j, s = i[by], j[by], s[by]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[keep] + at, j[keep], s[keep]))
    return tuple(np.concatenate([x[n] for x in out]) if out else np.zeros(0, np.int64) for n in range(3))


def _tile(k: int):
    def matrix(table: pa.Table) -> np.ndarray:
        flat = table.column("v").combine_chunks()
        flat = flat.flatten() if len(table) else pa.array([], pa.int64())
        return flat.to_numpy(zero_copy_only=False).reshape(len(table), -1) if len(table) and len(flat) else np.zeros((len(table), 0), np.int64)

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("asked", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not len(asked) or not len(held):
            return schema.empty_table()
        number = lambda t, c: t.column(c).to_numpy()
        least = asked.column("least").fill_null(np.iinfo(np.int64).min).to_numpy()
        ids = held.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        order = np.empty(len(ids), np.int64)
        order[np.lexsort((number(held, "row"), held.column("vec_id").is_null().to_numpy(), ids))] = np.arange(len(ids))
        i, j, s = best_of_tile(matrix(asked), number(asked, "row"), least, matrix(held), number(held, "row"), order, k)
        i, j = pa.array(i), pa.array(j)
        return pa.Table.from_arrays([asked.column("row").take(i), asked.column("vec_id").take(i), held.column("row").take(j), held.column("vec_id").take(j), pa.array(s)], schema=schema)

    return run


def _scored(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    kind = "asked bigint, query_id bigint, row bigint, vec_id bigint, score bigint"
    key = ("dim", "cb", "qb")
    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(_tile(k), kind)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("asked").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, asks: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k largest integer inner products of each query with all other rows.

    vectors: bigint vec_id and v, integer components (see ``quantised``).  asks: which rows are queries.
    """
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(vectors.select("vec_id", "v", F.size("v").alias("dim"), F.coalesce(asks, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")), "search-rows")
    n, queries = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks = max(1, -(-n // BLOCK), min(parts, -(-n // LEAST_BLOCK)))
    groups = max(1, -(-queries // BLOCK))
    first = -(-blocks // FIRST_WAVE)
    held = rows.select("dim", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("cb"), "row", "vec_id", "v")
    asked = rows.where("asks").select("dim", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int").alias("qb"), "row", "vec_id", "v")

    def wave(begin: int, stop: int, asking: DataFrame) -> DataFrame:
        own = asking.select(*(F.col(c).alias(c) for c in asking.columns))  # columns of their own, not those of the other side
        left = own.withColumn("cb", F.explode(F.sequence(F.lit(begin), F.lit(stop - 1))))
        right = held.where(F.col("cb").between(begin, stop - 1)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return _best(_scored(left, right, k), k)

    found = materialise(wave(0, first, asked.withColumn("least", F.lit(None).cast("bigint"))), "search-first")
    if first < blocks:
        reached = found.groupBy(F.col("asked").alias("row")).agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        rest = wave(first, blocks, asked.join(reached, "row", "left"))
        found = materialise(_best(found.drop("rank").unionByName(rest.drop("rank")), k), "search-all", instead_of=(found,))
    discard(rows)
    return found.select("query_id", "rank", "vec_id", "score")
