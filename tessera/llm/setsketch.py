"""Near-duplicate documents by SetSketch registers, banded, estimated and verified.

A document's set holds its distinct runs of ``words`` words (A-Z in lower case;
words are runs of bytes other than 0x20 and 0x09-0x0D); a shorter document's
whole sequence is its one element, an empty one has none and links with
nothing.  Register i of a set is the truncated logarithm, to the base ``BASE``,
of the smallest of its elements' exponential hash values: registers of a union
are the larger ones of the parts', and two sets share a register about as often
as they share elements.

1. One pass over the texts: set size, a 128-bit signature of the set, registers.
2. Documents with equal sets collapse into a class; only classes go on, so
   copies cost one row.
3. Bands of ``ROWS`` registers put classes in buckets.  Each member is
   paired with the smallest of its bucket, not with every other one.
4. A pair is given up only if the joint likelihood of its registers, given both
   exact set sizes, is e**16 times smaller for every similarity at or above the
   threshold than for the best one below.  What is left is verified on the full sets of
   the whole texts.
5. Buckets that still hold several components are searched in full, block
   against block: every pair of members of different components is estimated,
   and verified if it can't be ruled out, without a row for each pair.  Members
   of the bucket's largest component never meet each other, so a hot group costs
   its size times the number of blocks of the others.

With 48 bands of 5 a pair at 0.75 shares no bucket in 2 cases of a million.

Null text counts as empty.  An empty table gives an empty result.  Rows that
repeat a doc_id all get a row, each with its own set's links: classes go by a
number of their own, not by an id, and a class's text is found by its id and
128 bits of its SHA-256.  Rows without a doc_id link like others; a
component without any id has none, and its rows are all kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.components import components
from tessera.plans.workspace import discard, materialise

from .text import mark_of, marks, mix, shingles, slices, words_of

BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65534
GIVE_UP = 16.0
#: Elements of all sets in a cell, about; one document's set may be more.
CELL_ELEMENTS = 1 << 20

_rng = np.random.Generator(np.random.PCG64(77))
_FLIP = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_FACTOR = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def registers(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of REGISTERS 16-bit registers for each non-empty run of elements."""
    low = (elements >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, REGISTERS), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(REGISTERS):
            out[:, i] = np.minimum.reduceat((low ^ _FLIP[i]) * _FACTOR[i], first[:-1])
    h = -np.log1p(-(out + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def distinct(elements: np.ndarray, first: np.ndarray, checks: np.ndarray | None = None) -> tuple:
    """Each row's distinct elements in order, and each row's first one; with ``checks``, those of the elements that stay."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(elements, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    e, r = elements[order], row[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (r[1:] != r[:-1])
    begin = np.searchsorted(r[new], np.arange(len(first)))
    return (e[new], begin) if checks is None else (e[new], begin, checks[order][new])


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, _, _, first = words_of(part, True)
                other, *_ = words_of(part, True, 1)
                checks, _ = shingles(other, first, size, 1)
                e, begin, checks = distinct(*shingles(hashes, first, size), checks)
                counts = np.diff(begin)
                full = np.flatnonzero(counts)
                sums = np.zeros((2, part.n), np.uint64)
                regs: list = [None] * part.n
                if len(full):
                    cut = np.append(begin[:-1][full], begin[-1])
                    with np.errstate(over="ignore"):
                        sums[0, full] = np.add.reduceat(mix(e), cut[:-1])
                        sums[1, full] = np.add.reduceat(checks, cut[:-1])
                    for i, r in zip(full, registers(e, cut), strict=True):
                        regs[i] = r.tobytes()
                yield pa.RecordBatch.from_arrays([part.rows.column(0), pa.array(counts, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), marks(part, range(part.n)), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "s0", "s1", "t", "regs"])

    return run


def log_likelihood(more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the similarities j, given how many registers of the first set are larger, smaller and equal; u: its share of the two sizes."""
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))


def may_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the joint likelihood of two rows of registers leaves room for a similarity at or above the threshold."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same, u = REGISTERS - more - less, (na / (na + nb))[:, None]
    most = np.minimum(na, nb) / np.maximum(na, nb)
    j = np.linspace(0, 1, 41)[None, :] * most[:, None]
    best = log_likelihood(more, less, same, u, j).max(1)
    high = threshold + np.linspace(0, 1, 21)[None, :] * np.maximum(most - threshold, 0)[:, None]
    return (log_likelihood(more, less, same, u, high).max(1) >= best - GIVE_UP) & (most >= threshold - 1e-9)


def _likely(threshold: float):
    """Pairs whose similarity may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (2, 3))
                na, nb = (batch.column(k).to_numpy().astype(float) for k in (4, 5))
                yield batch.select([0, 1]).filter(pa.array(may_reach(a, b, na, nb, threshold)))

    return run


def _verify(size: int, percent: int):
    """Pairs with 100 * intersection >= percent * union, from their whole texts."""

    def sets(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
        out = []
        for part in slices(batch, column):
            hashes, _, _, first = words_of(part, True)
            e, begin = distinct(*shingles(hashes, first, size))
            out += [e[begin[i] : begin[i + 1]] for i in range(part.n)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                keep = []
                for x, y in zip(sets(batch, "ta"), sets(batch, "tb"), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(pairs: DataFrame, regs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: registers first, then full sets."""
    one = regs.select(F.col("class").alias("a"), F.col("regs").alias("ra"), F.col("n_shingles").alias("na"))
    two = regs.select(F.col("class").alias("b"), F.col("regs").alias("rb"), F.col("n_shingles").alias("nb"))
    tested = pairs.join(one, "a").join(two, "b").where(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))
    likely = materialise(tested.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(_likely(percent / 100), "a bigint, b bigint"), "likely")
    ta = texts.select(F.col("class").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("class").alias("b"), F.col("text").alias("tb"))
    return materialise(likely.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(size, percent), "a bigint, b bigint"), "links", instead_of=(likely,))


def _groups(batches: Iterator[pa.RecordBatch], keys: int, most: int = 1 << 30) -> Iterator[pa.Table]:
    """Runs of rows that agree in their first columns, from rows sorted by them, in pieces of up to ``most`` rows."""
    held: list[pa.RecordBatch] = []
    key, n = None, 0
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
            if held and (own != key or n + y - x > most):
                yield pa.Table.from_batches(held)
                held, n = [], 0
            key = own
            held.append(batch.slice(x, y - x))
            n += y - x
    if held:
        yield pa.Table.from_batches(held)


def _block_pairs(threshold: float, block: int):
    """Packed pairs of each block of a bucket that differ in component, meet here first and may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            band = table.column("band")[0].as_py()
            ids, part, n, side, home = (table.column(c).to_numpy() for c in ("id", "component", "n_shingles", "block", "home"))
            regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
            xs, ys = np.flatnonzero(side == p), np.flatnonzero(side == q)
            found = []
            for x in xs:
                y = ys[ys > x] if p == q else ys
                most = np.minimum(n[x], n[y]) / np.maximum(n[x], n[y])
                y = y[(part[y] != part[x]) & (most >= threshold - 1e-9)]
                if not len(y):
                    continue
                y = y[_first_band(regs[x], regs[y]) == band]
                if len(y):
                    y = y[may_reach(np.broadcast_to(regs[x], (len(y), REGISTERS)), regs[y], np.full(len(y), n[x], float), n[y].astype(float), threshold)]
                    found += [(home[x], home[k], ids[x], ids[k]) if home[x] <= home[k] else (home[k], home[x], ids[k], ids[x]) for k in y]
            if found:
                f = np.array(sorted(found), np.int64)
                cut = np.flatnonzero((np.diff(f[:, :2], axis=0, prepend=-1) != 0).any(1))
                parts = np.split(f, cut[1:])
                yield pa.RecordBatch.from_arrays([pa.array([int(x[0, 0]) for x in parts], pa.int64()), pa.array([int(x[0, 1]) for x in parts], pa.int64()), pa.array([np.ascontiguousarray(x[:, 2:]).tobytes() for x in parts], pa.binary())], ["ci", "cj", "pairs"])

    return run


def _first_band(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return (many == one).reshape(len(many), BANDS, ROWS).all(2).argmax(1)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ci, cj, id): the documents that a cell's pairs need, each once for each task that has pairs of the cell."""
    held, n = [], 0

    def rows() -> pa.RecordBatch:
        found = np.unique(np.concatenate(held), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(3)], ["ci", "cj", "id"])

    for batch in batches:
        for i, j, pairs in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            ids = np.unique(np.frombuffer(pairs, np.int64))
            held.append(np.stack([np.full(len(ids), i), np.full(len(ids), j), ids], 1))
            n += len(ids)
            if n >= 1 << 20:
                held = [np.unique(np.concatenate(held), axis=0)]
                n = len(held[0])
                if n >= 1 << 19:
                    yield rows()
                    held, n = [], 0
    if held:
        yield rows()


def _verify_cells(size: int, percent: int):
    """Links among the packed pairs of each cell; a cell's documents come before its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets = None, {}
        for table in _groups(batches, 3, 64):  # a cell's documents, then its pairs, some rows at a time
            own = (table.column("ci")[0].as_py(), table.column("cj")[0].as_py())
            if own != cell:
                cell, sets = own, {}
            if table.column("kind")[0].as_py() == 0:
                for batch in table.select(["id", "text"]).to_batches():
                    at = batch.column(0).to_pylist()
                    for part in slices(batch):
                        hashes, _, _, first = words_of(part, True)
                        e, begin = distinct(*shingles(hashes, first, size))
                        for i in range(part.n):
                            sets[at[i]] = e[begin[i] : begin[i + 1]].copy()
                        at = at[part.n :]
                continue
            links = []
            for pairs in table.column("pairs").to_pylist():
                for a, b in np.frombuffer(pairs, np.int64).reshape(-1, 2).tolist():
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        links.append((a, b))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], ["a", "b"])

    return run


def _across(bands: DataFrame, parts: DataFrame, regs: DataFrame, texts: DataFrame, size: int, percent: int, block: int = 1024, cell: int = 256) -> DataFrame:
    """Every link between members of one bucket that are not connected yet.

    Buckets are searched block against block in numpy, so that no row is made
    for a pair: a block sends the pairs that registers can't rule out, packed,
    to cells of about ``cell`` by ``cell`` documents, or fewer where sets are
    large, where full sets settle them.
    """
    placed = bands.join(parts, "id", "left").select("id", "key", "band", F.coalesce("component", "id").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    open_rows = materialise(placed.join(split.select("key"), "key", "left_semi"), "open")
    shares = open_rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = shares.groupBy("key").agg(F.max_by("component", F.col("n")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    few, many = F.ceil((F.col("n") - F.col("most")) / block).cast("int"), F.ceil(F.col("most") / block).cast("int")
    count, elements = open_rows.select("id").distinct().join(regs, F.col("id") == F.col("class")).agg(F.count("*"), F.sum("n_shingles")).first()
    cells = max(1, -(-count // cell), -(-(elements or 0) // CELL_ELEMENTS))
    draw, inside = F.xxhash64("id", F.lit(1)), F.col("component") == F.col("main")
    own = open_rows.join(sizes.select("key", "main", few.alias("few"), many.alias("many")), "key")
    own = own.withColumn("block", F.when(inside, F.col("few") + F.pmod(draw, F.col("many"))).otherwise(F.pmod(draw, F.col("few"))).cast("int")).withColumn("home", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(cells)))
    own = own.join(regs.select(F.col("class").alias("id"), "n_shingles", "regs"), "id")
    others = F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1))).withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    dealt = dealt.select("key", "p", "q", "band", "id", "component", "n_shingles", "block", "home", "regs").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    packed = dealt.mapInArrow(_block_pairs(percent / 100, block), "ci bigint, cj bigint, pairs binary")
    packed = materialise(packed.repartition("ci", "cj"), "packed")
    wanted = packed.mapInArrow(_members, "ci bigint, cj bigint, id bigint").distinct()
    docs = wanted.join(texts, F.col("id") == F.col("class")).select("ci", "cj", F.lit(0).alias("kind"), "id", "text", F.lit(None).cast("binary").alias("pairs"))
    both = docs.unionByName(packed.select("ci", "cj", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("text"), "pairs"))
    return materialise(both.repartition("ci", "cj").sortWithinPartitions("ci", "cj", "kind").mapInArrow(_verify_cells(size, percent), "a bigint, b bigint"), "links", instead_of=(open_rows, packed))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept, a row for each row of ``docs``.

    docs: an integer doc_id and text; further columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketches = materialise(docs.mapInArrow(_sketches(words), "doc_id bigint, n_shingles bigint, s0 bigint, s1 bigint, t binary, regs binary"), "sketches")
    grouped = sketches.where("n_shingles > 0").groupBy("s0", "s1", "n_shingles").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "t", "regs")).alias("one"))
    classes = materialise(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")  # numbers that stay as they were written
    bands = materialise(classes.select(F.col("class").alias("id"), F.posexplode(F.array(*(F.xxhash64(F.lit(i), F.expr(f"substring(one.regs, {2 * ROWS * i + 1}, {2 * ROWS})")) for i in range(BANDS)))).alias("band", "key")), "bands")
    hubs = bands.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    bands = materialise(bands.join(hubs, "key"), "shared-bands", instead_of=(bands,))  # only buckets of two or more go on
    near = classes.join(bands.select(F.col("id").alias("class")).distinct(), "class", "left_semi")
    regs = materialise(near.select("class", "n_shingles", "one.regs", F.col("one.doc_id").alias("of"), F.col("one.t").alias("of_t")), "near-registers")
    numbered = docs.withColumn("t", mark_of("text"))
    texts = numbered.join(regs.select("class", "of", "of_t"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("t") == F.col("of_t")))
    texts = materialise(texts.select("class", "text").dropDuplicates(["class"]), "near-texts")
    stars = bands.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    links = _linked(stars, regs, texts, words, percent)
    more = _across(bands.drop("hub"), components(links, "a", "b"), regs, texts, words, percent)
    parts = components(links.unionByName(more), "a", "b")
    discard(bands, regs, texts, links, more)
    known = classes.select("s0", "s1", "n_shingles", "low", F.col("class").alias("id")).join(parts, "id", "left").withColumn("part", F.coalesce("component", "id"))
    lowest = known.where("component is not null").groupBy("part").agg(F.min("low").alias("least"))
    known = known.join(lowest, "part", "left").select("s0", "s1", "n_shingles", F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("least")).alias("least"), F.lit(True).alias("has"))
    member = sketches.select("doc_id", "n_shingles", "s0", "s1").join(known, ["s0", "s1", "n_shingles"], "left")
    return member.select("doc_id", "n_shingles", F.when(F.col("has"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
