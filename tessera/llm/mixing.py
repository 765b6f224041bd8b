"""Mixing of sources to target weights by temperature; DataFrame functions only.

A source with share p of the tokens gets weight p**e / sum of p**e.  The
exponent e = k / STEPS lies between 0 (all sources alike) and 1 (as they are):
entropy falls and the most repeated source is repeated less as it rises, so
either target fixes it.  It is found by bisection on k, several midpoints to a
job: each round takes 16 exponents between the ends and keeps the part that holds the target.

* ``entropy``: the largest e whose weights have at least this share of the
  entropy of equal weights.
* ``repeats``: the smallest e with which no source is repeated more than this
  often within the budget.

The weights are realised as permutations in blocks.  Each source is read in
epochs; in each epoch its documents have a fresh pseudorandom order, the first
three hex digits of whose key name one of 4,096 blocks.  Whole epochs go in first;
of the last, partial one, whole blocks, and then documents of the one block
that the budget ends in, each while the tokens before it leave room.  So a
source is over its budget by less than one document, and no window ever sorts
more than a 4,096th of a source; a source's blocks are small sums.

Documents without tokens are never drawn; sources without tokens have no weight.
Null sources form a source of their own.  Ties cannot arise: keys end in doc_id;
rows that repeat a doc_id (or have none) and source share their fate.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.workspace import materialise, unused

STEPS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, and n_tokens (words) of every row."""
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("bigint").alias("n_tokens"))


def measures(shares: DataFrame, ks: list[int]) -> dict[int, tuple[float, float]]:
    """For each exponent k / STEPS: entropy over that of equal weights, and the most repeats of a source (budget over tokens)."""
    each = shares.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("m", F.pow("p", F.col("k") / STEPS))
    found = each.groupBy("k").agg(F.sum("m").alias("z"), F.sum(F.col("m") * F.log("m")).alias("ml"), F.max(F.col("m") / F.col("p")).alias("r"), F.count("*").alias("n"))
    out = found.select("k", F.when(F.col("n") > 1, (F.log("z") - F.col("ml") / F.col("z")) / F.log("n")).otherwise(1.0).alias("h"), (F.col("r") / F.col("z")).alias("r")).collect()
    return {x.k: (x.h, x.r) for x in out}


def exponent(shares: DataFrame, entropy: float | None, repeats: float | None, budget_share: float) -> int:
    """k of the exponent k / STEPS that meets the target; each round cuts the bracket in 17."""
    low, high = 0, STEPS  # entropy: low meets it; repeats: high is taken if nothing below meets it
    while high - low > 1:
        ks = sorted({low + (high - low) * i // 17 for i in range(1, 17)} - {low, high})
        got = measures(shares, ks)
        for k in ks:
            if (got[k][0] >= entropy) if entropy is not None else (got[k][1] * budget_share > repeats):
                low = k
            else:
                high = k
                break
    ends = measures(shares, [low, high])
    if entropy is not None:
        return high if ends[high][0] >= entropy else low
    return low if ends[low][1] * budget_share <= repeats else high


def plan(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget_share: float = 1.0, seed: int = 0) -> DataFrame:
    """doc_id, source, n_tokens, k, weight, budget and copies of every row.

    docs: doc_id, source, text.  Give one of entropy (0 to 1, share of the largest)
    and repeats (1 or more).  budget_share: tokens to draw, as a share of all.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("give entropy or repeats")
    rows = materialise(sizes(docs), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("n_tokens").alias("t")).where("t > 0")
    total = sources.agg(F.sum("t")).first()[0] or 0
    shares = materialise(sources.withColumn("p", F.col("t") / F.lit(float(total or 1))), "mix-shares")
    k = exponent(shares, entropy, repeats, budget_share) if total else STEPS
    z = shares.agg(F.sum(F.pow("p", F.lit(k / STEPS)))).first()[0] or 1.0
    weighted = shares.withColumn("weight", F.pow("p", F.lit(k / STEPS)) / F.lit(z))
    weighted = weighted.withColumn("budget", F.floor(F.col("weight") * F.lit(float(total) * budget_share)))
    weighted = weighted.withColumn("epochs", F.floor(F.col("budget") / F.col("t"))).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("t"))
    same = F.col("source").eqNullSafe(F.col("s"))
    own = rows.join(weighted.withColumnRenamed("source", "s"), same, "left").drop("s")
    keyed = own.withColumn("key", _key(seed, F.col("epochs")))
    keyed = materialise(keyed.withColumn("block", F.substring("key", 1, 3)), "mix-keys", instead_of=(rows, shares))
    blocks = keyed.where("n_tokens > 0").groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).select(F.col("source").alias("s"), F.col("block").alias("b"), "base", (F.col("base") + F.col("size") <= F.col("rest")).alias("whole"), (F.col("base") < F.col("rest")).alias("begun"))
    met = keyed.join(placed, same & (F.col("block") == F.col("b")), "left")
    edge = met.where("begun and not whole and n_tokens > 0")
    edge = edge.withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    edge = edge.withColumn("drawn", (F.col("base") + F.col("upto") - F.sum("n_tokens").over(Window.partitionBy("source", "block", "key"))) < F.col("rest"))
    sure = met.where("not (coalesce(begun, false) and not coalesce(whole, false) and n_tokens > 0)").withColumn("drawn", F.coalesce("whole", F.lit(False)) & (F.col("n_tokens") > 0))
    every = sure.select(*keyed.columns, "drawn").unionByName(edge.select(*keyed.columns, "drawn"))
    copies = F.when(F.col("n_tokens") > 0, F.coalesce("epochs", F.lit(0)) + F.col("drawn").cast("bigint")).otherwise(F.lit(0)).cast("bigint")
    return every.select("doc_id", "source", "n_tokens", F.lit(k).alias("k"), "weight", "budget", copies.alias("copies"))


def schedule(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget_share: float = 1.0, seed: int = 0) -> DataFrame:
    """The plan as the blocks that are read: a row for each document and epoch in which it is drawn.

    epoch (from 0), block (of 4,096) and position (from 0 in the epoch's block) say
    when: a source is read by epoch, block and position.  Documents that are never
    drawn have one row without them.
    """
    planned = plan(docs, entropy, repeats, budget_share, seed)
    each = planned.withColumn("epoch", F.explode_outer(F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))))
    keyed = each.withColumn("key", F.when(F.col("epoch").isNotNull(), _key(seed, F.col("epoch"))))
    placed = keyed.withColumn("block", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    inside = Window.partitionBy("source", "epoch", "block").orderBy("key", "doc_id")
    drawn = placed.where("epoch is not null").withColumn("position", F.row_number().over(inside) - 1)
    never = placed.where("epoch is null").withColumn("position", F.lit(None).cast("int"))
    return drawn.unionByName(never).drop("key")


def _key(seed: int, epoch) -> Column:
    """What orders the documents of a source in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("doc_id").cast("string")).cast("binary"))


def mixed(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget_share: float = 1.0, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as the plan draws it, with all their columns, in the order of the schedule.

    Partitions hold ranges of blocks; inside one, rows go by epoch, block and key, sources mingled.  What decides
    on a row is its id, its source and whether it has tokens, so rows that share an id and a source are told
    apart as far as they differ: those without tokens are never drawn.
    """
    ident, source, times, turn, key = (unused(docs, n) for n in ("mix_id", "mix_source", "mix_copies", "mix_epoch", "mix_key"))
    drawn = plan(docs, entropy, repeats, budget_share, seed).where("copies > 0").select(F.col("doc_id").alias(ident), F.col("source").alias(source), F.col("copies").alias(times)).distinct()
    rows = docs.where(F.col("text").rlike(WORD)).join(drawn, F.col("doc_id").eqNullSafe(F.col(ident)) & F.col("source").eqNullSafe(F.col(source)))
    each = rows.withColumn(turn, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(times) - 1))).withColumn(key, _key(seed, F.col(turn)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.conv(F.substring(key, 1, 3), 16, 10).cast("int")
    return each.repartitionById(parts, F.floor(block * parts / 4096).cast("int")).sortWithinPartitions(turn, key).select(*docs.columns)
