"""Registered queries of readers and writers: a table is written by a sink, read by a source, and compared in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import adapters as A
from tessera.functions import columns as C
from tessera.functions.columns import dbl
from tessera.operators import graphs, kernels, raster, tuning
from tessera.plans.workspace import fresh_path, materialise
from tessera.queries import FRAME, HALFDISK, KERNEL, S, _frame, bounded, height, points, query
from tessera.sources import arrays, tables


def _one_file(df: DataFrame, name: str, order: str, kind: str = "csv") -> str:
    """The path of a table saved as one file, whose rows are in order."""
    path = fresh_path(df.sparkSession, name)
    tables.save(df.coalesce(1).sortWithinPartitions(order).drop("_order"), path, kind)
    return path


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.spots(spark, sf_dir).withColumn("_order", F.col("spot_id"))


_KEY = "round_even(x, 0)::BIGINT || '_' || round_even(y, 0)::BIGINT"


@query(f"{S}, out AS (SELECT spot_id, barcode, x, y, {_KEY} AS xy_key FROM spots)", "x y", "spot_id barcode xy_key")
def source_coords_strict(spark, sf_dir):
    return tables.coords_strict(spark, _one_file(_spots(spark, sf_dir).select("barcode", "x", "y", "_order"), "coords", "_order"))


@query(f"{S}, out AS (SELECT spot_id, barcode, x, y FROM spots)", "x y", "spot_id barcode")
def source_coords_named(spark, sf_dir):
    """Columns in another order, with spaces and capitals in their names."""
    own = _spots(spark, sf_dir).select(F.col("y").alias(" Y"), "macro", F.col("barcode").alias("BarCode "), F.col("x").alias("X"), "_order")
    return tables.coords_named(spark, _one_file(own, "coords", "_order"))


@query(f"{S}, out AS (SELECT 'alias' AS rule, spot_id, x, y FROM spots UNION ALL SELECT 'last', spot_id, x, y FROM spots UNION ALL SELECT 'first', spot_id, label12::DOUBLE, x FROM spots)", "x y", "rule spot_id")
def source_coords_any(spark, sf_dir):
    """By the usual names, and by the last and the first two numeric columns."""
    named = _one_file(_spots(spark, sf_dir).select("barcode", F.col("y").alias("ImageRow"), F.col("x").alias("imagecol"), "_order"), "coords", "_order")
    plain = _one_file(_spots(spark, sf_dir).select("macro", F.col("label12").alias("a"), F.col("x").alias("b"), F.col("y").alias("c"), "_order"), "coords", "_order")
    cols = [F.col(c) for c in ("spot_id", "x", "y")]
    rows = [tables.coords_any(tables.csv(spark, named)).select(F.lit("alias").alias("rule"), *cols)]
    rows += [tables.coords_any(tables.csv(spark, plain), rule).select(F.lit(rule).alias("rule"), *cols) for rule in ("last", "first")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"{S}, out AS (SELECT spot_id, x, y FROM spots)", "x y", "spot_id")
def source_coords_auto(spark, sf_dir):
    """The first of several files that can be read: the one called coords_a holds no coordinates."""
    folder = fresh_path(spark, "coords-folder")
    tables.save(A.spots(spark, sf_dir).select("barcode"), f"{folder}/coords_a.parquet")
    tables.save(_spots(spark, sf_dir).coalesce(1).sortWithinPartitions("_order").select("x", "y"), f"{folder}/coords_b.parquet")
    return tables.coords_auto(spark, folder)


@query(f"{S}, out AS (SELECT spot_id, macro AS label FROM spots)", "", "spot_id label")
def source_labels(spark, sf_dir):
    return tables.labels(tables.csv(spark, _one_file(_spots(spark, sf_dir).select("x", F.col("macro").alias("Macro_Niche"), "_order"), "labels", "_order")))


@query(f"{S}, out AS (SELECT barcode AS spot, x, y, label12::VARCHAR AS label FROM spots)", "x y", "spot label")
def source_labelled_coords(spark, sf_dir):
    """By place: index, x, y, barcode, label."""
    own = _spots(spark, sf_dir).select(F.col("spot_id").alias("n"), F.col("x").alias("p"), F.col("y").alias("q"), F.concat(F.lit(" "), "barcode").alias("who"), F.col("label12").alias("what"), "_order")
    return tables.labelled_coords(tables.csv(spark, _one_file(own, "labelled", "_order")))


@query(f"{S}, out AS (SELECT barcode AS spot, macro, label12::INTEGER AS micro_id, CASE WHEN spot_id % 3 = 0 THEN label12::VARCHAR ELSE macro || ':' || label12 END AS micro_name FROM spots)", "", "spot macro micro_id micro_name")
def source_micro(spark, sf_dir):
    name = F.when(F.col("spot_id") % 3 != 0, F.concat_ws(":", "macro", F.col("label12").cast("string")))
    return tables.micro(tables.csv(spark, _one_file(_spots(spark, sf_dir).select(F.col("barcode").alias("Spot"), "macro", F.col("label12").alias("micro_id"), name.alias("micro_name"), "_order"), "micro", "_order")))


@query(f"{S}, {A.EXPR_SQL}, out AS (SELECT DISTINCT barcode AS spot, macro FROM expr JOIN spots USING (spot_id))", "", "spot macro")
def source_macro_coverage(spark, sf_dir):
    """The macro zone of every spot that has expression."""
    spots = A.spots(spark, sf_dir)
    rows = tables.macro(tables.csv(spark, _one_file(_spots(spark, sf_dir).select("barcode", F.col("macro").alias("zone"), "_order"), "macro", "_order")), "zone", "barcode")
    return tables.coverage(A.expr(spark, sf_dir).join(spots, "spot_id").select(F.col("barcode").alias("spot")), rows)


def _wide(spark, sf_dir) -> DataFrame:
    """Spots by genes."""
    return A.expr(spark, sf_dir).join(A.spots(spark, sf_dir).select("spot_id", "barcode"), "spot_id").groupBy("barcode").pivot("gene").agg(F.sum("value")).withColumn("_order", F.col("barcode"))


_GRID = f"{S}, {A.EXPR_SQL}, gs AS (SELECT DISTINCT gene FROM expr), sp AS (SELECT DISTINCT barcode, spot_id FROM expr JOIN spots USING (spot_id))"


@query(f"{_GRID}, out AS (SELECT barcode AS spot, gene, ln(1 + value) AS value FROM sp CROSS JOIN gs LEFT JOIN expr USING (spot_id, gene))", "value", "spot gene")
def source_expr_spots_by_genes(spark, sf_dir):
    return tables.expr_long(tables.csv(spark, _one_file(_wide(spark, sf_dir), "expr", "_order")), "spots_by_genes", log1p=True)


@query(f"{S}, {A.EXPR_SQL}, out AS (SELECT macro AS spot, gene, sum(value) AS value FROM expr JOIN spots USING (spot_id) GROUP BY ALL)", "value", "spot gene")
def source_expr_genes_by_spots(spark, sf_dir):
    """Genes in rows, zones in columns; the layout is found from the columns."""
    rows = A.expr(spark, sf_dir).join(A.spots(spark, sf_dir), "spot_id").groupBy("gene").pivot("macro").agg(F.sum("value")).withColumn("_order", F.col("gene"))
    return tables.expr_long(tables.csv(spark, _one_file(rows, "expr", "_order")))


@query(f"{_GRID}, out AS (SELECT spot_id, gene, coalesce(value, 0) AS value FROM spots CROSS JOIN gs LEFT JOIN expr USING (spot_id, gene))", "value", "spot_id gene")
def source_aligned_expr(spark, sf_dir):
    """Every spot and gene; a gene written twice counts by its larger value."""
    long = tables.expr_long(tables.csv(spark, _one_file(_wide(spark, sf_dir), "expr", "_order")), "spots_by_genes")
    twice = long.unionByName(long.withColumn("value", F.col("value") / 2))
    return tables.aligned_expr(materialise(twice, "expr-long"), A.spots(spark, sf_dir))


@query("out AS (SELECT DISTINCT upper(p_brand) AS gene FROM part)", "", "gene")
def source_gene_set(spark, sf_dir):
    own = A.table(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.lower("p_brand"), F.lit(".1")).alias("Gene"), F.col("p_partkey").alias("_order"))
    return tables.gene_set(tables.csv(spark, _one_file(own, "genes", "_order")))


_LR2 = f"{A.LR_SQL}, ab AS (SELECT ligand, receptor, pathway, ligand_annotation FROM lr UNION ALL SELECT receptor, ligand, pathway, ligand_annotation FROM lr)"


def _lr_files(spark, sf_dir) -> list[str]:
    lr = A.lr(spark, sf_dir)
    turned = lr.select(F.col("receptor").alias("ligand"), F.col("ligand").alias("receptor"), "pathway", "ligand_annotation")
    return [_one_file(x.withColumn("_order", F.col("ligand")), "lr", "_order") for x in (lr.select("ligand", "receptor", "pathway", "ligand_annotation"), turned)]


@query(f"{_LR2}, out AS (SELECT *, CASE WHEN regexp_matches(lower(ligand_annotation), '{'|'.join(C.MEMBRANE)}') THEN 'mb' ELSE 'secreted' END AS mode, (row_number() OVER (ORDER BY ligand, receptor, pathway, ligand_annotation) - 1)::BIGINT AS pair_id FROM ab)", "", "ligand receptor pathway ligand_annotation mode pair_id")
def source_lr_tables(spark, sf_dir):
    return tables.lr_tables(spark, _lr_files(spark, sf_dir))


@query(f"{A.LR_SQL}, out AS (SELECT 'named' AS rule, upper(ligand) AS ligand, upper(receptor) AS receptor, pathway, ligand_annotation, 'TF' || pair_id AS tf FROM lr UNION ALL SELECT 'last', upper(ligand), upper(receptor), pathway, ligand_annotation, 'TF' || pair_id FROM lr)", "", "rule ligand receptor pathway ligand_annotation tf")
def source_lr_database(spark, sf_dir):
    """By name, and by place."""
    lr = A.lr(spark, sf_dir).withColumn("tf", F.concat(F.lit("TF"), "pair_id"))
    cols = ["ligand", "receptor", "pathway", "ligand_annotation", "tf"]
    named = lr.select("tf", *reversed(cols[:4]), F.col("pair_id").alias("_order"))
    last = lr.select(F.col("pair_id").alias("n"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(cols)), F.col("pair_id").alias("_order"))
    rows = [tables.lr_database(tables.csv(spark, _one_file(x, "lr-db", "_order"))).withColumn("rule", F.lit(rule)) for rule, x in (("named", named), ("last", last))]
    return rows[0].unionByName(rows[1])


@query(f"{S}, {A.TF_SQL}, ks AS (SELECT spot_id, {_KEY} AS k FROM spots), wd AS (SELECT DISTINCT k FROM tf JOIN ks USING (spot_id)), nm AS (SELECT DISTINCT tf FROM tf), vl AS (SELECT k, tf, sum(value) AS value FROM tf JOIN ks USING (spot_id) GROUP BY ALL), out AS (SELECT spot_id, tf, coalesce(value, 0) AS value FROM ks JOIN wd USING (k) CROSS JOIN nm LEFT JOIN vl USING (k, tf))", "value", "spot_id tf")
def source_tf_activity(spark, sf_dir):
    """A wide table keyed by rounded coordinates."""
    spots = A.spots(spark, sf_dir)
    rows = A.tf(spark, sf_dir).join(spots, "spot_id").groupBy(tables.xy_key(F.col("x"), F.col("y")).alias("spot")).pivot("tf").agg(F.sum("value"))
    return tables.tf_activity(tables.csv(spark, _one_file(rows.withColumn("_order", F.col("spot")), "tf", "_order")), spots)


@query(f"{A.PIXELS_SQL}, out AS (SELECT 'wide' AS rule, y, x, v FROM pixels UNION ALL SELECT 'folded', (i // 40)::INTEGER, (i % 40)::INTEGER, (i * 7 % 11)::DOUBLE FROM range(0, 1600) t(i))", "v", "rule y x")
def source_raster(spark, sf_dir):
    """A wide table with a column for each x, and a single column folded to a square."""
    wide = A.pixels(spark, sf_dir).groupBy("y").pivot("x", list(range(12))).agg(F.first("v")).withColumn("_order", F.col("y"))
    flat = spark.range(1600).select(F.col("id").alias("n"), (F.col("id") * 7 % 11).cast("double").alias("v"), F.col("id").alias("_order"))
    rows = [tables.raster(tables.csv(spark, _one_file(x, "raster", "_order"))).withColumn("rule", F.lit(rule)) for rule, x in (("wide", wide), ("folded", flat))]
    return rows[0].unionByName(rows[1])


@query(f"{KERNEL}, out AS (SELECT src, dst, d, k, h FROM ke, h)", "d k h", "src dst")
def source_kernel_bundle(spark, sf_dir):
    """A kernel saved with its parameters, and read again."""
    _, g, h = bounded(spark, sf_dir)
    path = fresh_path(spark, "kernel")
    tables.save_kernel(kernels.iso(g, h), {"h": h, "policy": "iso"}, path)
    edges, meta = tables.load_kernel(spark, path)
    return edges.withColumn("h", dbl(float(meta["h"])))


_BANDS = [(1, 0, 0, 1.0), (1, 0, 1, 2.0), (1, 1, 0, 3.0), (1, 1, 1, 4.0), (2, 0, 0, 5.0), (2, 0, 1, 6.0)]


@query(
    f"""{A.PIXELS_SQL}, bd AS (SELECT * FROM (VALUES {', '.join(str(b) for b in _BANDS)}) t(level, bi, bj, f)), own AS (SELECT level, bi, bj, y, x, v * f AS v FROM pixels, bd),
    out AS (SELECT level::INTEGER AS level, bi::INTEGER AS bi, bj::INTEGER AS bj, y, x, v FROM own UNION ALL SELECT 2, bi::INTEGER, bj::INTEGER, y, x, v FROM own WHERE level = 1 AND bi = 1)""",
    "v",
    "level bi bj y x",
)
def source_bands(spark, sf_dir):
    """Subbands in files named by level and filters, one of them there twice; missing second levels come from the first."""
    folder, px = fresh_path(spark, "bands"), materialise(A.pixels(spark, sf_dir), "pixels")
    for lv, i, j, f in _BANDS:
        tables.save(px.withColumn("v", F.col("v") * f), f"{folder}/L{lv}_B{i}{j}_a.parquet")
    tables.save(px.withColumn("v", F.col("v") * 100), f"{folder}/L1_B00_b.parquet")
    own = tables.bands(spark, f"{folder}/*.parquet")
    tables.equal_sizes(own.withColumn("band", F.concat_ws("_", "level", "bi", "bj")), "band")
    return tables.with_second_level(own)


@query(f"{A.PIXELS_SQL}, out AS (SELECT level::INTEGER AS level, angle::INTEGER AS angle, y, x, v * level AS re, v * angle AS im FROM pixels, (VALUES (1, 15), (2, 15), (1, -45), (2, -45)) t(level, angle))", "re im", "level angle y x")
def source_angles(spark, sf_dir):
    """Complex subbands by level and angle; an angle that one level lacks is left out."""
    folder, px = fresh_path(spark, "angles"), materialise(A.pixels(spark, sf_dir), "pixels")
    for lv, angle in ((1, 15), (2, 15), (1, -45), (2, -45), (1, 75)):
        tables.save(px.select("y", "x", (F.col("v") * lv).alias("re"), (F.col("v") * angle).alias("im")), f"{folder}/w_L{lv}_ang{angle}_upsampled.parquet")
    return tables.angles(spark, f"{folder}/*.parquet")


@query(f"{S}, out AS (SELECT kind, spot_id, barcode, x, label12::BIGINT AS label12, macro FROM spots, (VALUES ('csv'), ('json'), ('orc'), ('parquet'), ('by_macro')) t(kind))", "x", "kind spot_id barcode label12 macro")
def sink_formats(spark, sf_dir):
    """One table through every writer: CSV, JSON, ORC, Parquet, and a folder for each macro zone."""
    own = materialise(A.spots(spark, sf_dir).select("spot_id", "barcode", "x", "label12", "macro"), "sink")
    schema, out = "spot_id bigint, barcode string, x double, label12 bigint, macro string", None
    for kind in ("csv", "json", "orc", "parquet", "by_macro"):
        path, form = fresh_path(spark, f"sink-{kind}"), "parquet" if kind == "by_macro" else kind
        tables.save(own.withColumn("label12", F.col("label12").cast("bigint")), path, form, by=["macro"] if kind == "by_macro" else ())
        got = spark.read.schema(schema).option("header", True).format(form).load(path).withColumn("kind", F.lit(kind))
        out = got if out is None else out.unionByName(got)
    return out


_TRIALS = "tr AS (SELECT c_custkey::INTEGER AS trial, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 4 END::DOUBLE AS components, (c_custkey % 31)::DOUBLE AS degree, (c_custkey % 20) / 100.0::DOUBLE AS null_pass, (c_custkey % 9) / 10.0::DOUBLE - 0.5 AS spearman, (c_custkey % 5) / 20.0::DOUBLE AS gate_big, 0.95::DOUBLE + (c_custkey % 6) / 100.0::DOUBLE AS gate_corr, (c_custkey % 8) / 10.0::DOUBLE AS hill_above, CASE WHEN c_custkey % 11 = 0 THEN 'NaN'::DOUBLE ELSE (c_custkey % 10) / 10.0::DOUBLE END AS keep_rate, (c_custkey % 3) / 2.0::DOUBLE AS nonzero FROM customer)"
_PENALTY = """CASE WHEN components IS NULL THEN 0 ELSE 5 * greatest(components - 1, 0) END + (greatest(12 - degree, 0) + greatest(degree - 22, 0)) / 5 + abs(null_pass - 0.05) / 0.05 + 6 * greatest(spearman + 0.2, 0)
    + abs(gate_big - 0.1) / 0.1 + CASE WHEN gate_big = 0 THEN 0.5 ELSE 0 END + 2 * greatest(0.98 - gate_corr, 0) + abs(hill_above - 0.2) / 0.2 + CASE WHEN isnan(keep_rate) THEN 0 ELSE abs(keep_rate - 0.3) / 0.3 END + 0.5 * abs(nonzero - 0.5)"""


def _trials(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    part = lambda m, by: (k % m) / dbl(by)
    return A.table(spark, sf_dir, "customer").select(
        k.cast("int").alias("trial"), F.when(k % 7 != 0, (k % 4).cast("double")).alias("components"), (k % 31).cast("double").alias("degree"), part(20, 100).alias("null_pass"), (part(9, 10) - 0.5).alias("spearman"), part(5, 20).alias("gate_big"),
        (dbl(0.95) + part(6, 100)).alias("gate_corr"), part(8, 10).alias("hill_above"), F.when(k % 11 == 0, dbl(float("nan"))).otherwise(part(10, 10)).alias("keep_rate"), part(3, 2).alias("nonzero"),
    )


@query(f"{_TRIALS}, out AS (SELECT trial, {_PENALTY} AS penalty FROM tr)", "penalty", "trial")
def trial_penalty(spark, sf_dir):
    return tuning.penalised(_trials(spark, sf_dir)).select("trial", "penalty")


@query(f"{_TRIALS}, p AS (SELECT trial, round({_PENALTY}, 9) AS penalty FROM tr), b AS (SELECT * FROM p ORDER BY penalty, trial LIMIT 1), out AS (SELECT 'trials' AS kind, * FROM p UNION ALL SELECT 'best', * FROM b)", "penalty", "kind trial")
def sink_trials(spark, sf_dir):
    """All trials as CSV and the best one as JSON, read back."""
    path = fresh_path(spark, "trials")
    rows = tuning.penalised(_trials(spark, sf_dir)).select("trial", F.round("penalty", 9).alias("penalty")).orderBy("penalty", "trial")
    tables.save_trials(rows, path)
    schema = "trial int, penalty double"
    both = spark.read.schema(schema).option("header", True).csv(f"{path}/trials").withColumn("kind", F.lit("trials"))
    return both.unionByName(spark.read.schema(schema).json(f"{path}/best").withColumn("kind", F.lit("best")))


_TURNED = "exp(-0.5 * (power((x2 - x1) * cos(theta) + (y2 - y1) * sin(theta), 2) / 1.0 + power((y2 - y1) * cos(theta) - (x2 - x1) * sin(theta), 2) / greatest(1 / a, 0.68 * 0.68::DOUBLE)) / (h * h))"
_SOME = lambda c, name: f"SELECT unnest(['{name}_min', '{name}_med', '{name}_p90', '{name}_max']) AS item, unnest([min({c})::DOUBLE, quantile_cont({c}, 0.5), quantile_cont({c}, 0.9), max({c})::DOUBLE]) AS v FROM w5"


@query(
    f"""{HALFDISK}, w2 AS (SELECT fe.*, n, ev + 0.5 * ed AS sx, eh + 0.5 * ed AS sy FROM fe LEFT JOIN hd USING (src, dst)), w3 AS (SELECT *, coalesce(abs(sx - sy) / (sx + sy + 1e-12), 0) AS ratio FROM w2),
    w4 AS (SELECT *, CASE WHEN n IS NULL OR 1 + 2 * ratio < 1.05 THEN 1 ELSE least(1 + 2 * ratio, 3) END AS a, CASE WHEN n IS NULL OR sx >= sy THEN 0 ELSE pi() / 2 END AS theta FROM w3), w5 AS MATERIALIZED (SELECT *, {_TURNED} AS k FROM w4, h),
    out AS ({_SOME("a", "a")} UNION ALL {_SOME("ratio", "r")} UNION ALL {_SOME("k", "kernel")} UNION ALL SELECT unnest(['frac_isotropic', 'frac_near_cap', 'any_nan', 'any_nan_a', 'any_nan_r', 'k_within_0_1']),
        unnest([avg((abs(a - 1) < 1e-6)::INTEGER), avg((a > 3 - 1e-6)::INTEGER), max(isnan(k)::INTEGER), max(isnan(a::DOUBLE)::INTEGER), max(isnan(ratio)::INTEGER), min((k BETWEEN 0 AND 1)::INTEGER)]) FROM w5)""",
    "v",
    "item",
)
def kernel_report(spark, sf_dir):
    """The figures of an anisotropic kernel in the graph report: stretch, ratio and kernel values, shares of isotropic edges and of edges at the cap."""
    e, px, h = _frame(spark, sf_dir)
    own = materialise(kernels.wv2_kernel(e, px, h), "kernel")
    p = points(spark, sf_dir).select("id", (F.col("x") * dbl(0.275)).alias("x"), (F.col("y") * dbl(3.0)).alias("y"))
    rows = graphs.report(materialise(p, "pixel-points"), own, h, 2.2 * h)
    return rows.where("item rlike '^(a|r|kernel)_(min|med|p90|max)$' or item in ('frac_isotropic', 'frac_near_cap', 'any_nan', 'any_nan_a', 'any_nan_r', 'k_within_0_1')")


_DISK = "(SELECT dx, dy FROM range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE dx * dx + dy * dy <= 4)"


@query(f"{FRAME}, mk AS (SELECT y, x FROM pixels WHERE v > 2000), sp AS (SELECT DISTINCT round_even(y, 0)::INTEGER AS y, round_even(x, 0)::INTEGER AS x FROM fp), ls AS (SELECT * FROM sp WHERE (y, x) NOT IN (SELECT (y, x) FROM mk)), out AS (SELECT y, x FROM mk UNION SELECT (y + dy)::INTEGER, (x + dx)::INTEGER FROM ls, {_DISK} WHERE x + dx BETWEEN 0 AND 11 AND y + dy BETWEEN 0 AND (SELECT max(y) FROM pixels))", "", "y x")
def mask_rescue(spark, sf_dir):
    """A mask and a disk around each spot that it misses."""
    px = A.pixels(spark, sf_dir)
    p = points(spark, sf_dir).select("id", (F.col("x") * dbl(0.275)).alias("x"), (F.col("y") * dbl(3.0)).alias("y"))
    return raster.rescue(materialise(px.where("v > 2000").select("y", "x"), "mask"), p, 2 / 0.6, 12, height(px))


@query(f"{A.PIXELS_SQL}, mk AS (SELECT y, x FROM pixels WHERE v > 2000), out AS (SELECT y, x, v, row_number() OVER (ORDER BY y, x) - 1 AS ord FROM pixels JOIN mk USING (y, x))", "v", "ord y x")
def mask_flatten(spark, sf_dir):
    px = materialise(A.pixels(spark, sf_dir), "pixels")
    return raster.flatten(px, px.where("v > 2000").select("y", "x"))


@query(f"{A.PIXELS_SQL}, mk AS (SELECT y, x FROM pixels WHERE v > 2000), out AS (SELECT DISTINCT (y + dy)::INTEGER AS y, (x + dx)::INTEGER AS x FROM mk, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) t(dy, dx) WHERE x + dx BETWEEN 0 AND 11 AND y + dy BETWEEN 0 AND (SELECT max(y) FROM pixels) AND (y + dy, x + dx) NOT IN (SELECT (y, x) FROM mk))", "", "y x")
def mask_boundary(spark, sf_dir):
    px = materialise(A.pixels(spark, sf_dir), "pixels")
    return raster.boundary(px.where("v > 2000").select("y", "x"), 12, height(px))


@query("p AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 997 + 1)::DOUBLE / 1000 AS p FROM customer), r AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS n FROM p), out AS (SELECT id, p, least(min(p * n / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS padj FROM r)", "p padj", "id")
def bh_fdr_all(spark, sf_dir):
    """False discovery rates over one family of tests as large as the table, in blocks."""
    from tessera.operators import stats

    k = F.col("c_custkey")
    return stats.bh(A.table(spark, sf_dir, "customer").select(k.alias("id"), (((k * 7919) % 997 + 1).cast("double") / 1000).alias("p")), "p", block=512)


@query(f"{S}, {A.PIXELS_SQL}, lo AS (SELECT spot_id, label12 AS truth FROM spots WHERE spot_id % 3 <> 0), out AS (SELECT spot_id AS id, coalesce(truth, -1)::INTEGER AS truth FROM spots LEFT JOIN lo USING (spot_id))", "", "id truth")
def truth_lookup(spark, sf_dir):
    """The known label of each spot, -1 where none is known."""
    from tessera.operators import clustering

    p = A.spots(spark, sf_dir)
    return clustering.with_truth(p.select(F.col("spot_id").alias("id")), p.where("spot_id % 3 <> 0").select(F.col("spot_id").alias("id"), F.col("label12").alias("truth")))


# --- numpy files


def _saved(df: DataFrame, order: str | list[str], name: str) -> str:
    """The path of a table's other columns saved as an array, rows in order."""
    path = fresh_path(df.sparkSession, name)
    arrays.save(df.orderBy(order).drop("_order"), path)
    return path


@query(f"{S}, out AS (SELECT spot_id, x, y FROM spots)", "x y", "spot_id")
def source_npy_coords(spark, sf_dir):
    """The last two columns of an array of three."""
    return arrays.coords(spark, _saved(_spots(spark, sf_dir).select(F.col("label12").cast("double").alias("z"), "x", "y", "_order"), "_order", "coords.npy"))


@query(f"{A.EXPR_SQL}, g AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS i FROM (SELECT DISTINCT gene FROM expr)), out AS (SELECT a.i, b.i AS j, sum(x.value * y.value) AS w FROM expr x JOIN expr y USING (spot_id) JOIN g a ON a.gene = x.gene JOIN g b ON b.gene = y.gene WHERE (a.i + b.i) % 3 <> 0 GROUP BY ALL)", "w", "i j")
def source_npy_matrix(spark, sf_dir):
    """What genes have in common, as a square array; cells that are 0 aren't read."""
    ex = materialise(A.expr(spark, sf_dir), "expr")
    both = ex.join(ex.select("spot_id", F.col("gene").alias("other"), F.col("value").alias("with")), "spot_id").groupBy("gene", "other").agg(F.sum(F.col("value") * F.col("with")).alias("w"))
    rows = both.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("other", "w"))).alias("s")).select("gene", F.transform("s", lambda x: x["w"]).alias("f"))
    rows = numbered(rows, "gene").select("_order", F.transform("f", lambda w, j: F.when((F.col("_order") + j) % 3 == 0, dbl(0)).otherwise(w)).alias("f"))
    return arrays.matrix(spark, _saved(rows, "_order", "matrix.npy"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    from tessera.plans.numbering import number_rows

    return number_rows(df, "_order", [order])


@query(f"{KERNEL}, out AS (SELECT src, dst, d, k, h FROM ke, h)", "d k h", "src dst")
def source_npy_kernel(spark, sf_dir):
    """Edges, kernel, lengths and spacing as arrays of one bundle, joined by place."""
    _, g, h = bounded(spark, sf_dir)
    edges, folder = materialise(kernels.iso(g, h), "kernel"), fresh_path(spark, "kernel")
    for name, cols in (("edges", ["src", "dst"]), ("kernel", ["k"]), ("d", ["d"])):
        arrays.save(edges.orderBy("src", "dst").select(*cols), f"{folder}/{name}")
    arrays.save(spark.range(1).select(dbl(h).alias("h")), f"{folder}/h")
    found, meta = arrays.kernel(spark, folder)
    return found.withColumn("h", dbl(meta["h"]))


@query(f"{A.HIST_SQL}, out AS (SELECT spot_id, pos - 1 AS pos, f[pos] AS v FROM (SELECT spot_id, f, unnest(range(1, len(f) + 1)) AS pos FROM hist))", "v", "spot_id pos")
def source_npy_features(spark, sf_dir):
    rows = A.hist(spark, sf_dir).select(F.col("spot_id").alias("_order"), "f")
    return arrays.features(spark, _saved(rows, "_order", "features.npy")).select("spot_id", F.posexplode("f").alias("pos", "v"))


def _lines(spark, sf_dir) -> DataFrame:
    """A row of pixels each: _order, and v by x."""
    own = A.pixels(spark, sf_dir).groupBy(F.col("y").alias("_order")).agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("s"))
    return own.select("_order", F.transform("s", lambda p: p["v"]).alias("f"))


@query(f"{A.PIXELS_SQL}, out AS (SELECT y, x, v FROM pixels)", "v", "y x")
def source_npy_raster(spark, sf_dir):
    return arrays.raster(spark, _saved(_lines(spark, sf_dir), "_order", "raster.npy"))


@query(f"{A.PIXELS_SQL}, out AS (SELECT y, x FROM pixels WHERE v > 2000)", "", "y x")
def source_npy_mask(spark, sf_dir):
    """The first file in a folder whose name is that of a mask."""
    folder, lines = fresh_path(spark, "masks"), _lines(spark, sf_dir)
    for name, least in (("tissue_mask.npy", 0), ("mask_a.npy", 2000)):
        arrays.save(lines.orderBy("_order").select(F.transform("f", lambda v: v > least).alias("f")), f"{folder}/{name}")
    return arrays.mask_auto(spark, folder)


@query(f"{A.PIXELS_SQL}, out AS (SELECT level::INTEGER AS level, band::INTEGER AS band, theta::DOUBLE AS theta, kappa::DOUBLE AS kappa, y, x, v * f AS v FROM pixels, (VALUES (1, 0, 0.0, 0.5, 2), (1, 1, 1.5, 0.25, 3), (2, 0, 0.0, 0.5, 4), (2, 1, 1.5, 0.25, 5)) t(level, band, theta, kappa, f))", "theta kappa v", "level band y x")
def source_npy_bands(spark, sf_dir):
    """High-pass bands of two levels by name, with the angles and weights that a bundle beside them holds."""
    folder, lines = fresh_path(spark, "bands"), materialise(_lines(spark, sf_dir), "lines")
    for name, f in (("L1_B01_a", 2), ("L1_B10_a", 3), ("L1_B00_a", 9), ("L2_B01_a", 4), ("L2_B11_a", 5)):
        arrays.save(lines.orderBy("_order").select(F.transform("f", lambda v: v * f).alias("f")), f"{folder}/{name}.npy")
    arrays.save(spark.range(3).select(dbl(1).alias("k")), f"{folder}/a.npz/kernel")
    for name, first, second in (("theta", 0.0, 1.5), ("kappa", 0.5, 0.25)):
        arrays.save(spark.range(0, 2, 1, 1).select(F.when(F.col("id") == 0, dbl(first)).otherwise(dbl(second)).alias("v")), f"{folder}/b.npz/{name}")
    return arrays.bands_with_angles(spark, folder)


@query(f"{A.PIXELS_SQL}, out AS (SELECT y, x, v, v * 2 AS w FROM pixels WHERE v > 2000)", "v w", "y x")
def source_npy_tensor(spark, sf_dir):
    """An array of three axes inside a mask, once its size is found to be the mask's."""
    rows = _lines(spark, sf_dir).select("_order", F.transform("f", lambda v: F.array(v, v * 2)).alias("f"))
    px = materialise(A.pixels(spark, sf_dir), "pixels")
    own = arrays.masked_tensor(spark, _saved(rows, "_order", "tensor.npy"), px.where("v > 2000").select("y", "x"), (height(px), 12))
    return own.select("y", "x", F.col("f")[0].alias("v"), F.col("f")[1].alias("w"))
