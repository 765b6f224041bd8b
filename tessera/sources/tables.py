"""Readers and writers of tissue inputs: coordinates, labels, expression, interactions, rasters, bands.

Headers are matched without regard to case or outer spaces.  Paths go through
Spark, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tessera.functions.columns import gene_name
from tessera.operators import interactions
from tessera.plans.numbering import number_rows

# Headers that name coordinates, labels and spots.
X_NAMES = ["x", "x_px", "coord_x", "pos_x", "xc", "col", "imagecol", "x_um", "xpix", "x_pixel"]
Y_NAMES = ["y", "y_px", "coord_y", "pos_y", "yc", "row", "imagerow", "y_um", "ypix", "y_pixel"]
LABEL_NAMES = ["macro", "class", "label", "z", "z_i", "macro_niche", "niche"]
SPOT_NAMES = ["barcode", "spot", "spot_id", "id"]


def csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.toDF(*(c.strip() for c in df.columns))


def find(df: DataFrame, names: list[str]) -> str | None:
    """The first column called by one of the names."""
    low = {c.strip().lower(): c for c in reversed(df.columns)}
    return next((low[n] for n in names if n in low), None)


def numeric(c: str) -> Column:
    """A number, or null where it isn't one."""
    v = F.expr(f"try_cast(`{c}` as double)")
    return F.when(F.isnan(v), None).otherwise(v)


def numeric_columns(df: DataFrame, whole: bool = True) -> list[str]:
    """Columns whose every filled value (or any, if not whole) is a number."""
    texts = [f.name for f in df.schema if not isinstance(f.dataType, NumericType)]
    if not texts:
        return df.columns
    r = df.agg(*(x for c in texts for x in (F.count(F.expr(f"try_cast(`{c}` as double)")).alias(f"{c}|n"), F.count(c).alias(f"{c}|a")))).first()
    return [c for c in df.columns if c not in texts or (r[f"{c}|n"] == r[f"{c}|a"] if whole else 0 < r[f"{c}|n"]) and r[f"{c}|n"]]


def numbered(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """df with spot_id 0..N-1, by the given columns or by place in the file."""
    return number_rows(df, "spot_id", order)


def coords_strict(spark: SparkSession, path: str) -> DataFrame:
    """(spot_id, barcode, x, y, xy_key) of a file whose first headers are barcode, x, y."""
    df = csv(spark, path)
    if [c.lower() for c in df.columns[:3]] != ["barcode", "x", "y"]:
        raise ValueError(f"expected barcode, x, y first; got {df.columns[:3]}")
    b, x, y = df.columns[:3]
    out = numbered(df.select(F.col(b).alias("barcode"), numeric(x).alias("x"), numeric(y).alias("y")))
    return out.select("spot_id", "barcode", "x", "y", xy_key(F.col("x"), F.col("y")).alias("xy_key"))


def xy_key(x: Column, y: Column) -> Column:
    """Rounded coordinates joined by an underscore; half goes to even."""
    return F.concat_ws("_", F.rint(x).cast("bigint").cast("string"), F.rint(y).cast("bigint").cast("string"))


def coords_named(spark: SparkSession, path: str) -> DataFrame:
    df = csv(spark, path)
    names = [find(df, [n]) for n in ("barcode", "x", "y")]
    if None in names:
        raise ValueError("barcode, x and y are needed")
    return numbered(df.select(F.col(names[0]).alias("barcode"), numeric(names[1]).alias("x"), numeric(names[2]).alias("y"))).select("spot_id", "barcode", "x", "y")


def coords_any(df: DataFrame, fallback: str = "last") -> DataFrame:
    """(spot_id, x, y) by the usual names, else the last (or first) two numeric columns."""
    x, y = find(df, X_NAMES), find(df, Y_NAMES)
    if not (x and y):
        nums = numeric_columns(df)
        if len(nums) < 2:
            raise ValueError("no two numeric columns")
        x, y = nums[-2:] if fallback == "last" else nums[:2]
    return numbered(df.select(numeric(x).alias("x"), numeric(y).alias("y"))).select("spot_id", "x", "y")


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, sorted."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(s.getPath().toString() for s in (found or []))


def coords_auto(spark: SparkSession, folder: str, override: str | None = None) -> DataFrame:
    """The first file called coords* or coordinates* that can be read."""
    errors = []
    for path in [override] if override else [p for kind in ("parquet", "csv") for name in ("coords", "coordinates") for p in listed(spark, f"{folder}/{name}*.{kind}")]:
        try:
            return coords_any(spark.read.parquet(path) if path.endswith(".parquet") else csv(spark, path))
        except Exception as e:  # noqa: BLE001  the next one may do
            errors.append(str(e)[:80])
    raise FileNotFoundError(f"no coordinates in {folder}: {errors}")


def labels(df: DataFrame) -> DataFrame:
    """(spot_id, label) by the usual names, else the first numeric column."""
    c = find(df, LABEL_NAMES) or next(iter(numeric_columns(df)), None)
    if c is None:
        raise ValueError("no label column")
    return numbered(df.select(F.col(c).alias("label"))).select("spot_id", "label")


def labelled_coords(df: DataFrame) -> DataFrame:
    """(spot, x, y, label): x and y by name else the second and third column, the spot by name else the fourth."""
    x, y, s = find(df, ["x"]) or df.columns[1], find(df, ["y"]) or df.columns[2], find(df, SPOT_NAMES[:2]) or df.columns[3]
    lab = find(df, LABEL_NAMES) or df.columns[-1]
    return df.select(F.trim(F.col(s).cast("string")).alias("spot"), numeric(x).alias("x"), numeric(y).alias("y"), F.col(lab).alias("label"))


def micro(df: DataFrame) -> DataFrame:
    """(spot, macro, micro_id, micro_name); the name defaults to the id."""
    need = {n: find(df, [n]) for n in ("spot", "macro", "micro_id")}
    if missing := [k for k, v in need.items() if v is None]:
        raise ValueError(f"missing columns: {missing}")
    name = find(df, ["micro_name"])
    ident = F.col(need["micro_id"]).cast("int")
    return df.select(F.col(need["spot"]).cast("string").alias("spot"), F.col(need["macro"]).cast("string").alias("macro"), ident.alias("micro_id"), (F.coalesce(F.col(name), ident.cast("string")) if name else ident.cast("string")).alias("micro_name"))


def macro(df: DataFrame, column: str, spot: str) -> DataFrame:
    return df.select(F.col(spot).cast("string").alias("spot"), F.col(column).cast("string").alias("macro"))


def is_genes_by_spots(df: DataFrame) -> bool:
    """Whether the first column is text and at least five, and half, of the others are numbers."""
    nums = set(numeric_columns(df))
    rest = df.columns[1:]
    return df.columns[0] not in nums and sum(c in nums for c in rest) >= max(5, 0.5 * len(rest))


def expr_long(df: DataFrame, layout: str = "auto", log1p: bool = False) -> DataFrame:
    """(spot, gene, value) from a wide table; layout: genes_by_spots, spots_by_genes, or auto."""
    if layout == "auto":
        layout = "genes_by_spots" if is_genes_by_spots(df) else "spots_by_genes"
    first, rest = df.columns[0], df.columns[1:]
    if layout == "spots_by_genes":
        nums = set(numeric_columns(df))
        rest = [c for c in rest if c in nums]
    cells = df.select(F.col(first).cast("string").alias("_k"), *(numeric(c).alias(c) for c in rest)).unpivot("_k", rest, "_c", "value")
    a, b = ("gene", "spot") if layout == "genes_by_spots" else ("spot", "gene")
    out = cells.select(F.col("_k").alias(a), F.col("_c").alias(b), "value")
    if layout == "genes_by_spots":  # genes and spots without any value go
        out = out.where("value is not null")
    return out.withColumn("value", F.log1p("value")) if log1p else out


def aligned_expr(long: DataFrame, spots: DataFrame) -> DataFrame:
    """(spot_id, gene, value): for every spot and gene, the largest of repeated genes; missing ones are 0."""
    own = long.groupBy("spot", "gene").agg(F.max(F.coalesce("value", F.lit(0.0))).alias("value"))
    genes = own.select("gene").distinct()
    grid = spots.select("spot_id", "barcode").join(genes)
    return grid.join(own, (F.col("barcode") == F.col("spot")) & (grid["gene"] == own["gene"]), "left").select("spot_id", grid["gene"], F.coalesce("value", F.lit(0.0)).alias("value"))


def gene_set(df: DataFrame) -> DataFrame:
    return df.select(gene_name(df.columns[0]).alias("gene")).where("gene <> ''").distinct()


def lr_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Pairs of all files, numbered by their own columns, so that files and their order don't matter."""
    return number_rows(interactions.union([csv(spark, p) for p in paths]), "pair_id", ["ligand", "receptor", "pathway", "ligand_annotation"])


def lr_database(df: DataFrame) -> DataFrame:
    """(ligand, receptor, pathway, ligand_annotation, tf) by name, else the last five columns."""
    want = ["ligand", "receptor", "pathway", "ligand_annotation", "tf"]
    found = [find(df, [w]) for w in want]
    cols = found if None not in found else df.columns[-5:]
    if len(cols) < 5:
        raise ValueError("five columns are needed")
    return interactions.clean(df.select(*(F.col(c).alias(w) for c, w in zip(cols, want, strict=True))))


def tf_activity(df: DataFrame, spots: DataFrame) -> DataFrame:
    """(spot_id, tf, value) from a wide table keyed by rounded coordinates; absent spots have no rows."""
    key, nums = df.columns[0], [c for c in numeric_columns(df) if c != df.columns[0]]
    long = df.select(F.col(key).cast("string").alias("k"), *(numeric(c).alias(c) for c in nums)).unpivot("k", nums, "tf", "value")
    return spots.select("spot_id", xy_key(F.col("x"), F.col("y")).alias("k")).join(long, "k").select("spot_id", "tf", F.coalesce("value", F.lit(0.0)).alias("value"))


def raster(df: DataFrame) -> DataFrame:
    """(y, x, v) from a wide table whose first column is the row index; a single value column of s*s rows is folded to s by s."""
    rest = df.columns[1:]
    if len(rest) == 1:
        n = df.count()
        side = round(n**0.5)
        if side * side != n:
            raise ValueError("a single column must hold a square number of rows")
        own = numbered(df.select(numeric(rest[0]).alias("v")))
        return own.select(F.floor(F.col("spot_id") / side).cast("int").alias("y"), (F.col("spot_id") % side).cast("int").alias("x"), "v")
    own = numbered(df.select(*(numeric(c).alias(str(i)) for i, c in enumerate(rest)))).withColumn("y", F.col("spot_id").cast("int"))
    return own.unpivot("y", [str(i) for i in range(len(rest))], "x", "v").select("y", F.col("x").cast("int").alias("x"), "v")


def image(spark: SparkSession, path: str) -> DataFrame:
    """(y, x, c, v) of images that Spark's own image reader decodes; channels in the order red, green, blue."""
    im = spark.read.format("image").load(path).select("image.*")
    px = im.select("height", "width", "nChannels", "data").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") * F.col("nChannels") - 1)))
    v = F.conv(F.hex(F.substring(F.col("data"), F.col("i") + 1, F.lit(1))), 16, 10).cast("double")
    c = F.col("nChannels") - 1 - F.col("i") % F.col("nChannels")
    at = F.floor(F.col("i") / F.col("nChannels"))
    return px.select(F.floor(at / F.col("width")).cast("int").alias("y"), (at % F.col("width")).cast("int").alias("x"), c.alias("c"), v.alias("v"))


def bands(spark: SparkSession, pattern: str) -> DataFrame:
    """Subbands in Parquet files L{level}_B{bi}{bj}*, with level, bi and bj from their names; of a band found twice the first file counts."""
    name = r"L(\d+)_B(\d)(\d)"
    df = spark.read.parquet(pattern).withColumn("_f", F.regexp_extract(F.col("_metadata.file_path"), rf"^(.*/[^/]*{name}[^/]*)", 1))
    own = df.where(F.col("_f") != "").select("*", *(F.regexp_extract("_f", name, i).cast("int").alias(n) for i, n in ((1, "level"), (2, "bi"), (3, "bj"))))
    first = own.groupBy("level", "bi", "bj").agg(F.min("_f").alias("_f"))
    return own.join(first, ["level", "bi", "bj", "_f"], "left_semi").drop("_f")


def angles(spark: SparkSession, pattern: str) -> DataFrame:
    """Complex subbands in Parquet files L{level}_ang{angle}*: (level, angle, ...), only angles that every level has."""
    df = spark.read.parquet(pattern).withColumn("_f", F.col("_metadata.file_path"))
    own = df.select("*", F.regexp_extract("_f", r"L(\d+)_", 1).cast("int").alias("level"), F.regexp_extract("_f", r"ang(-?\d+)", 1).cast("int").alias("angle")).drop("_f")
    n = own.select("level").distinct().count()
    full = own.groupBy("angle").agg(F.countDistinct("level").alias("n")).where(F.col("n") == n).select("angle")
    return own.join(full, "angle", "left_semi")


def equal_sizes(pixels: DataFrame, key: str) -> None:
    """An error unless every raster has the same height and width."""
    sizes = pixels.groupBy(key).agg(F.max("y").alias("h"), F.max("x").alias("w")).select("h", "w").distinct().limit(2).count()
    if sizes > 1:
        raise ValueError("rasters differ in size")


def with_second_level(own: DataFrame) -> DataFrame:
    """Bands of levels 1 and 2; a missing level-2 band is its level-1 band."""
    two = own.where("level = 2")
    lost = own.where("level = 1").join(two.select("bi", "bj").distinct(), ["bi", "bj"], "left_anti").withColumn("level", F.lit(2))
    return own.where("level in (1, 2)").unionByName(lost)


def coverage(expr: DataFrame, macro_rows: DataFrame, least: float = 0.9) -> DataFrame:
    """macro rows of the expression's spots; an error if too few of them, or not all, have one."""
    ids = expr.select("spot").distinct()
    both = ids.join(macro_rows, "spot", "left")
    n, met = both.agg(F.count("*"), F.count("macro")).first()
    if not met:
        raise ValueError("no spot in common")
    if met / n < least or met < n:
        raise ValueError(f"{n - met} of {n} spots have no macro zone")
    return both


def save(df: DataFrame, path: str, kind: str = "parquet", by: list[str] = (), mode: str = "errorifexists") -> None:
    """Write as parquet, csv, json or orc, perhaps one folder for each value of some columns."""
    w = df.write.mode(mode)
    w = w.partitionBy(*by) if by else w
    (w.option("header", True) if kind == "csv" else w).format(kind).save(path)


def save_kernel(edges: DataFrame, meta: dict, path: str) -> None:
    """A kernel bundle: edges, and one row of parameters."""
    edges.write.parquet(f"{path}/edges")
    edges.sparkSession.createDataFrame([tuple(str(v) for v in meta.values())], list(meta)).write.parquet(f"{path}/meta")


def load_kernel(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/meta").first().asDict()


def save_trials(trials: DataFrame, path: str) -> None:
    """All trials as CSV, and the best one as JSON beside them."""
    save(trials, f"{path}/trials", "csv")
    save(trials.limit(1), f"{path}/best", "json")
