"""Registered queries of refinement, resampling, alignment and the scalar rules that others only use inside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import adapters as A
from tessera.functions import columns as C
from tessera.functions.columns import dbl
from tessera.operators import graphs, kernels, models, raster, spatial, zones
from tessera.plans.workspace import materialise
from tessera.queries import _CC, DEG_MAX, EDGES, KERNEL, LAB, NN, S, _labelled, bounded, height, points, query

CELLS, WIDE, HIGH = 20, 60, 50

# --- refinement

_REFINE = f"""{KERNEL}, ch AS (SELECT quantile_cont(d, 0.5) AS c FROM (SELECT src, any_value(la) AS label, min(d) AS d FROM pairs WHERE la = lb GROUP BY 1) GROUP BY label), hh AS (SELECT quantile_cont(c, 0.5) AS hh FROM ch),
    r AS (SELECT d / hh AS r, row_number() OVER (ORDER BY d) AS rn FROM nn, hh WHERE rk BETWEEN 8 AND 12), e AS (SELECT min(r) AS lo, max(r) AS hi, count(*) AS n FROM r),
    o AS (SELECT r, rn, abs((r - lo) / greatest(hi - lo, 1e-12) - (rn - 1)::DOUBLE / (n - 1)) AS off FROM r, e),
    a0 AS (SELECT coalesce(CASE WHEN n >= 10 AND b.r BETWEEN 1.2 AND 3.5 THEN b.r END, 2.3)::DOUBLE AS a0 FROM (SELECT r FROM o ORDER BY off DESC, rn LIMIT 1) b, e),
    dl AS MATERIALIZED (SELECT list(d) AS ds, (SELECT count(*) FROM spots)::DOUBLE AS n FROM pairs, hh WHERE d <= 4.0 * hh),
    st AS (SELECT 1 AS turn, a0 AS alpha, 0.9::DOUBLE AS low, 4.0::DOUBLE AS high, len(list_filter(ds, lambda x: x <= a0 * hh)) / n AS degree FROM a0, dl, hh
        UNION ALL SELECT turn + 1, next, nlow, nhigh, len(list_filter(ds, lambda x: x <= next * hh)) / n
        FROM (SELECT *, CASE WHEN degree = 0 THEN least(greatest(1.25 * alpha, alpha + 0.1), 4) ELSE (nlow + nhigh) / 2 END AS next
            FROM (SELECT *, CASE WHEN degree > 22 THEN low ELSE alpha END AS nlow, CASE WHEN degree > 22 THEN alpha ELSE high END AS nhigh FROM st WHERE turn < 12 AND NOT degree BETWEEN 12 AND 22)), dl, hh),
    tuned AS (SELECT * FROM st ORDER BY turn DESC LIMIT 1)"""


@query(f"{_REFINE}, out AS (SELECT hh AS h, a0 AS alpha0, alpha, degree, 1.0::DOUBLE AS lcc FROM tuned, hh, a0)", "h alpha0 alpha degree lcc")
def graph_tuned_alpha(spark, sf_dir):
    """Spacing by class, radius from the knee, and the radius after bisection; these spots hold together at such degrees."""
    found = _refine(spark, sf_dir)["meta"]
    return spark.createDataFrame([tuple(map(float, found.values()))], "h double, alpha0 double, alpha double, degree double, lcc double")


def _refine(spark, sf_dir) -> dict:
    p, g, h = bounded(spark, sf_dir)
    from tessera.operators import scoring

    scores = materialise(scoring.normalise_k(kernels.iso(g, h)).select("src", "dst", F.col("k").alias("w")), "scores")
    return graphs.refine(p, "label12", scores)


@query(f"{_REFINE}, w AS MATERIALIZED (SELECT p.src, p.dst, coalesce(k, 0) AS w FROM (SELECT src, dst FROM pairs, tuned, hh WHERE d <= alpha * hh) p LEFT JOIN kn ON kn.src = p.src AND kn.dst = p.dst), t AS (SELECT quantile_cont(w, 0.5) AS q, max(w) AS top FROM w), kept AS (SELECT src, dst, w FROM w, t WHERE w >= CASE WHEN q <= 1e-12 AND top > 1e-12 THEN 1e-12 ELSE q END), out AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, 0.5 * sum(w) AS s FROM kept GROUP BY ALL)", "s", "u v")
def graph_refined(spark, sf_dir):
    """The tuned graph, pruned by scores and summed over both directions."""
    return _refine(spark, sf_dir)["undirected"]


# --- resampling

_BOUNDS = f"{S}, b AS (SELECT min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1 FROM spots)"
_PLACED = lambda f: f"SELECT spot_id, trunc({CELLS}::DOUBLE * (y - y0) / ({f}::DOUBLE * (y1 - y0)))::INTEGER AS i, trunc({CELLS}::DOUBLE * (x - x0) / ({f}::DOUBLE * (x1 - x0)))::INTEGER AS j, trunc((y - y0) / (y1 - y0) * {HIGH - 1})::INTEGER AS y, trunc((x - x0) / (x1 - x0) * {WIDE - 1})::INTEGER AS x FROM spots, b"


@query(f"{_BOUNDS}, {A.EXPR_SQL}, pl AS ({_PLACED(1)}), c AS (SELECT i, j, count(*) AS n FROM pl GROUP BY ALL), m AS (SELECT gene, i, j, sum(value) / any_value(n) AS v FROM pl JOIN expr USING (spot_id) JOIN c USING (i, j) GROUP BY ALL), out AS (SELECT gene, y, x, arg_max(v, spot_id) AS v FROM pl JOIN m USING (i, j) GROUP BY ALL)", "v", "gene y x")
def upsampled(spark, sf_dir):
    """Cell means of every gene written back to the pixels of the spots."""
    p, ex = points(spark, sf_dir), materialise(A.expr(spark, sf_dir), "expr")
    grid, b = materialise(raster.cell_means(p, ex, CELLS), "grid"), raster.bounds(p)
    genes = [r.gene for r in grid.select("gene").distinct().collect()]  # some dozens
    return reduce(DataFrame.unionByName, (raster.upsample(p, grid.where(F.col("gene") == g).drop("gene"), b, CELLS, WIDE, HIGH).withColumn("gene", F.lit(g)) for g in genes))


_LEVELS = [(1, 0, 1, 2.0), (1, 1, 1, 3.0), (1, 0, 0, 9.0), (2, 1, 0, 4.0), (3, 0, 1, 5.0)]


@query(f"{_BOUNDS}, {A.PIXELS_SQL}, one AS ({_PLACED(2)}), two AS ({_PLACED(4)}), bd AS (SELECT * FROM (VALUES {', '.join(map(str, _LEVELS))}) t(level, bi, bj, f)), h AS (SELECT 1 AS level, * FROM one UNION ALL SELECT 2, * FROM two), out AS (SELECT 'L' || h.level || '_B' || bi || bj AS name, h.y, h.x, arg_max(v * f, spot_id) AS v FROM h JOIN bd ON bd.level = h.level AND bi + bj > 0 JOIN pixels p ON p.y = h.i AND p.x = h.j GROUP BY ALL)", "v", "name y x")
def resampled_bands(spark, sf_dir):
    px = materialise(A.pixels(spark, sf_dir), "pixels")
    bands = reduce(DataFrame.unionByName, (px.select(F.lit(lv).alias("level"), F.lit(i).alias("bi"), F.lit(j).alias("bj"), "y", "x", (F.col("v") * f).alias("v")) for lv, i, j, f in _LEVELS))
    return raster.resample_bands(points(spark, sf_dir), bands, CELLS, WIDE, HIGH)


@query(f"{_BOUNDS}, c AS (SELECT *, (x1 - x0) / {CELLS} AS w, (y1 - y0) / {CELLS} AS t FROM b), m AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM spots), out AS (SELECT spot_id AS id, trunc((s.y - y0) / (y1 - y0) * {HIGH - 1})::INTEGER AS py, trunc((s.x - x0) / (x1 - x0) * {WIDE - 1})::INTEGER AS px, w, t, (s.x - a) / (b - a) * 9 AS fx, (s.y - c) / (d - c) * 4 AS fy, (s.x - a) / (b - a) * 9 AS ux, (s.y - c) / (d - c) * 4 AS uy FROM spots s, c, m)", "w t fx fy ux uy", "id py px")
def pixel_coords(spark, sf_dir):
    """Pixels of spots, sizes of cells, and spots laid on a smaller image, also from shares of its sides."""
    p = points(spark, sf_dir)
    b = raster.bounds(p)
    w, t = raster.cell_size(b, CELLS)
    ends = p.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    shares = p.crossJoin(ends).select("id", ((F.col("x") - F.col("a")) / (F.col("b") - F.col("a"))).alias("x"), ((F.col("y") - F.col("c")) / (F.col("d") - F.col("c"))).alias("y"))
    fitted, unit = (raster.map_to_grid(x, 10, 5).select("id", F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")) for x, n in ((p, "f"), (shares, "u")))
    own = p.select("id", C.pixel_of(F.col("y"), dbl(b["y0"]), dbl(b["y1"]), HIGH).alias("py"), C.pixel_of(F.col("x"), dbl(b["x0"]), dbl(b["x1"]), WIDE).alias("px"), dbl(w).alias("w"), dbl(t).alias("t"))
    return own.join(fitted, "id").join(unit, "id")


@query(f"{S}, {A.PIXELS_SQL}, b AS (SELECT min(trunc(y * 0.2)) AS a, max(trunc(y * 0.2)) AS b, min(trunc(x * 0.2)) AS c, max(trunc(x * 0.2)) AS d FROM spots), out AS (SELECT y, x, v FROM pixels, b WHERE x BETWEEN a AND b.b AND y BETWEEN c AND d)", "v", "y x")
def cropped(spark, sf_dir):
    return raster.crop(A.pixels(spark, sf_dir), A.spots(spark, sf_dir), 0.2)


@query(f"{A.PIXELS_SQL}, k AS (SELECT y, x, c, v * (c + 1) AS v FROM pixels, range(0, 4) t(c)), t AS (SELECT max(v) AS top FROM k WHERE c < 3), n AS (SELECT y, x, c, least(greatest(CASE WHEN top > 1.5 THEN v / 255 ELSE v END, 0), 1) AS v FROM k, t WHERE c < 3), out AS (SELECT y, x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b, trunc(max(v) FILTER (c = 0) * 255)::INTEGER AS byte FROM n GROUP BY ALL)", "r g b", "y x byte")
def rgb_channels(spark, sf_dir):
    """Four channels to three in 0..1, laid side by side, put together again and split once more; and the first as bytes."""
    px = A.pixels(spark, sf_dir)
    four = px.withColumn("c", F.explode(F.array(*map(F.lit, range(4))))).withColumn("v", F.col("v") * (F.col("c") + 1))
    wide = raster.channels(raster.normalised_rgb(four), ["r", "g", "b"])
    again = raster.channels(raster.stack(wide, ["r", "g", "b"]), ["r", "g", "b"])
    return again.withColumn("byte", C.to_uint8(F.col("r"), True))


# --- alignment and labels


@query(f"{S}, l AS (SELECT spot_id AS ord, floor(x) AS x, (y + 0.03) * 1.154 AS y, label12 AS label FROM spots), p AS (SELECT spot_id AS ord, floor(x) AS x, y, barcode FROM spots), n AS (SELECT l.ord, any_value(l.x) AS x, any_value(l.label) AS label, arg_min(p.y, (abs(l.y / 1.154 - p.y), p.ord)) AS y FROM l JOIN p ON l.x = p.x GROUP BY 1), out AS (SELECT barcode, (label - 1)::INTEGER AS label FROM n JOIN p ON n.x = p.x AND n.y = p.y)", "", "barcode label")
def realigned_labels(spark, sf_dir):
    """Labels of a stretched picture moved to the nearest spot of their column."""
    p = A.spots(spark, sf_dir).select(F.col("spot_id").alias("ord"), F.floor("x").alias("x"), "y", "barcode", "label12")
    own = p.select("ord", "x", ((F.col("y") + dbl(0.03)) * dbl(1.154)).alias("y"), F.col("label12").alias("label"))
    return spatial.realign(own, p.select("ord", "x", "y", "barcode"))


@query(
    f"""{NN}, {LAB}, sl AS MATERIALIZED (SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rk FROM pairs JOIN lb p ON p.id = src JOIN lb q ON q.id = dst AND p.label = q.label WHERE ma = mb QUALIFY rk <= 8), e0 AS (SELECT src, dst FROM sl, h WHERE d <= 2.2 * h), e AS MATERIALIZED (SELECT * FROM e0 UNION SELECT dst, src FROM e0), nodes AS (SELECT spot_id FROM spots), {_CC},
    pt AS MATERIALIZED (SELECT id, min(other) AS part FROM reach GROUP BY 1), sm AS (SELECT id, part FROM pt WHERE part IN (SELECT part FROM pt GROUP BY 1 HAVING count(*) < 5)),
    vo AS (SELECT part, q.label, count(*) AS c FROM pairs JOIN h ON d <= 2.2 * h JOIN sm ON sm.id = src JOIN lb p ON p.id = src JOIN lb q ON q.id = dst AND p.label <> q.label WHERE ma = mb GROUP BY ALL),
    nw AS (SELECT part, first(label ORDER BY c DESC, label) AS label FROM vo GROUP BY 1), out AS (SELECT lb.id, coalesce(nw.label, lb.label)::INTEGER AS label FROM lb LEFT JOIN sm USING (id) LEFT JOIN nw USING (part))""",
    "",
    "id label",
)
def island_cleanup(spark, sf_dir):
    """Small islands take the commonest other label around them."""
    p = materialise(_labelled(spark, sf_dir), "labelled")
    return zones.clean_islands(p, "macro", "label", 2.2 * spatial.spacing(p)).select("id", F.col("label").cast("int").alias("label"))


@query(f"{S}, {A.HIST_SQL}, out AS (SELECT id, pos - 1 AS pos, f[pos] AS v FROM (SELECT id, f, unnest(range(1, len(f) + 1)) AS pos FROM (SELECT spot_id AS id, list_concat(list_transform(f, lambda v: v * 2), [x * 0.5, y * 0.5]) AS f FROM spots JOIN hist USING (spot_id))))", "v", "id pos")
def joint_features(spark, sf_dir):
    """Histology at twice its weight beside coordinates at half of theirs."""
    places = A.spots(spark, sf_dir).select(F.col("spot_id").alias("id"), F.array("x", "y").alias("f"))
    return models.joint_features([(A.hist(spark, sf_dir).withColumnRenamed("spot_id", "id"), 2.0), (places, 0.5)]).select("id", F.posexplode("f").alias("pos", "v"))


# --- rules on edges


@query(f"{EDGES}, r AS (SELECT src, dst, d, h, d * 1.5 AS k FROM g, h), out AS (SELECT policy, src, dst, r, c * r AS sigma FROM (SELECT src, dst, unnest(['fixed', 'edge', 'edge_clip', 'adaptive']) AS policy, unnest([1.2 * h, k, least(greatest(k, 0.5 * h), 1.6 * h), least(k, 3 * h)]) AS r, unnest([0.6 / 1.2, 0.4, 0.4, 0.4]) AS c FROM r))", "r sigma", "policy src dst")
def pool_policies(spark, sf_dir):
    """Radius and spread of the pixel pools of all edges under every policy."""
    _, g, h = bounded(spark, sf_dir)
    g = materialise(g, "edges")
    sizes = {p: C.pool_size(p, F.col("d"), dbl(h), r_rel=1.2, sigma_rel=0.6, k=1.5, c=0.4, r_min=0.5, r_max=1.6) for p in ("fixed", "edge", "edge_clip", "adaptive")}
    return reduce(DataFrame.unionByName, (g.select(F.lit(p).alias("policy"), "src", "dst", r.alias("r"), s.alias("sigma")) for p, (r, s) in sizes.items()))


@query(f"{NN}, out AS (SELECT a.src, a.dst, a.d, exp(0.08 * greatest(z, 0) - 0.05 * greatest(-z, 0)) AS g FROM (SELECT src, dst, d, d - 1 AS z FROM nn WHERE rk <= {DEG_MAX}) a)", "d g", "src dst")
def edge_rules(spark, sf_dir):
    """Lengths of edges known by their ends only, and a gate of both signs."""
    p = points(spark, sf_dir)
    own = spatial.edge_distances(p, spatial.knn(p, DEG_MAX).select("src", "dst"))
    return own.select("src", "dst", "d", C.gate(F.col("d") - 1, dbl(0.08), 0.05).alias("g"))
