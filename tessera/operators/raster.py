"""Rasters in long form: binning, sampling, smoothing, masks, resampling.

pixels: (y, x, v), perhaps with a channel c.  A mask is the rows (y, x) that are
true.  Neighbourhoods are joins with a small table of offsets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import clip, dbl, grid_bin, hsv, pixel_of
from tessera.plans.components import components
from tessera.plans.numbering import number_rows
from tessera.plans.order_stats import quantile
from tessera.plans.workspace import materialise


def bounds(points: DataFrame) -> dict:
    """x0, x1, y0, y1: minimum, and maximum plus one, of either axis."""
    r = points.agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1")).first()
    return {k: r[k] for k in ("x0", "x1", "y0", "y1")}


def cell_size(b: dict, cells: int) -> tuple[float, float]:
    return (b["x1"] - b["x0"]) / cells, (b["y1"] - b["y0"]) / cells


def bins(points: DataFrame, b: dict, cells: int, factor: int = 1) -> DataFrame:
    """points with ybin and xbin."""
    return points.withColumn("ybin", grid_bin(F.col("y"), dbl(b["y0"]), dbl(b["y1"]), cells, factor)).withColumn("xbin", grid_bin(F.col("x"), dbl(b["x0"]), dbl(b["x1"]), cells, factor))


def cell_means(points: DataFrame, expr: DataFrame, cells: int, swapped: bool = False) -> DataFrame:
    """(gene, i, j, v): mean expression of the spots in each cell that holds any; i is the y cell, or the x cell if swapped.

    Spots without a row for the gene count as 0; cells without spots are 0 and left out.
    """
    own = bins(points, bounds(points), cells)
    i, j = ("xbin", "ybin") if swapped else ("ybin", "xbin")
    count = own.groupBy(F.col(i).alias("i"), F.col(j).alias("j")).agg(F.count("*").alias("n"))
    sums = own.join(expr, own["id"] == expr["spot_id"]).groupBy("gene", F.col(i).alias("i"), F.col(j).alias("j")).agg(F.sum("value").alias("s"))
    return sums.join(count, ["i", "j"]).select("gene", "i", "j", (F.col("s") / F.col("n")).alias("v"))


def upsample(points: DataFrame, grid: DataFrame, b: dict, cells: int, width: int, height: int, factor: int = 1) -> DataFrame:
    """(y, x, v): each spot writes its grid cell's value to its pixel; the last spot by id wins."""
    own = bins(points, b, cells, factor).withColumn("py", pixel_of(F.col("y"), dbl(b["y0"]), dbl(b["y1"]), height)).withColumn("px", pixel_of(F.col("x"), dbl(b["x0"]), dbl(b["x1"]), width))
    hit = own.join(grid, (F.col("ybin") == F.col("i")) & (F.col("xbin") == F.col("j")))
    return hit.groupBy(F.col("py").alias("y"), F.col("px").alias("x")).agg(F.max_by("v", "id").alias("v"))


def resample_bands(points: DataFrame, bands: DataFrame, cells: int, width: int, height: int) -> DataFrame:
    """(name, y, x, v): level-1 bands at half, level-2 at quarter resolution back on the image; B00 and deeper levels are left out."""
    b = bounds(points)
    own = bands.where("(level in (1, 2)) and not (bi = 0 and bj = 0)")
    out = None
    for level, factor in ((1, 2), (2, 4)):
        rows = bins(points, b, cells, factor).withColumn("py", pixel_of(F.col("y"), dbl(b["y0"]), dbl(b["y1"]), height)).withColumn("px", pixel_of(F.col("x"), dbl(b["x0"]), dbl(b["x1"]), width))
        grid = own.where(F.col("level") == level).select("bi", "bj", F.col("y").alias("gi"), F.col("x").alias("gj"), "v")
        hit = rows.join(grid, (F.col("ybin") == F.col("gi")) & (F.col("xbin") == F.col("gj")))
        got = hit.groupBy(F.concat(F.lit(f"L{level}_B"), F.col("bi").cast("string"), F.col("bj").cast("string")).alias("name"), F.col("py").alias("y"), F.col("px").alias("x")).agg(F.max_by("v", "id").alias("v"))
        out = got if out is None else out.unionByName(got)
    return out


def sample(points: DataFrame, pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(id, v, clipped): the pixel at the rounded coordinates, clamped to the image; half goes to even, what isn't finite is 0."""
    px, py = F.rint("x"), F.rint("y")
    own = points.select("id", clip(px, 0, width - 1).cast("int").alias("_x"), clip(py, 0, height - 1).cast("int").alias("_y"), ((px < 0) | (px > width - 1) | (py < 0) | (py > height - 1)).alias("clipped"))
    got = own.join(pixels.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "v"), ["_x", "_y"], "left")
    v = F.when(F.isnan("v") | (F.abs("v") == float("inf")), dbl(0)).otherwise(F.coalesce("v", dbl(0)))
    return got.select("id", v.alias("v"), "clipped")


def map_to_grid(points: DataFrame, width: int, height: int) -> DataFrame:
    """points scaled to the image if they lie in 0..1, stretched if they lie outside of it, else as they are."""
    r = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    x0, x1, y0, y1 = (float(v or 0) for v in r)
    if max(x1, y1) <= 1 + 1e-6:
        return points.withColumn("x", F.col("x") * (width - 1)).withColumn("y", F.col("y") * (height - 1))
    if x0 < 0 or y0 < 0 or x1 > width - 1 or y1 > height - 1:
        return points.withColumn("x", (F.col("x") - x0) / dbl(max(x1 - x0, 1e-12)) * (width - 1)).withColumn("y", (F.col("y") - y0) / dbl(max(y1 - y0, 1e-12)) * (height - 1))
    return points


def offsets(radius: int) -> Column:
    """An array of (dx, dy, d2) within a disk."""
    return F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(dx * dx + dy * dy)).alias("d2")) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius))


def disk_smooth(points: DataFrame, width: int, height: int, radius: int, sigma: float) -> DataFrame:
    """(y, x, v): spots (x, y, v) spread over a disk with Gaussian weights, over the sum of weights."""
    own = points.select(F.col("x").cast("int").alias("sx"), F.col("y").cast("int").alias("sy"), "v").where((F.col("sx") >= 0) & (F.col("sx") < width) & (F.col("sy") >= 0) & (F.col("sy") < height))
    rows = own.withColumn("o", F.explode(offsets(radius))).select((F.col("sx") + F.col("o.dx")).alias("x"), (F.col("sy") + F.col("o.dy")).alias("y"), F.exp(-F.col("o.d2") / dbl(2 * sigma * sigma)).alias("w"), "v")
    rows = rows.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    total = F.sum("w")
    return rows.groupBy("y", "x").agg((F.sum(F.col("w") * F.col("v")) / F.when(total == 0, dbl(1)).otherwise(total)).alias("v"))


def resize_mask(mask: DataFrame, old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """(y, x) of the mask at another (height, width), by the nearest old pixel."""
    (h0, w0), (h1, w1) = old, new
    spark = mask.sparkSession
    ys = spark.range(h1).select(F.col("id").cast("int").alias("y"), F.least(F.floor((F.col("id") + 0.5) * h0 / h1), F.lit(h0 - 1)).cast("int").alias("oy"))
    xs = spark.range(w1).select(F.col("id").cast("int").alias("x"), F.least(F.floor((F.col("id") + 0.5) * w0 / w1), F.lit(w0 - 1)).cast("int").alias("ox"))
    own = mask.select(F.col("y").alias("oy"), F.col("x").alias("ox"))
    return own.join(ys, "oy").join(xs, "ox").select("y", "x")


def dilate(mask: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    rows = mask.select("y", "x").withColumn("o", F.explode(offsets(radius))).select((F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return rows.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)).distinct()


def erode(mask: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """Pixels whose whole disk, as far as it lies in the image, is in the mask."""
    own = mask.select("y", "x").distinct()
    around = own.withColumn("o", F.explode(offsets(radius))).select("y", "x", (F.col("y") + F.col("o.dy")).alias("ny"), (F.col("x") + F.col("o.dx")).alias("nx"))
    inside = around.where((F.col("nx") >= 0) & (F.col("nx") < width) & (F.col("ny") >= 0) & (F.col("ny") < height))
    out = inside.join(own.select(F.col("y").alias("ny"), F.col("x").alias("nx")), ["ny", "nx"], "left_anti").select("y", "x").distinct()
    return own.join(out, ["y", "x"], "left_anti")


def close(mask: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    return erode(materialise(dilate(mask, radius, width, height), "dilated"), radius, width, height)


#: Side of a tile in pixels; a task holds one tile and its halo.
TILE = 512


def _tiled(rows: DataFrame, halo: int = 0) -> DataFrame:
    """rows once for each tile (_ty, _tx) that has their pixel within its halo."""
    for at, to in (("y", "_ty"), ("x", "_tx")):
        rows = rows.withColumn(to, F.explode(F.sequence(F.greatest(F.floor((F.col(at) - halo) / TILE), F.lit(0)), F.floor((F.col(at) + halo) / TILE))) if halo else F.floor(F.col(at) / TILE))
    return rows


def _parts_of(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pixel of a tile, sorted by row and column, the number of the first pixel of its 4-connected part."""
    at = np.full((i.max() + 2, j.max() + 2), -1)
    at[i, j] = np.arange(len(i))
    u = np.tile(np.arange(len(i)), 2)
    v = np.concatenate([at[i + 1, j], at[i, j + 1]])
    u, v = u[v >= 0], v[v >= 0]
    first = np.arange(len(i))
    while len(u):
        low, high = np.minimum(first[u], first[v]), np.maximum(first[u], first[v])
        apart = low < high
        u, v = u[apart], v[apart]
        np.minimum.at(first, high[apart], low[apart])
        while (first != first[first]).any():
            first = first[first]
    return first


def parts(mask: DataFrame, width: int, height: int | None = None) -> DataFrame:
    """(y, x, object, n): 4-connected parts of the mask, or with a height of what it leaves of the image, and their sizes.

    A part is named after its smallest pixel in row-major order.  Tiles find their own parts; only parts that touch a tile's
    side are joined with others, in tables as small as those sides.
    """
    kinds = {c: mask.schema[c].dataType.simpleString() for c in ("y", "x")}
    own = mask.select("y", "x")
    if height is not None:  # every tile has to be looked at
        tiles = mask.sparkSession.range(-(-height // TILE) * -(-width // TILE)).select(F.floor(F.col("id") / -(-width // TILE)).alias("_ty"), (F.col("id") % -(-width // TILE)).alias("_tx"))
        own = _tiled(own).unionByName(tiles, allowMissingColumns=True)
    else:
        own = _tiled(own)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = key[0] * TILE, key[1] * TILE
        rows = rows[rows["y"].notna()]
        here = np.zeros((TILE, TILE), bool)
        here[rows["y"].to_numpy(np.int64) - y0, rows["x"].to_numpy(np.int64) - x0] = True
        if height is not None:
            here = ~here[: height - y0, : width - x0]
        i, j = np.nonzero(here)
        if not len(i):
            return pd.DataFrame({"y": i, "x": j, "part": i, "n": i, "side": i > 0})
        first = _parts_of(i, j)
        n = np.bincount(first)[first]
        side = np.bincount(first, weights=(i == 0) | (i == TILE - 1) | (j == 0) | (j == TILE - 1))[first] > 0
        y, x = i + y0, j + x0
        return pd.DataFrame({"y": y, "x": x, "part": (y * width + x)[first], "n": n, "side": side})

    made = own.groupBy("_ty", "_tx").applyInPandas(run, f"y {kinds['y']}, x {kinds['x']}, part bigint, n bigint, side boolean")
    found = materialise(made, "tile-parts")
    links = None
    for at, other in (("y", "x"), ("x", "y")):
        last = found.where(F.col("side") & (F.col(at) % TILE == TILE - 1)).select((F.col(at) + 1).alias(at), other, F.col("part").alias("a"))
        link = last.join(found.where(F.col("side") & (F.col(at) % TILE == 0)).select(at, other, F.col("part").alias("b")), [at, other]).select("a", "b").distinct()
        links = link if links is None else links.unionByName(link)
    whole = components(links, "a", "b").select(F.col("id").alias("part"), "component")
    sums = found.where("side").select("part", "n").distinct().join(whole, "part")
    sums = sums.join(sums.groupBy("component").agg(F.sum("n").alias("sum")), "component").select("part", F.col("component").alias("_o"), "sum")
    return found.join(materialise(sums, "joined-parts"), "part", "left").select("y", "x", F.coalesce("_o", "part").alias("object"), F.coalesce("sum", "n").alias("n"))


def objects(mask: DataFrame, width: int) -> DataFrame:
    """(y, x, object): 4-connected parts of the mask."""
    return parts(mask, width).drop("n")


def drop_small(mask: DataFrame, width: int, least: int) -> DataFrame:
    return parts(mask, width).where(F.col("n") >= least).select("y", "x")


def fill_holes(mask: DataFrame, width: int, height: int, least: int) -> DataFrame:
    """The mask with background parts under ``least`` pixels."""
    return mask.select("y", "x").unionByName(parts(mask, width, height).where(F.col("n") < least).select("y", "x"))


def largest_object(mask: DataFrame, width: int) -> DataFrame:
    own = materialise(parts(mask, width), "objects")
    best = own.agg(F.max(F.struct("n", (-F.col("object")).alias("less")))["less"]).first()[0]
    return own.where(F.col("object") == F.lit(None if best is None else -best)).select("y", "x")


def _blurred(a: np.ndarray, there: np.ndarray, sigma: float, edges: list[tuple[int, int]]) -> np.ndarray:
    """Separable Gaussian blur over the pixels that are there, the image's edges repeated; edges: first and last line of the image along either axis."""
    reach = max(1, int(4 * sigma + 0.5))
    for axis in (1, 0):
        low, high = edges[axis]
        total, weight = np.zeros(a.shape), np.zeros(a.shape)
        lines = np.arange(a.shape[axis])
        for k in range(-reach, reach + 1):
            at = np.clip(lines + k, low, high)
            known = (at >= 0) & (at < len(lines))
            at = np.clip(at, 0, len(lines) - 1)
            seen = np.take(there, at, axis) & (known if axis == 1 else known[:, None])
            w = np.exp(-k * k / (2 * sigma * sigma))
            total += np.where(seen, w * np.take(a, at, axis), 0.0)
            weight += w * seen
        a = np.divide(total, weight, out=np.zeros(a.shape), where=there & (weight > 0))
    return a


def _spread(mask: np.ndarray, radius: int) -> np.ndarray:
    """Dilation by a disk."""
    h, w = mask.shape
    out, wide = np.zeros(mask.shape, bool), np.pad(mask, radius)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dx * dx + dy * dy <= radius * radius:
                out |= wide[radius + dy : radius + dy + h, radius + dx : radius + dx + w]
    return out


def tissue_mask(rgb: DataFrame, width: int, height: int, sigma: float = 1.0, saturation: float = 0.18, value: float = 0.67, least: int = 64) -> DataFrame:
    """(y, x) of tissue in an image (y, x, r, g, b in 0..1): coloured or dark, not the brightest; closed, cleaned, the largest object.

    Blurring, the colour rule and closing run in one pass over tiles with a halo as wide as the three look; nothing as large
    as the image is joined.
    """
    s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    own = rgb.select("y", "x", F.coalesce(s, dbl(0)).alias("s"), F.coalesce(v, dbl(0)).alias("v"), (0.2125 * F.col("r") + 0.7154 * F.col("g") + 0.0721 * F.col("b")).alias("gray"))
    top, radius = quantile(own, "gray", 0.96), 2
    halo = max(1, int(4 * sigma + 0.5)) + 2 * radius
    side = TILE + 2 * halo

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(key[0]) * TILE - halo, int(key[1]) * TILE - halo
        i, j = rows["y"].to_numpy(np.int64) - y0, rows["x"].to_numpy(np.int64) - x0
        there = np.zeros((side, side), bool)
        there[i, j] = True
        s, v, gray = (np.full((side, side), np.nan) for _ in range(3))
        for a, c in ((s, "s"), (v, "v"), (gray, "gray")):
            a[i, j] = rows[c].to_numpy(float)
        edges = [(-y0, height - 1 - y0), (-x0, width - 1 - x0)]
        s, v = (_blurred(a, there, sigma, edges) for a in (s, v))
        raw = there & (~(s <= saturation) | (v < value)) & (gray < top)
        lines = [(np.arange(side) >= low) & (np.arange(side) <= high) for low, high in edges]
        inside = lines[0][:, None] & lines[1][None, :]
        wide = _spread(raw, radius) & inside
        closed = wide & ~_spread(inside & ~wide, radius)
        i, j = np.nonzero(closed[halo:-halo, halo:-halo])
        return pd.DataFrame({"y": i + y0 + halo, "x": j + x0 + halo})

    kinds = {c: rgb.schema[c].dataType.simpleString() for c in ("y", "x")}
    if top is None:
        return rgb.select("y", "x").limit(0)
    closed = materialise(_tiled(own, halo).groupBy("_ty", "_tx").applyInPandas(run, f"y {kinds['y']}, x {kinds['x']}"), "closed-mask")
    cleaned = materialise(drop_small(closed, width, least), "cleaned-mask")
    return largest_object(materialise(fill_holes(cleaned, width, height, least), "filled-mask"), width)


def rescue(mask: DataFrame, points: DataFrame, spacing: float, width: int, height: int, share: float = 0.6) -> DataFrame:
    """The mask and a disk around each spot that it misses."""
    own = points.select(F.rint("y").cast("int").alias("y"), F.rint("x").cast("int").alias("x")).distinct()
    lost = own.join(mask, ["y", "x"], "left_anti")
    return mask.select("y", "x").unionByName(dilate(lost, max(1, round(spacing * share)), width, height)).distinct()


def boundary(mask: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels that one step of dilation adds."""
    return dilate(mask, 1, width, height).join(mask, ["y", "x"], "left_anti")


def flatten(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """(ord, y, x, v): pixels of the mask in row-major order."""
    return number_rows(pixels.join(mask, ["y", "x"], "left_semi"), "ord", ["y", "x"])


def crop(pixels: DataFrame, points: DataFrame, scale: float) -> DataFrame:
    """Pixels in the bounding box of the scaled spots, whose axes are swapped."""
    r = points.agg(F.min((F.col("y") * scale).cast("int")), F.max((F.col("y") * scale).cast("int")), F.min((F.col("x") * scale).cast("int")), F.max((F.col("x") * scale).cast("int"))).first()
    return pixels.where(F.col("x").between(r[0], r[1]) & F.col("y").between(r[2], r[3]))


def channels(pixels: DataFrame, names: list[str]) -> DataFrame:
    """(y, x, one column for each channel) from (y, x, c, v)."""
    return pixels.groupBy("y", "x").pivot("c", list(range(len(names)))).agg(F.first("v")).select("y", "x", *(F.col(str(i)).alias(n) for i, n in enumerate(names)))


def stack(wide: DataFrame, names: list[str]) -> DataFrame:
    """(y, x, c, v) from a column for each channel."""
    parts = ", ".join(f"{i}, cast(`{n}` as double)" for i, n in enumerate(names))
    return wide.select("y", "x", F.expr(f"stack({len(names)}, {parts}) as (c, v)"))


def normalised_rgb(pixels: DataFrame) -> DataFrame:
    """(y, x, c, v) without alpha, over 255 if any value exceeds 1.5, clipped to 0..1."""
    own = pixels.where("c < 3")
    top = F.broadcast(own.agg(F.max("v").alias("_top")))
    return own.join(top).withColumn("v", clip(F.when(F.col("_top") > 1.5, F.col("v") / 255).otherwise(F.col("v")), 0, 1)).drop("_top")
