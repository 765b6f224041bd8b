"""A caller's image model over a raster of any size: patches with a halo, predicted one by one, stitched again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import dbl


def _tiles(at: str, size: int, halo: int) -> Column:
    """Numbers of the tiles whose patches hold a row or column."""
    return F.sequence(F.floor((F.col(at) - halo) / size), F.floor((F.col(at) + halo) / size))


def _slope(size: int, halo: int) -> np.ndarray:
    """Weights along one side of a patch: 1 in the tile itself, falling to 0 on the patch's outermost line."""
    at = np.arange(size + 2 * halo)
    return np.clip(np.minimum(at, at[::-1]) / halo, 0, 1) if halo else np.ones(size)


def predicted(pixels: DataFrame, model: Callable[[np.ndarray], np.ndarray], size: int = 640, halo: int = 32, blend: bool = False, fill: float = 0.0) -> DataFrame:
    """(y, x, p): the model's value at every pixel of (y, x, f array of channels); pixels are unique.

    The model takes an array of (size + 2 halo, size + 2 halo, channels) and
    returns one of the first two dimensions.  What lies outside the raster, is
    missing in it or null is ``fill``.  A pixel goes to each patch that holds it,
    so one task has one patch at a time, whatever the raster's size.  Without
    ``blend`` a pixel has the value of its own tile: the same as for the whole
    raster at once if the model looks no further than ``halo``.  With it, values
    of all patches count, by weights that fall to 0 at a patch's rim: the same
    for the whole raster if the model looks no further than one pixel; for others
    with softer jumps at the tiles' borders, not with a smaller error on average.  Pixels whose vector is null have no row and count
    as missing.  Vectors of unlike length are an error.
    """
    if size < 1 or halo < 0:
        raise ValueError("tiles have at least one pixel, halos at least none")
    if blend and halo < 2:
        raise ValueError("blending needs a halo of two pixels or more")
    side, slope = size + 2 * halo, _slope(size, halo)
    own = pixels.where("y is not null and x is not null and f is not null").select(F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.transform(F.col("f").cast("array<double>"), lambda c: F.coalesce(c, dbl(fill))).alias("f"))
    own = own.select("*", F.explode(_tiles("y", size, halo)).alias("ty")).select("*", F.explode(_tiles("x", size, halo)).alias("tx"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ty, tx = key
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        i, j = y - (ty * size - halo), x - (tx * size - halo)
        inside = (i >= halo) & (i < halo + size) & (j >= halo) & (j < halo + size)
        if not inside.any():  # other tiles have these pixels
            return pd.DataFrame({"y": y[:0], "x": x[:0], "p": np.zeros(0), "w": np.zeros(0)})
        vectors = list(rows["f"])
        if len({len(v) for v in vectors}) > 1:
            raise ValueError("pixels differ in their number of channels")
        patch = np.full((side, side, len(vectors[0])), fill)
        patch[i, j] = np.array(vectors)
        out = np.asarray(model(patch), float)
        if out.shape != (side, side):
            raise ValueError(f"the model returned {out.shape} for a patch of {(side, side)}")
        w = slope[i] * slope[j] if blend else inside.astype(float)
        kept = w > 0
        return pd.DataFrame({"y": y[kept], "x": x[kept], "p": out[i, j][kept], "w": w[kept]})

    got = own.groupBy("ty", "tx").applyInPandas(run, "y bigint, x bigint, p double, w double")
    if not blend:
        return got.select("y", "x", "p")
    return got.groupBy("y", "x").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("p"))
