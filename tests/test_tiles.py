"""Tiled prediction against the same model on the whole raster at once."""

import numpy as np
import pytest

from tessera.operators import tiles


def box(radius):
    """Mean of the squares around each pixel, of what is there."""

    def run(a):
        a = a.sum(2)
        wide = np.pad(a, radius, constant_values=np.nan)
        views = np.lib.stride_tricks.sliding_window_view(wide, (2 * radius + 1, 2 * radius + 1))
        with np.errstate(all="ignore"):
            there = ~np.isnan(views)
            return np.where(there, views, 0).sum((2, 3)) / there.sum((2, 3))

    return run


@pytest.fixture(scope="module")
def raster(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(23, 31, 2))
    a[rng.random((23, 31)) < 0.2] = np.nan
    rows = [(y, x, a[y, x].tolist()) for y in range(23) for x in range(31) if not np.isnan(a[y, x, 0])]
    return a, spark.createDataFrame(rows, "y int, x int, f array<double>").cache()


@pytest.mark.parametrize(("size", "halo", "radius", "blend"), [(5, 2, 2, False), (7, 3, 2, False), (64, 1, 1, False), (1, 1, 1, False), (4, 3, 1, True), (9, 2, 1, True), (6, 8, 1, True)])
def test_equal_to_the_whole_raster(raster, size, halo, radius, blend):
    a, rows = raster
    want = box(radius)(a)
    got = {(r.y, r.x): r.p for r in tiles.predicted(rows, box(radius), size, halo, blend, float("nan")).collect()}
    assert len(got) == rows.count() and tiles.predicted(rows, box(radius), size, halo, blend, float("nan")).count() == len(got)
    assert max(abs(v - want[k]) for k, v in got.items()) < 1e-12


def test_blend_softens_jumps_at_tile_borders(raster):
    """For a model that looks further than the halo: how much the error changes from one side of a border to the other."""
    a, rows = raster
    want = box(4)(a)

    def jump(blend):
        off = np.full(want.shape, np.nan)
        for r in tiles.predicted(rows, box(4), 6, 3, blend, float("nan")).collect():
            off[r.y, r.x] = r.p - want[r.y, r.x]
        return np.nanmean([np.abs(off[:, x] - off[:, x - 1]) for x in range(6, 31, 6)])

    assert jump(True) < jump(False)


def test_places_below_zero_nulls_and_bad_input(spark):
    rows = [(-3, -2, [1.0]), (5, 4, [None]), (0, 0, None), (None, 1, [1.0]), (-1, 7, [2.0])]
    df = spark.createDataFrame(rows, "y int, x int, f array<double>")
    got = sorted(tuple(r) for r in tiles.predicted(df, lambda a: a[:, :, 0], 2, 1, fill=9.0).collect())
    assert got == [(-3, -2, 1.0), (-1, 7, 2.0), (5, 4, 9.0)]
    assert tiles.predicted(df.where("false"), lambda a: a[:, :, 0]).count() == 0
    with pytest.raises(ValueError):
        tiles.predicted(df, lambda a: a, 0)
    with pytest.raises(ValueError):
        tiles.predicted(df, lambda a: a, 4, 1, blend=True)
    with pytest.raises(Exception, match="the model returned"):
        tiles.predicted(df, lambda a: a, 4, 1).count()
    unlike = df.union(spark.createDataFrame([(5, 5, [1.0, 2.0])], df.schema))
    with pytest.raises(Exception, match="number of channels"):
        tiles.predicted(unlike, lambda a: a[:, :, 0], 8, 1).count()
