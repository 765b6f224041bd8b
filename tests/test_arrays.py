"""Numpy files: every kind, order and container gives the rows that numpy gives; parts, ranges and errors."""

import numpy as np
import pytest

from tessera.sources import arrays


def cells(df):
    return sorted(tuple(r) for r in df.collect())


def expected(a):
    flat = [(*i, *((v.real, v.imag) if a.dtype.kind == "c" else (v,))) for i, v in np.ndenumerate(a)]
    return sorted(tuple(x.item() if hasattr(x, "item") else x for x in r) for r in flat)


ARRAYS = [
    np.arange(24, dtype="<i4").reshape(2, 3, 4), np.asfortranarray(np.arange(12, dtype=">f8").reshape(3, 4)), np.array([True, False]), np.array([1 + 2j, 3 - 1j], "c8"),
    np.array(["a", "", "länger"]), np.arange(5, dtype="u1"), np.array([0.5, 2], "f2"), np.zeros((0, 3)), np.array(7.5), np.arange(30.0).reshape(5, 6)[::2],
]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(arrays, "RANGE", 16)
    monkeypatch.setattr(arrays, "PIECE", 3)


@pytest.mark.parametrize("k", range(len(ARRAYS)))
def test_files_and_bundles(spark, tmp_path, k):
    a = ARRAYS[k]
    np.save(f"{tmp_path}/a.npy", a)
    np.savez(f"{tmp_path}/stored.npz", other=np.arange(3), a=a)
    np.savez_compressed(f"{tmp_path}/packed.npz", other=np.arange(3), a=a)
    want = expected(a)
    assert cells(arrays.array(spark, f"{tmp_path}/a.npy")) == want
    assert cells(arrays.array(spark, f"file://{tmp_path}/stored.npz", "a")) == want
    assert cells(arrays.array(spark, f"file:{tmp_path}/packed.npz", "a")) == want
    assert arrays.members(f"{tmp_path}/packed.npz") == {"other": (3,), "a": a.shape}


@pytest.mark.parametrize("fortran", [False, True])
def test_ranges_are_read_apart(tmp_path, small, fortran):
    a = np.arange(50.0).reshape(10, 5)
    np.save(f"{tmp_path}/a.npy", np.asfortranarray(a) if fortran else a)
    np.savez_compressed(f"{tmp_path}/a.npz", a=np.asfortranarray(a) if fortran else a)
    for path, member in (("a.npy", None), ("a.npz", "a")):
        for layout in ("cells", "rows"):
            reader = arrays.ArrayReader(arrays._parts(f"{tmp_path}/{path}", member), layout, ["a", "b", "v"][: 3 if layout == "cells" else 2])
            parts = reader.partitions()
            assert len(parts) == (1 if member else 25 if layout == "cells" else 10)
            rows = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
            assert sorted(rows) == (expected(a) if layout == "cells" else [(i, r.tolist()) for i, r in enumerate(a)])


def test_written_parts_are_one_array(spark, tmp_path, monkeypatch):
    df = spark.range(0, 1000, 1, 7).selectExpr("id * 2 as a", "cast(id as double) / 3 as b")
    arrays.save(df, f"{tmp_path}/out")
    want = np.stack([np.arange(1000) * 2, np.arange(1000) / 3], 1)
    parts = sorted((tmp_path / "out").glob("*.npy"))
    assert len(parts) == 7 and np.allclose(np.concatenate([np.load(p) for p in parts]), want)
    assert cells(arrays.array(spark, f"{tmp_path}/out", layout="rows", value="f")) == [(i, r.tolist()) for i, r in enumerate(want)]
    arrays.save(spark.range(3).selectExpr("array(id, id + 1) as f"), f"{tmp_path}/out", "overwrite")
    assert cells(arrays.array(spark, f"{tmp_path}/out")) == [(i, j, i + j) for i in range(3) for j in range(2)]
    arrays.save(spark.range(3, 5).selectExpr("array(id, id + 1) as f"), f"{tmp_path}/out")
    assert arrays.shape_of(f"{tmp_path}/out") == (5, 2)
    assert cells(arrays.array(spark, f"{tmp_path}/out")) == [(i, j, i + j) for i in range(5) for j in range(2)]
    with pytest.raises(Exception, match="nulls"):
        arrays.save(spark.createDataFrame([("x",), (None,)], "s string"), f"{tmp_path}/bad")


def test_tissue_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    xyz, w = rng.normal(size=(6, 3)), rng.integers(0, 3, (6, 6)).astype(float)
    np.save(f"{tmp_path}/coords.npy", xyz)
    assert cells(arrays.coords(spark, f"{tmp_path}/coords.npy")) == [(i, *r[1:].tolist()) for i, r in enumerate(xyz)]
    np.savez(f"{tmp_path}/square.npz", first=np.zeros(3), second=w, W2=w + 1)
    np.savez(f"{tmp_path}/named.npz", first=w + 1, W=w)
    want = sorted((i, j, w[i, j]) for i, j in zip(*np.nonzero(w), strict=True))
    assert cells(arrays.matrix(spark, f"{tmp_path}/square.npz")) == want == cells(arrays.matrix(spark, f"{tmp_path}/named.npz"))
    np.savez(f"{tmp_path}/none.npz", a=np.zeros((2, 3)))
    with pytest.raises(ValueError, match="square"):
        arrays.matrix(spark, f"{tmp_path}/none.npz")
    for names in (("edges", "kernel"), ("E", "K")):
        np.savez(f"{tmp_path}/kernel.npz", **{names[0]: np.array([[0, 1], [1, 2]]), names[1]: np.array([[0.5], [0.25]]), "theta": np.array([1.0, 2.0]), "h": np.float64(1.5), "policy": np.array("iso")[None][:0]})
        e, meta = arrays.kernel(spark, f"{tmp_path}/kernel.npz")
        assert sorted((r.src, r.dst, r.k, r.theta) for r in e.collect()) == [(0, 1, 0.5, 1.0), (1, 2, 0.25, 2.0)] and meta == {"h": 1.5}
    np.savez(f"{tmp_path}/bad.npz", edges=np.zeros((2, 2)))
    with pytest.raises(ValueError, match="kernel"):
        arrays.kernel(spark, f"{tmp_path}/bad.npz")
    np.save(f"{tmp_path}/f.npy", xyz)
    assert [(r.spot_id, r.spot, r.f) for r in arrays.features(spark, f"{tmp_path}/f.npy").orderBy("spot_id").collect()] == [(i, None, r.tolist()) for i, r in enumerate(xyz)]
    spark.createDataFrame([("s1", 1.5, "t", 2.0)], "spot string, a double, note string, b double").write.option("header", True).csv(f"{tmp_path}/f.csv")
    assert arrays.features(spark, f"{tmp_path}/f.csv", "spot").first().asDict() == {"spot_id": 0, "spot": "s1", "f": [1.5, 2.0]}


def test_rasters_masks_and_bands(spark, tmp_path):
    image = np.arange(24.0).reshape(4, 6)
    np.save(f"{tmp_path}/image.npy", image)
    np.savez(f"{tmp_path}/image.npz", image)
    np.save(f"{tmp_path}/flat.npy", np.arange(16))
    np.save(f"{tmp_path}/odd.npy", np.arange(15))
    assert cells(arrays.raster(spark, f"{tmp_path}/image.npy")) == expected(image) == cells(arrays.raster(spark, f"{tmp_path}/image.npz"))
    assert cells(arrays.raster(spark, f"{tmp_path}/flat.npy")) == expected(np.arange(16.0).reshape(4, 4))
    with pytest.raises(ValueError, match="square"):
        arrays.raster(spark, f"{tmp_path}/odd.npy")
    assert arrays.mask_auto(spark, str(tmp_path)) is None
    np.save(f"{tmp_path}/mask_a.npy", image > 10)
    want = sorted(map(tuple, np.argwhere(image > 10).tolist()))
    assert cells(arrays.mask_auto(spark, str(tmp_path))) == want
    tensor = np.stack([image, -image], 2)
    np.savez(f"{tmp_path}/tensor.npz", expr=tensor)
    got = arrays.masked_tensor(spark, f"{tmp_path}/tensor.npz", arrays.mask_auto(spark, str(tmp_path)), (4, 6), "expr")
    assert cells(got) == [(y, x, tensor[y, x].tolist()) for y, x in want]
    with pytest.raises(ValueError, match="needed"):
        arrays.masked_tensor(spark, f"{tmp_path}/tensor.npz", got, (4, 5), "expr")
    for name, f in (("L1_B01_x", 1), ("L1_B10_x", 2), ("L1_B00_x", 9), ("L2_B01_x", 3), ("L2_B10_x", 4)):
        np.save(f"{tmp_path}/{name}.npy", image * f)
    with pytest.raises(FileNotFoundError, match="theta"):
        arrays.bands_with_angles(spark, str(tmp_path))
    np.savez(f"{tmp_path}/meta.npz", theta=np.array([0.0, 1.5]), kappa=np.array([0.3, 0.4]))
    got = arrays.bands_with_angles(spark, str(tmp_path)).where("y = 1 and x = 1").orderBy("level", "band").collect()
    assert [(r.level, r.band, r.theta, r.kappa, r.v) for r in got] == [(1, 0, 0.0, 0.3, 7.0), (1, 1, 1.5, 0.4, 14.0), (2, 0, 0.0, 0.3, 21.0), (2, 1, 1.5, 0.4, 28.0)]


def test_objects_are_refused(spark, tmp_path):
    np.save(f"{tmp_path}/o.npy", np.array([{"a": 1}], object), allow_pickle=True)
    with pytest.raises(Exception, match="objects"):
        arrays.array(spark, f"{tmp_path}/o.npy").collect()
    with pytest.raises(Exception, match="missing"):
        arrays.array(spark, f"{tmp_path}/missing.npy").collect()
