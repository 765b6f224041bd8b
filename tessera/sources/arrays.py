"""Numpy files as tables: .npy, .npz, and folders of .npy parts, read in ranges and written in parts.

A file's header is read once, on the driver; tasks then read ranges of its bytes.  A folder of .npy files is one
array, its parts in the order of their names joined along the first axis.  An .npz file, or a folder of such folders, holds
several arrays by name.  Members of an .npz that are compressed can't be read from the middle: each is one task, in pieces.

Paths are of any store that pyarrow's filesystems know (local and shared folders, S3, GCS, HDFS).  Objects are never
unpickled; arrays of them are an error.  Numbers come as bigint or double, truth values as boolean, complex
numbers as re and im, text as string.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.plans.numbering import number_rows

from . import tables

#: Bytes of a range; items made into rows at once; bytes of a part that a task writes.
RANGE, PIECE, PART = 32 << 20, 1 << 18, 64 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/[^/]", path):
        path = path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Part:
    """One stored array: where its data begin, and what they are.  row: of its first row in the whole array."""

    path: str
    offset: int
    kind: str
    shape: tuple[int, ...]
    fortran: bool
    row: int = 0
    member: str | None = None  # of a compressed member, which is read from its start

    @property
    def size(self) -> int:
        return int(np.prod(self.shape, dtype=np.int64))


def _header(f) -> tuple[str, tuple[int, ...], bool]:
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(f)
    if kind.hasobject:
        raise ValueError("arrays of objects are not read")
    if kind.kind not in "biufcU":
        raise ValueError(f"no column type for {kind}")
    return kind.str, shape, fortran


def _parts(path: str, member: str | None = None) -> list[Part]:
    """The files, or the member, that an array is stored in."""
    store, at = filesystem(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.Directory:
        if member:
            return _parts(f"{path.rstrip('/')}/{member}")
        root = path.rstrip("/")[: len(path.rstrip("/")) - len(at.rstrip("/"))]
        names = sorted(x.path for x in store.get_file_info(fs.FileSelector(at)) if x.path.endswith(".npy"))
        found = [p for n in names for p in _parts(root + n)]
        if not found:
            raise FileNotFoundError(f"no .npy files in {path}")
        if len({(p.kind, p.shape[1:]) for p in found}) > 1:
            raise ValueError(f"the parts of {path} don't fit together")
        rows = np.cumsum([0] + [p.shape[0] if p.shape else 1 for p in found])
        return [Part(p.path, p.offset, p.kind, p.shape, p.fortran, int(r)) for p, r in zip(found, rows, strict=False)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    with store.open_input_file(at) as f:
        if not path.endswith(".npz"):
            kind, shape, fortran = _header(f)
            return [Part(path, f.tell(), kind, shape, fortran)]
        with zipfile.ZipFile(f) as z:
            entry = z.getinfo(f"{member or _names(z)[0]}.npy")
            with z.open(entry) as inner:
                kind, shape, fortran = _header(inner)
                begin = inner.tell()
            if entry.compress_type != zipfile.ZIP_STORED:
                return [Part(path, begin, kind, shape, fortran, 0, entry.filename)]
        f.seek(entry.header_offset + 26)
        name, extra = struct.unpack("<HH", f.read(4))
        return [Part(path, entry.header_offset + 30 + name + extra + begin, kind, shape, fortran)]


def _names(z: zipfile.ZipFile) -> list[str]:
    return [n[:-4] for n in z.namelist() if n.endswith(".npy")]


def members(path: str) -> dict[str, tuple[int, ...]]:
    """Names and shapes of the arrays of an .npz file, or of a folder of arrays; headers only."""
    store, at = filesystem(path)
    if store.get_file_info(at).type == fs.FileType.Directory:
        names = [posixpath.basename(x.path) for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.Directory]
    else:
        with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
            names = _names(z)
    return {n: shape_of(path, n) for n in names}


def shape_of(path: str, member: str | None = None) -> tuple[int, ...]:
    own = _parts(path, member)
    return own[0].shape if len(own) == 1 else (sum(p.shape[0] for p in own), *own[0].shape[1:])


class _Range(InputPartition):
    def __init__(self, part: Part, start: int, stop: int):
        super().__init__((start, stop))
        self.part, self.start, self.stop = part, start, stop


def _values(raw: np.ndarray) -> list[pa.Array]:
    """Columns of some items."""
    kind = raw.dtype.kind
    if kind == "c":
        return [pa.array(np.ascontiguousarray(x, np.float64)) for x in (raw.real, raw.imag)]
    if kind == "U":
        return [pa.array(raw.tolist(), pa.string())]
    if kind == "u" and raw.dtype.itemsize == 8 and len(raw) and raw.max() > np.iinfo(np.int64).max:
        raise ValueError("a number is too large for bigint")
    return [pa.array(raw.astype({"b": bool, "i": np.int64, "u": np.int64, "f": np.float64}[kind]))]


def _columns(kind: str, name: str) -> str:
    code = np.dtype(kind).kind
    return "re double, im double" if code == "c" else f"{name} {dict(b='boolean', i='bigint', u='bigint', f='double', U='string')[code]}"


class ArrayReader(DataSourceReader):
    def __init__(self, parts: list[Part], layout: str, names: list[str]):
        self.parts, self.layout, self.names = parts, layout, names

    def partitions(self) -> list[_Range]:
        out = []
        for p in self.parts:
            width = np.dtype(p.kind).itemsize
            if self.layout == "rows":
                n, each = p.shape[0], width * (p.size // p.shape[0] if p.shape[0] else 1)
            else:
                n, each = p.size, width
            step = max(1, RANGE // max(1, each)) if p.member is None else max(1, n)
            out += [_Range(p, k, min(k + step, n)) for k in range(0, n, step)]
        return out or [_Range(self.parts[0], 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        p, kind = partition.part, np.dtype(partition.part.kind)
        store, at = filesystem(p.path)
        with store.open_input_file(at) as f:
            source = zipfile.ZipFile(f).open(p.member) if p.member else f
            if self.layout == "rows":
                yield from self._rows(source, p, kind, partition.start, partition.stop)
                return
            source.seek(p.offset + partition.start * kind.itemsize)
            for k in range(partition.start, partition.stop, PIECE):
                raw = np.frombuffer(source.read(min(PIECE, partition.stop - k) * kind.itemsize), kind)
                where = np.unravel_index(np.arange(k, k + len(raw)), p.shape, "F" if p.fortran else "C") if p.shape else ()
                where = [w.astype(np.int64) + (p.row if axis == 0 else 0) for axis, w in enumerate(where)]
                values = _values(raw)
                yield pa.RecordBatch.from_arrays([*map(pa.array, where), *values], self.names)

    def _rows(self, source, p: Part, kind: np.dtype, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        width = p.size // p.shape[0] if p.shape[0] else 0
        step = max(1, PIECE // max(1, width))
        for a in range(start, stop, step):
            b = min(a + step, stop)
            if p.fortran and len(p.shape) > 1:  # a stretch of each column
                own = np.empty((b - a, width), kind)
                for c in range(width):
                    source.seek(p.offset + (c * p.shape[0] + a) * kind.itemsize)
                    own[:, c] = np.frombuffer(source.read((b - a) * kind.itemsize), kind)
            else:
                source.seek(p.offset + a * width * kind.itemsize)
                own = np.frombuffer(source.read((b - a) * width * kind.itemsize), kind).reshape(b - a, width)
            flat = pa.array(own.astype(np.float64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * width), flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b) + p.row), lists], self.names)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ArrayWriter(DataSourceArrowWriter):
    """Each task writes parts under passing names; the commit puts them in the order of the partitions."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex[:12]
        kinds = {f.dataType.simpleString() for f in schema}
        self.lists = len(kinds) == 1 and next(iter(kinds)).startswith("array<")
        if self.lists and len(schema) > 1:
            raise ValueError("one column of arrays, or columns of numbers")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, at = filesystem(self.path)
        task = TaskContext.get()
        store.create_dir(at, recursive=True)
        held, size, files = [], 0, []

        def put() -> None:
            name = f"{task.partitionId():06d}-{len(files):05d}.npy"
            passing = f"{at}/_{self.run}-{task.taskAttemptId()}-{name}"
            out = io.BytesIO()
            np.save(out, np.concatenate(held), allow_pickle=False)
            with store.open_output_stream(passing) as f:
                f.write(out.getbuffer())
            files.append((passing, name))

        for batch in iterator:
            if self.lists:
                flat, shape = batch.column(0), [batch.num_rows]
                while pa.types.is_list(flat.type):
                    outer, flat = len(flat), flat.flatten()
                    shape.append(len(flat) // outer if outer else 0)
                own = flat.to_numpy(zero_copy_only=False).reshape(shape)
            else:
                cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                own = cols[0] if len(cols) == 1 else np.stack(cols, 1)
            if own.dtype == object:
                raise ValueError("nulls and other things than numbers can't be written")
            held.append(own)
            size += own.nbytes
            if size >= PART:
                put()
                held, size = [], 0
        if held:
            put()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = filesystem(self.path)
        old = [x.path for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.path.endswith(".npy") and not posixpath.basename(x.path).startswith("_")]
        if self.overwrite:
            for x in old:
                store.delete_file(x)
        before = "part" if self.overwrite or not old else f"part-{len(old):06d}"
        for m in messages:
            for passing, name in m.files if m else ():
                store.move(passing, f"{at}/{before}-{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = filesystem(self.path)
        for m in messages:
            for passing, _ in m.files if m else ():
                store.delete_file(passing)


class ArraySource(DataSource):
    """Options: path; member, of several arrays; axes, their names (i0, i1, ... if left out); value, that of the cells;
    layout: cells, a row for each, or rows, one for each index of the first axis with all its values as doubles.
    """

    @classmethod
    def name(cls) -> str:
        return "numpy"

    def _stored(self) -> list[Part]:
        return _parts(self.options["path"], self.options.get("member"))

    def schema(self) -> str:
        first = self._stored()[0]
        named = [a for a in (self.options.get("axes") or "").split(",") if a]
        value = self.options.get("value") or "v"
        if self.options.get("layout") == "rows":
            if not first.shape or np.dtype(first.kind).kind not in "biuf" or first.fortran and len(first.shape) > 2:
                raise ValueError("rows need numbers, one axis at least, and C order beyond two axes")
            return f"{(named or ['i0'])[0]} bigint, {value} array<double>"
        names = named or [f"i{k}" for k in range(len(first.shape))]
        if len(names) != len(first.shape):
            raise ValueError(f"{len(first.shape)} axes, not {names}")
        return ", ".join([f"{n} bigint" for n in names] + [_columns(first.kind, value)])

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self._stored(), self.options.get("layout") or "cells", schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"], schema, overwrite)


def array(spark: SparkSession, path: str, member: str | None = None, axes: str | None = None, value: str = "v", layout: str = "cells") -> DataFrame:
    """An array as a table, a row for each cell, or for each index of its first axis."""
    spark.dataSource.register(ArraySource)
    options = {"member": member, "axes": axes, "value": value, "layout": layout}
    return spark.read.format("numpy").options(**{k: v for k, v in options.items() if v}).load(path)


def save(df: DataFrame, path: str, mode: str = "append") -> None:
    """Columns of numbers, or one of arrays of them (nested, for more axes), as a folder of .npy parts: rows in the order of the partitions."""
    df.sparkSession.dataSource.register(ArraySource)
    df.write.format("numpy").mode(mode).save(path)


# --- what tissue tools keep in such files


def coords(spark: SparkSession, path: str) -> DataFrame:
    """(spot_id, x, y): the last two columns."""
    rows = array(spark, path, axes="spot_id", value="f", layout="rows")
    return rows.select("spot_id", F.element_at("f", -2).alias("x"), F.element_at("f", -1).alias("y"))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, w) of the cells that aren't 0: of an array's own, else of member W, else of the first square one."""
    name = None
    if path.rstrip("/").endswith(".npz"):
        found = members(path)
        square = [n for n, s in found.items() if len(s) == 2 and s[0] == s[1]]
        if "W" not in found and not square:
            raise ValueError("no square matrix")
        name = "W" if "W" in found else square[0]
    return array(spark, path, name, "i,j", "w").select("i", "j", F.col("w").cast("double").alias("w")).where("w <> 0")


def kernel(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    """Edges (src, dst, k, and what else there is for each edge), and the single numbers of a kernel bundle."""
    found = members(path)
    ends, k = (next((n for n in names if n in found), None) for names in (("edges", "E"), ("kernel", "K")))
    if not ends or not k:
        raise ValueError("edges (or E) and kernel (or K) are needed")
    e = array(spark, path, ends, "e,side")
    rows = e.groupBy("e").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).cast("bigint").alias("src"), F.max(F.when(F.col("side") == 1, F.col("v"))).cast("bigint").alias("dst"))
    n = found[ends][0]
    each = [k, *sorted(m for m, s in found.items() if m not in (ends, "kernel", "K", "edges", "E") and s == (n,))]
    for m in each:
        if found[m] not in ((n,), (n, 1)):
            raise ValueError(f"{m} has {found[m]} values for {n} edges")
        one = array(spark, path, m, "e" if len(found[m]) == 1 else "e,one", "k" if m == k else m)
        rows = rows.join(one.drop("one"), "e")
    meta = {m: float(array(spark, path, m).first()["v"]) for m, s in found.items() if int(np.prod(s)) == 1 and m not in (ends, k)}
    return rows.drop("e"), meta


def features(spark: SparkSession, path: str, spot: str | None = None) -> DataFrame:
    """(spot_id, spot, f): rows of an array, without names; or the numeric columns of a CSV, and its column of names if given."""
    if path.rstrip("/").endswith(".csv"):
        df = tables.csv(spark, path)
        if spot and spot not in df.columns:
            raise ValueError(f"no column {spot}")
        nums = [c for c in tables.numeric_columns(df) if c != spot]
        own = df.select((F.col(spot).cast("string") if spot else F.lit(None).cast("string")).alias("spot"), F.array(*map(tables.numeric, nums)).alias("f"))
        return number_rows(own, "spot_id").select("spot_id", "spot", "f")
    return array(spark, path, axes="spot_id", value="f", layout="rows").select("spot_id", F.lit(None).cast("string").alias("spot"), "f")


def raster(spark: SparkSession, path: str) -> DataFrame:
    """(y, x, v), or (y, x, c, v): of an .npz the member arr_0, else the first; a vector of s * s values is folded to s by s."""
    name = None
    if path.rstrip("/").endswith(".npz"):
        found = members(path)
        name = "arr_0" if "arr_0" in found else next(iter(found))
    shape = shape_of(path, name)
    if len(shape) == 1:
        side = int(shape[0] ** 0.5 + 0.5)
        if side * side != shape[0]:
            raise ValueError(f"{shape[0]} values make no square")
        flat = array(spark, path, name, "i")
        cells = flat.select(F.floor(F.col("i") / side).alias("y"), (F.col("i") % side).alias("x"), "v")
    elif len(shape) in (2, 3):
        cells = array(spark, path, name, "y,x" if len(shape) == 2 else "y,x,c")
    else:
        raise ValueError(f"a raster has two or three axes, not {len(shape)}")
    return cells.select(*(F.col(a).cast("int").alias(a) for a in cells.columns if a != "v"), F.col("v").cast("double").alias("v"))


def mask(spark: SparkSession, path: str) -> DataFrame:
    """(y, x) of the pixels that are set."""
    cells = array(spark, path, axes="y,x")
    return cells.where(F.col("v").cast("boolean")).select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))


def mask_auto(spark: SparkSession, folder: str, override: str | None = None) -> DataFrame | None:
    """The first file called mask*, *_bool or tissue_mask*; None if there is none."""
    found = [override] if override else [p for name in ("mask*", "*_bool", "tissue_mask*") for p in tables.listed(spark, f"{folder}/{name}.npy")]
    return mask(spark, found[0]) if found else None


def bands_with_angles(spark: SparkSession, folder: str, meta: str | None = None) -> DataFrame:
    """(level, band, theta, kappa, y, x, v): high-pass bands L1_B?? and L2_B?? by name, with their angles (radians) and weights.

    Angles come from the first bundle that has both theta and kappa, one of each for every band of level 1.
    The second level counts only if it has as many bands.
    """
    files = {lv: [p for p in tables.listed(spark, f"{folder}/L{lv}_B??_*.npy") if "B00" not in posixpath.basename(p.rstrip("/"))] for lv in (1, 2)}
    if not files[1]:
        raise FileNotFoundError(f"no bands of level 1 in {folder}")
    bundles = [meta] if meta else [p for p in tables.listed(spark, f"{folder}/*.npz") if {"theta", "kappa"} <= set(members(p))]
    if not bundles:
        raise FileNotFoundError("no bundle with theta and kappa")
    if any(shape_of(bundles[0], m) != (len(files[1]),) for m in ("theta", "kappa")):
        raise ValueError("theta and kappa need a value for each band of level 1")
    levels = [1, 2] if len(files[2]) == len(files[1]) else [1]
    if len({shape_of(p)[:2] for lv in levels for p in files[lv]}) > 1:
        raise ValueError("bands differ in size")
    each = [raster(spark, p).select(F.lit(lv).alias("level"), F.lit(k).alias("band"), "*") for lv in levels for k, p in enumerate(files[lv])]
    turned, weighed = (array(spark, bundles[0], m, "band", m) for m in ("theta", "kappa"))
    return reduce(DataFrame.unionByName, each).join(turned.join(weighed, "band").withColumn("band", F.col("band").cast("int")), "band")


def masked_tensor(spark: SparkSession, path: str, inside: DataFrame, size: tuple[int, int], member: str | None = None) -> DataFrame:
    """(y, x, f): the channels of a tensor's pixels inside a mask; an error unless it has the mask's size."""
    shape = shape_of(path, member)
    if len(shape) != 3 or shape[:2] != tuple(size):
        raise ValueError(f"a tensor of {size} is needed, not {shape}")
    cells = array(spark, path, member, "y,x,c").join(inside.select("y", "x"), ["y", "x"], "left_semi")
    own = cells.groupBy("y", "x").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("s"))
    return own.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.transform("s", lambda s: s["v"].cast("double")).alias("f"))
