"""Python data sources for scientific files: ``nifti`` (version 1), ``matv5`` (MATLAB level 5) and ``npy``.

    spark.dataSource.register(formats.Nifti)
    spark.read.format("nifti").load("/data/*.nii.gz")

A file is a partition. Rows are cells: path, indices, value. Files of other formats raise; MATLAB 7.3 files (HDF5) are not
read, as no HDF5 library is here."""

from __future__ import annotations

import glob
import gzip
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: NIfTI-1 data types and MATLAB element types (fixed values).
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_COMPRESSED, MAT_MATRIX, MAT_CHAR, MAT_CELL, MAT_SPARSE, MAT_STRUCT, MAT_OBJECT = 15, 14, 4, 1, 5, 2, 3


def read_bytes(path: str) -> bytes:
    with (gzip.open if path.endswith(".gz") else open)(path, "rb") as f:
        return f.read()


def read_nifti(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(array in scanner units, 4 x 4 affine)."""
    raw = read_bytes(path)
    if len(raw) < 352 or raw[344:347] not in (b"n+1", b"ni1"):
        raise ValueError(f"{path}: no NIfTI-1 file")
    end = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    dims = struct.unpack(end + "8h", raw[40:56])
    shape = dims[1 : dims[0] + 1]
    code = struct.unpack(end + "h", raw[70:72])[0]
    pix = struct.unpack(end + "8f", raw[76:108])
    offset, slope, inter = struct.unpack(end + "3f", raw[108:120])
    if code not in NIFTI_TYPES:
        raise ValueError(f"{path}: data type {code}")
    data = np.frombuffer(raw, end + NIFTI_TYPES[code], int(np.prod(shape)), int(offset)).reshape(shape, order="F")
    if slope not in (0.0, 1.0) or inter != 0.0:
        data = data * (slope or 1.0) + inter
    qform, sform = struct.unpack(end + "2h", raw[252:256])
    if sform > 0:
        affine = np.vstack([np.frombuffer(raw, end + "f4", 12, 280).reshape(3, 4), [0, 0, 0, 1]]).astype(float)
    elif qform > 0:
        b, c, d, x, y, z = struct.unpack(end + "6f", raw[256:280])
        a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
        rot = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        affine = np.eye(4)
        affine[:3, :3], affine[:3, 3] = rot * np.array([pix[1], pix[2], pix[3] * (pix[0] or 1.0)]), (x, y, z)
    else:
        affine = np.diag([pix[1] or 1.0, pix[2] or 1.0, pix[3] or 1.0, 1.0])
    return data, affine


def read_mat(path: str) -> dict[str, object]:
    """Variables of a level 5 file: numeric arrays, strings, and cells as lists; other classes are left out."""
    raw = read_bytes(path)
    if len(raw) < 128 or raw[126:128] not in (b"IM", b"MI"):
        raise ValueError(f"{path}: no MATLAB level 5 file")
    end = "<" if raw[126:128] == b"IM" else ">"

    def element(buf: bytes, at: int) -> tuple[int, bytes, int]:
        kind, size = struct.unpack(end + "II", buf[at : at + 8])
        if kind >> 16:
            return kind & 0xFFFF, buf[at + 4 : at + 4 + (kind >> 16)], at + 8
        step = size if kind == MAT_COMPRESSED else size + (-size % 8)
        return kind, buf[at + 8 : at + 8 + size], at + 8 + step

    def numbers(buf: bytes, at: int) -> tuple[np.ndarray, int]:
        kind, part, at = element(buf, at)
        if kind == 16:
            return np.array([ord(c) for c in part.decode("utf-8")]), at
        if kind == 17:
            return np.frombuffer(part, end + "u2"), at
        return np.frombuffer(part, end + MAT_TYPES[kind]), at

    def matrix(buf: bytes) -> tuple[str, object]:
        _, flags, at = element(buf, 0)
        cls = flags[0] if end == "<" else flags[3]
        complex_ = bool((flags[1] if end == "<" else flags[2]) & 8)
        shape, at = numbers(buf, at)
        _, name, at = element(buf, at)
        shape = tuple(int(x) for x in shape)
        if cls == MAT_CELL:
            items = []
            for _ in range(int(np.prod(shape))):
                _, part, at = element(buf, at)
                items.append(matrix(part)[1] if part else None)
            return name.decode(), items
        if cls in (MAT_STRUCT, MAT_OBJECT, MAT_SPARSE):
            return name.decode(), None
        real, at = numbers(buf, at)
        if cls == MAT_CHAR:
            chars = real.reshape(shape, order="F")
            rows = ["".join(map(chr, r)).rstrip() for r in chars]
            return name.decode(), rows[0] if len(rows) == 1 else rows
        value = real.astype(float).reshape(shape, order="F")
        if complex_:
            value = value + 1j * numbers(buf, at)[0].astype(float).reshape(shape, order="F")
        return name.decode(), value

    out, at = {}, 128
    while at + 8 <= len(raw):
        kind, part, at = element(raw, at)
        if kind == MAT_COMPRESSED:
            kind, part, _ = element(zlib.decompress(part), 0)
        if kind == MAT_MATRIX:
            name, value = matrix(part)
            if value is not None:
                out[name] = value
    return out


class _PerFile(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = sorted(p for pattern in options.get("path", "").split(",") for p in (glob.glob(os.path.join(pattern, "**"), recursive=True) if os.path.isdir(pattern) else glob.glob(pattern)) if os.path.isfile(p))
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.rows(partition.value) if partition.value else iter(())

    def rows(self, path: str) -> Iterator[tuple]:
        raise NotImplementedError


class _NiftiReader(_PerFile):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """A batch of columns for each volume."""
        if not partition.value:
            return
        data, _ = read_nifti(partition.value)
        data = data.reshape(data.shape + (1,) * (4 - data.ndim))
        every = np.indices(data.shape[:3], dtype=np.int32).reshape(3, -1)
        for t in range(data.shape[3]):
            v = np.asarray(data[..., t], float).reshape(-1)
            keep = np.flatnonzero(np.nan_to_num(v, nan=1.0)) if self.options.get("nonzero", "false") == "true" else slice(None)
            v = v[keep]
            yield pa.RecordBatch.from_arrays([pa.array([partition.value] * len(v), pa.string()), *[pa.array(x[keep]) for x in every], pa.array(np.full(len(v), t, np.int32)), pa.array(v)], names=["path", "i", "j", "k", "t", "v"])


class Nifti(DataSource):
    """Cells of images; with option ``nonzero`` only those that are not 0 (NaN is not)."""

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return "path string, i int, j int, k int, t int, v double"

    def reader(self, schema) -> DataSourceReader:
        return _NiftiReader(self.options)


class _MatReader(_PerFile):
    def rows(self, path: str) -> Iterator[tuple]:
        for name, v in read_mat(path).items():
            if isinstance(v, np.ndarray) and not np.iscomplexobj(v):
                m = v.reshape(v.shape[0], -1) if v.ndim else v.reshape(1, 1)
                for (i, j), x in np.ndenumerate(m):
                    yield path, name, i, j, float(x), None
            elif isinstance(v, (str, list)):
                for i, x in enumerate([v] if isinstance(v, str) else v):
                    if isinstance(x, np.ndarray):
                        for (a, b), y in np.ndenumerate(x.reshape(x.shape[0], -1)):
                            yield path, f"{name}[{i}]", a, b, float(y), None
                    elif x is not None:
                        yield path, name, i, 0, None, str(x)


class MatV5(DataSource):
    """Cells of the variables; strings and cells of strings in ``text``, arrays in a cell as ``name[i]``."""

    @classmethod
    def name(cls) -> str:
        return "matv5"

    def schema(self) -> str:
        return "path string, name string, i int, j int, v double, text string"

    def reader(self, schema) -> DataSourceReader:
        return _MatReader(self.options)


class _NpyReader(_PerFile):
    def rows(self, path: str) -> Iterator[tuple]:
        loaded = np.load(path, allow_pickle=False)
        for name, a in ((("", loaded),) if isinstance(loaded, np.ndarray) else loaded.items()):
            for (i, j), x in np.ndenumerate(a.reshape(a.shape[0], -1) if a.ndim else a.reshape(1, 1)):
                yield path, name, i, j, float(x)


class Npy(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, name string, i int, j int, v double"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options)


def register(spark) -> None:
    for source in (Nifti, MatV5, Npy):
        spark.dataSource.register(source)
