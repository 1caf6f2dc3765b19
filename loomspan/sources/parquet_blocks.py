"""Consolidation of Parquet files by copying their encoded blocks.

The column chunks of a file's row groups go byte by byte into a larger file, whose footer is written anew with their
places; no page is decoded. Only the footers (Thrift compact protocol) are read. Schema, number of blocks, rows and bytes
are validated before a merged file gets its name. What decoding would bring is not to be had: row groups keep their size.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"PAR1"
#: Type codes of the compact protocol (fixed values).
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)
#: Field numbers of the format's footer (fixed values).
SCHEMA, ROWS, GROUPS, KEY_VALUES = 2, 3, 4, 5
G_COLUMNS, G_ROWS, G_OFFSET, G_ORDINAL = 1, 3, 5, 7
C_FILE_OFFSET, C_META, C_INDEXES = 2, 3, (4, 5, 6, 7)
M_CODEC, M_SIZE, M_DATA, M_INDEX, M_DICTIONARY, M_BLOOM = 4, 7, 9, 10, 11, (14, 15)


class Reader:
    """Structs as {field: (type, value)}, lists as (element type, values)."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def byte(self) -> int:
        self.at += 1
        return self.raw[self.at - 1]

    def varint(self) -> int:
        n = shift = 0
        while True:
            b = self.byte()
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    def number(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (TRUE, FALSE):
            return kind == TRUE
        if kind == BYTE:
            return self.byte()
        if kind in (I16, I32, I64):
            return self.number()
        if kind == DOUBLE:
            self.at += 8
            return self.raw[self.at - 8 : self.at]
        if kind == BINARY:
            n = self.varint()
            self.at += n
            return self.raw[self.at - n : self.at]
        if kind in (LIST, SET):
            head = self.byte()
            n, of = head >> 4, head & 15
            n = self.varint() if n == 15 else n
            return of, [(self.byte() == TRUE) if of in (TRUE, FALSE) else self.value(of) for _ in range(n)]
        if kind == STRUCT:
            return self.struct()
        raise ValueError(f"type {kind} in a footer")

    def struct(self) -> dict[int, tuple]:
        out, field = {}, 0
        while (head := self.byte()) != 0:
            field = field + (head >> 4) if head >> 4 else self.number()
            out[field] = (head & 15, self.value(head & 15))
        return out


class Writer:
    def __init__(self) -> None:
        self.raw = bytearray()

    def varint(self, n: int) -> None:
        while n > 127:
            self.raw.append(n & 127 | 128)
            n >>= 7
        self.raw.append(n)

    def value(self, kind: int, v) -> None:
        if kind == BYTE:
            self.raw.append(v)
        elif kind in (I16, I32, I64):
            self.varint(v << 1 if v >= 0 else (-v << 1) - 1)
        elif kind == DOUBLE:
            self.raw += v
        elif kind == BINARY:
            self.varint(len(v))
            self.raw += v
        elif kind in (LIST, SET):
            of, items = v
            self.raw.append((min(len(items), 15) << 4) | of)
            if len(items) >= 15:
                self.varint(len(items))
            for x in items:
                if of in (TRUE, FALSE):
                    self.raw.append(TRUE if x else FALSE)
                else:
                    self.value(of, x)
        elif kind == STRUCT:
            self.struct(v)

    def struct(self, fields: dict[int, tuple]) -> None:
        last = 0
        for field in sorted(fields):
            kind, v = fields[field]
            if kind in (TRUE, FALSE):
                kind = TRUE if v else FALSE
            if 0 < field - last < 16:
                self.raw.append((field - last) << 4 | kind)
            else:
                self.raw.append(kind)
                self.value(I16, field)
            if kind not in (TRUE, FALSE):
                self.value(kind, v)
            last = field
        self.raw.append(0)


def read_footer(path: str) -> dict[int, tuple]:
    with open(path, "rb") as f:
        f.seek(0, os.SEEK_END)
        size = f.tell()
        if size < 12:
            raise ValueError(f"{path}: too short for a Parquet file")
        f.seek(size - 8)
        n, magic = struct.unpack("<I4s", f.read(8))
        if magic != MAGIC or n > size - 12:
            raise ValueError(f"{path}: no Parquet footer")
        f.seek(size - 8 - n)
        return Reader(f.read(n)).struct()


def fingerprint(footer: dict[int, tuple]) -> str:
    """Hash of the schema: files of equal fingerprint can share a footer."""
    w = Writer()
    w.value(*footer[SCHEMA])
    return hashlib.sha256(w.raw).hexdigest()[:16]


def _moved(group: dict, src, out) -> dict:
    """A row group whose chunks are copied from src to the end of out."""
    columns = []
    for chunk in group[G_COLUMNS][1][1]:
        meta = dict(chunk[C_META][1])
        places = [meta[k][1] for k in (M_DICTIONARY, M_DATA, M_INDEX) if k in meta and meta[k][1] > 0]
        start, size, to = min(places), meta[M_SIZE][1], out.tell()
        src.seek(start)
        left = size
        while left:
            part = src.read(min(left, 1 << 22))
            if not part:
                raise ValueError("a column chunk ends early")
            out.write(part)
            left -= len(part)
        for k in (M_DICTIONARY, M_DATA, M_INDEX):
            if k in meta and meta[k][1] > 0:
                meta[k] = (I64, meta[k][1] - start + to)
        for k in M_BLOOM:
            meta.pop(k, None)
        new = {k: v for k, v in chunk.items() if k not in C_INDEXES}
        columns.append(new | {C_META: (STRUCT, meta), C_FILE_OFFSET: (I64, 0 if chunk.get(C_FILE_OFFSET, (I64, 0))[1] == 0 else to)})
    first = columns[0][C_META][1]
    place = min(first[k][1] for k in (M_DICTIONARY, M_DATA) if k in first and first[k][1] > 0)
    return dict(group) | {G_COLUMNS: (LIST, (STRUCT, columns)), G_OFFSET: (I64, place)}


def merge_files(paths: list[str], target: str) -> dict[str, int]:
    """One file of the row groups of all, in order; written beside its place and renamed when it is valid."""
    footers = [read_footer(p) for p in paths]
    if len({fingerprint(f) for f in footers}) > 1:
        raise ValueError("files of different schemas")
    groups, temp = [], f"{target}.part-{os.getpid()}"
    try:
        with open(temp, "wb") as out:
            out.write(MAGIC)
            for p, f in zip(paths, footers):
                with open(p, "rb") as src:
                    groups += [_moved(g, src, out) for g in f[GROUPS][1][1]]
            for k, g in enumerate(groups):
                if k < 32768:
                    g[G_ORDINAL] = (I16, k)
                else:
                    g.pop(G_ORDINAL, None)
            rows = sum(f[ROWS][1] for f in footers)
            w = Writer()
            w.struct(dict(footers[0]) | {ROWS: (I64, rows), GROUPS: (LIST, (STRUCT, groups))})
            out.write(w.raw + struct.pack("<I", len(w.raw)) + MAGIC)
        check = read_footer(temp)
        blocks = sum(len(f[GROUPS][1][1]) for f in footers)
        if fingerprint(check) != fingerprint(footers[0]) or len(check[GROUPS][1][1]) != blocks or sum(g[G_ROWS][1] for g in check[GROUPS][1][1]) != rows:
            raise ValueError("the merged footer does not agree with its parts")
        os.replace(temp, target)
    finally:
        if os.path.exists(temp):
            os.remove(temp)
    return {"n_files": len(paths), "n_blocks": blocks, "n_rows": rows, "n_bytes": os.path.getsize(target)}


def compact(spark: SparkSession, source: str, target: str, target_bytes: int = 256 * 1024 * 1024) -> DataFrame:
    """Merge the Parquet files below a folder (on a file system that all executors share) into few files below another.

    Listing, footers and copying are distributed; files are packed by size within buckets of a hash of their path, one
    schema a file. A row per merged file; a file that is no Parquet file is a row with its error and stays where it is."""
    os.makedirs(target, exist_ok=True)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(source).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"))

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, size in b.itertuples(index=False):
                try:
                    out.append((path, size, fingerprint(read_footer(path)), None))
                except (ValueError, OSError, IndexError) as e:
                    out.append((path, size, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "size", "schema", "error"])

    files = listed.mapInPandas(heads, "path string, size bigint, schema string, error string")
    total = listed.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, total // (16 * target_bytes))
    w = Window.partitionBy("schema", "bucket").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    packed = files.where("error IS NULL").withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets))).withColumn("bin", F.floor(F.coalesce(F.sum("size").over(w), F.lit(0)) / target_bytes))
    bins = packed.groupBy("schema", "bucket", "bin").agg(F.sort_array(F.collect_list("path")).alias("paths"))  # paths of one target file

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for schema, bucket, k, paths in b.itertuples(index=False):
                to = os.path.join(target, f"part-{schema}-{bucket:05d}-{k:05d}.parquet")
                try:
                    m = merge_files(list(paths), to)
                    out.append((to, m["n_files"], m["n_blocks"], m["n_rows"], m["n_bytes"], None))
                except (ValueError, OSError) as e:
                    out.append((to, len(paths), None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "n_files", "n_blocks", "n_rows", "n_bytes", "error"])

    columns = "path string, n_files bigint, n_blocks bigint, n_rows bigint, n_bytes bigint, error string"
    merged = bins.mapInPandas(write, columns)
    return merged.unionByName(files.where("error IS NOT NULL").select("path", F.lit(1).cast("bigint").alias("n_files"), *[F.lit(None).cast("bigint").alias(c) for c in ("n_blocks", "n_rows", "n_bytes")], "error"))
