"""Folders of test tables with nulls in every column, further columns whose names the operators use, repeated rows; and of empty tables."""

import glob
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

CLASHES = ("rec_id", "mask", "key", "place", "word", "n", "k", "t", "block", "bin", "series", "fields", "kinds", "rate", "copies", "ids", "n_tokens", "month", "ns", "pos", "rng", "col", "tbl", "v0", "src", "field", "shape", "fits", "side", "how")


def damaged(source: str, target: str, share: float = 0.1) -> str:
    os.makedirs(target, exist_ok=True)
    rng = np.random.default_rng(0)
    for f in glob.glob(f"{source}/*.parquet"):
        t = pq.read_table(f)
        cols = {n: pa.array([None if rng.random() < share else v for v in t.column(n).to_pylist()], t.schema.field(n).type) for n in t.column_names}
        cols |= {c: pa.array(rng.integers(0, 9, t.num_rows)) for c in CLASHES if c not in cols}
        out = pa.table(cols)
        pq.write_table(pa.concat_tables([out, out.slice(0, out.num_rows // 3)]), f"{target}/{os.path.basename(f)}")
    return target


def emptied(source: str, target: str) -> str:
    os.makedirs(target, exist_ok=True)
    for f in glob.glob(f"{source}/*.parquet"):
        pq.write_table(pq.read_table(f).slice(0, 0), f"{target}/{os.path.basename(f)}")
    return target
