"""Tables and matrices as text: label tables, participants, series, matrices, JSON."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import names as N
from loomspan.operators.relational import normalise_participants, unique_or_raise

#: Column names that say what a column holds, in order of preference (fixed values).
ID_NAMES = ("participant_id", "participant", "subjects", "subject_id", "subject", "sub", "id")
GROUP_NAMES = ("group", "diagnosis", "dx", "condition", "cohort")
LABEL_NAMES = {"label_id": ("index", "id", "label", "value", "key"), "name": ("name", "region", "label_name", "roi", "abbreviation"), "hemisphere": ("hemisphere", "hemi"), "network": ("network", "yeo7", "system"), "type": ("type", "structure")}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A TSV or CSV as strings."""
    return spark.read.csv(path, sep="," if path.lower().endswith(".csv") else "\t", header=True)


def read_participants(spark: SparkSession, path: str, id_column: str | None = None, group_column: str | None = None) -> DataFrame:
    """participant_id, group and the other columns; columns found by name, else first and second; ids must be unique."""
    df = read_table(spark, path)
    df = df.toDF(*[c.strip() for c in df.columns])
    by = {c.lower(): c for c in df.columns}
    pick = lambda names: next((by[n] for n in names if n in by), None)
    ids = id_column or pick(ID_NAMES) or df.columns[0]
    group = group_column or pick(GROUP_NAMES) or next((c for c in df.columns if c != ids), None)
    if group is None:
        raise ValueError(f"{path}: no column for the group")
    return unique_or_raise(normalise_participants(df, ids, group), "participant_id")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, n, line: lines with their number, empty ones and comments left out."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("n", "line"))
    return t.where((F.trim("line") != "") & ~F.trim("line").startswith("#"))


def read_label_table(spark: SparkSession, path: str) -> DataFrame:
    """label_id, name, hemisphere, network, type from a table with a header, a colour table (id name R G B A), pairs of
    lines (name, then key and colours) or a list of names (ids from 1)."""
    head = [r["line"] for r in numbered_lines(spark, path).orderBy("n").limit(2).collect()]  # the form shows in two lines
    if not head:
        return spark.createDataFrame([], "label_id int, name string, hemisphere string, network string, type string")
    first = head[0].strip()
    sep = "\t" if "\t" in first else "," if "," in first else None
    cells = [c.strip().lower() for c in first.split(sep)] if sep else []
    lines = numbered_lines(spark, path).withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1)
    none = F.lit(None).cast("string")
    if cells and any(c in LABEL_NAMES["name"] for c in cells):
        at = {k: next((cells.index(n) for n in names if n in cells), None) for k, names in LABEL_NAMES.items()}
        p = F.split("line", sep)
        col = lambda k: F.trim(p[at[k]]) if at[k] is not None else none
        df = lines.where("k > 0").select(F.coalesce(col("label_id").try_cast("int"), F.col("k").cast("int")).alias("label_id"), col("name").alias("name"), col("hemisphere").alias("hemisphere"), col("network").alias("network"), col("type").alias("type"))
    elif first.split()[0].isdigit() and len(first.split()) >= 2:
        p = F.split(F.trim("line"), r"\s+")
        df = lines.select(p[0].cast("int").alias("label_id"), p[1].alias("name"), none.alias("hemisphere"), none.alias("network"), none.alias("type"))
    elif len(head) > 1 and len(head[1].split()) == 5 and all(x.lstrip("-").isdigit() for x in head[1].split()):
        even, odd = lines.where("k % 2 = 0"), lines.where("k % 2 = 1")
        df = even.select((F.col("k") / 2).cast("int").alias("g"), F.trim("line").alias("name")).join(odd.select(((F.col("k") - 1) / 2).cast("int").alias("g"), F.split(F.trim("line"), r"\s+")[0].cast("int").alias("label_id")), "g").select("label_id", "name", none.alias("hemisphere"), none.alias("network"), none.alias("type"))
    else:
        df = lines.select((F.col("k") + 1).cast("int").alias("label_id"), F.trim("line").alias("name"), none.alias("hemisphere"), none.alias("network"), none.alias("type"))
    side = F.upper(F.substring(F.coalesce(F.nullif("hemisphere", F.lit("")), N.hemisphere(F.col("name"))), 1, 1))
    return df.where("label_id > 0").select("label_id", "name", side.alias("hemisphere"), F.coalesce("network", F.lit("")).alias("network"), F.coalesce("type", F.lit("")).alias("type"))


def read_matrix(spark: SparkSession, path: str, n_expected: int | None = None) -> DataFrame:
    """path, i, j, v of text matrices; a first line that is not all numbers is a header. With ``n_expected`` columns a
    matrix that has them as rows is transposed."""
    lines = numbered_lines(spark, path)
    cells = F.transform(F.split(F.trim("line"), r"\s*,\s*|\s+"), lambda x: x.try_cast("double"))
    w = Window.partitionBy("path").orderBy("n")
    parsed = lines.select("path", "n", cells.alias("c")).withColumn("head", (F.row_number().over(w) == 1) & F.exists("c", lambda x: x.isNull()))
    numbered = parsed.where("NOT head").withColumn("i", F.row_number().over(w) - 1)  # before the cells are exploded
    rows = numbered.select("path", "i", F.posexplode("c").alias("j", "v")).where("v IS NOT NULL")
    if n_expected is None:
        return rows
    size = rows.groupBy("path").agg((F.max("i") + 1).alias("ni"), (F.max("j") + 1).alias("nj"))
    flip = (F.col("nj") != n_expected) & (F.col("ni") == n_expected)
    return rows.join(size, "path").select("path", F.when(flip, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(flip, F.col("i")).otherwise(F.col("j")).alias("j"), "v")


def read_parcel_map(spark: SparkSession, path: str, parcels: DataFrame) -> DataFrame:
    """pos, value: the values of a table joined to parcels (pos, label_id, name) by id or by name; ``n/a`` is missing."""
    df = read_table(spark, path)
    by = {c.lower(): c for c in df.columns}
    value = F.col(f"`{df.columns[-1]}`").try_cast("double").alias("value")
    key = next((by[k] for k in ("index", "label_id", "id") if k in by), None)
    if key:
        return parcels.join(df.select(F.col(f"`{key}`").try_cast("int").alias("label_id"), value), "label_id", "left").select("pos", "value")
    return parcels.join(df.select(F.trim(F.col(f"`{by.get('name', df.columns[0])}`")).alias("name"), value), "name", "left").select("pos", "value")


def number_text(v: float | None, digits: int) -> str:
    return "n/a" if v is None or math.isnan(v) else f"%.{digits}g" % v


def write_matrices(matrices: DataFrame, target: str, digits: int = 8) -> None:
    """matrix_id, i, j, v -> one TSV of rows for each matrix, cells with ``digits`` significant digits."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"matrix_id": b["matrix_id"], "i": b["i"], "line": ["\t".join(number_text(x["v"], digits) for x in c) for c in b["cells"]]})

    packed = matrices.groupBy("matrix_id", "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("cells"))  # a row of a matrix
    lines = packed.mapInPandas(rows, "matrix_id string, i int, line string")
    lines.repartition("matrix_id").sortWithinPartitions("matrix_id", "i").select("matrix_id", "line").write.mode("overwrite").partitionBy("matrix_id").text(target)


def write_series(panel: DataFrame, target: str, digits: int = 6) -> None:
    """participant, node, t, x -> a TSV of volumes for each participant."""
    write_matrices(panel.select(F.col("participant").cast("string").alias("matrix_id"), F.col("t").cast("int").alias("i"), F.col("node").alias("j"), F.col("x").alias("v")), target, digits)


def json_text(value: object) -> str:
    """JSON in which numbers that are none are null."""

    def plain(v: object) -> object:
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if hasattr(v, "tolist"):
            return plain(v.tolist())
        return None if isinstance(v, float) and not math.isfinite(v) else v

    return json.dumps(plain(value), indent=2)
