"""References to records that do not exist (problem 1).

Keys are dictionary-encoded as integers (key range, position), each key range and month gets a compressed bitmap of the
keys that are referred to and one of the keys whose parent is in force during the whole month. Reference AND-NOT parent
leaves the bits that can hold an orphan; they are decoded to (key, month) and only the references there are compared with
the parents that begin or end within that month.

Defined results: a null reference is no case; a reference without a time is a case (no parent is known to be in force at
an unknown time); repeated rows count once, also where deliveries of one record differ; a parent without a key or a
start is never in force; an empty parent table makes every reference an orphan. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.session import cut, strip_outer, table

BITS = 32_768  # bits of one bitmap as bitmap_construct_agg makes it
RANGE_KEYS = 16_384  # keys aimed at in a key range; fuller ranges go on in a further bitmap
NO_MONTH = -1_000_000  # month of references without a time

#: Group labels that say there is no group (fixed values).
NULL_LIKE = ("", "n/a", "na", "nan", "none", "null")


def subject_key(c: Column) -> Column:
    """Outer white space off, ``sub-`` put before labels that lack it; null stays null."""
    s = strip_outer(c)
    return F.when(s.startswith("sub-"), s).otherwise(F.concat(F.lit("sub-"), s))


def group_key(c: Column) -> Column:
    """Outer white space off; null and null-like labels become null."""
    s = strip_outer(c)
    return F.when(~F.lower(s).isin(*NULL_LIKE), s)


def month_of(ts: Column) -> Column:
    """Months since year 0; the period of the bitmaps."""
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def _pack(raw: bytes | None) -> bytes | None:
    """Container of a bitmap: sorted 16-bit positions while few bits are set, else the deflated bitmap."""
    if raw is None:
        return None
    at = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")).astype("<u2")
    return b"A" + at.tobytes() if len(at) <= 1024 else b"B" + zlib.compress(raw, 1)


def _unpack(packed: bytes) -> np.ndarray:
    if packed[:1] == b"A":
        bits = np.zeros(BITS, np.uint8)
        bits[np.frombuffer(packed, "<u2", offset=1)] = 1
        return np.packbits(bits, bitorder="little")
    return np.frombuffer(zlib.decompress(packed[1:]), np.uint8)


@F.pandas_udf(T.BinaryType())
def pack_bitmap(raw: pd.Series) -> pd.Series:
    return raw.map(_pack)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def and_not(ref: pd.Series, parent: pd.Series) -> pd.Series:
    """Positions of the bits set in ref and not in parent (parent null: none is set)."""
    out = []
    for a, b in zip(ref, parent):
        bits = _unpack(a)
        if b is not None:
            bits = bits & ~_unpack(b)
        out.append(np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype(np.int32))
    return pd.Series(out)


def dictionary(keys: DataFrame) -> DataFrame:
    """Integers for distinct (ns, key): columns ns, key, rng, pos with pos < BITS. Ranges are hash ranges of the key, so
    they stay even however skewed the references are; a range with more than BITS keys goes on in a further bitmap."""
    n = keys.count()
    ranges = max(1, -(-n // RANGE_KEYS))
    slot = F.pmod(F.xxhash64("ns", "key"), F.lit(ranges)).cast("int")
    w = Window.partitionBy("ns", "slot").orderBy("key")
    return (
        keys.withColumn("slot", slot)
        .withColumn("n", F.row_number().over(w) - 1)
        .select("ns", "key", (F.col("slot").cast("long") + F.floor(F.col("n") / BITS) * ranges).alias("rng"), (F.col("n") % BITS).cast("int").alias("pos"))
    )


def bitmaps(bits: DataFrame) -> DataFrame:
    """ns, rng, month, pos -> one packed bitmap for each ns, rng and month."""
    return (
        bits.groupBy("ns", "rng", "month")
        .agg(F.bitmap_construct_agg(F.col("pos").cast("long")).alias("raw"))
        .select("ns", "rng", "month", pack_bitmap("raw").alias("bits"))
    )


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of ``refs`` (tbl, rec_id, field, ns, key, ts) without a row of ``parents`` (ns, key, start, stop) with the same
    ns and key, start <= ts and stop null or > ts. The result is distinct and adds the month."""
    refs = (
        refs.where(F.col("key").isNotNull())
        .select("tbl", "rec_id", "field", "ns", "key", "ts", F.coalesce(month_of(F.col("ts")), F.lit(NO_MONTH)).alias("month"))
        .distinct()
    )
    refs = cut(refs)
    parents = parents.where(F.col("key").isNotNull() & F.col("start").isNotNull()).where(F.col("stop").isNull() | (F.col("stop") > F.col("start"))).select("ns", "key", "start", "stop").distinct()
    # at most 12 months a year between the years 1 and 9999: a bounded list
    months = sorted(r[0] for r in refs.select("month").distinct().collect() if r[0] != NO_MONTH)
    whole_from = month_of(F.col("start")) + F.when(F.col("start") == F.date_trunc("month", "start"), 0).otherwise(1)
    whole_to = F.when(F.col("stop").isNull(), F.lit(10**7)).otherwise(month_of(F.col("stop")) - 1)
    listed = F.array(*[F.lit(m) for m in months]).cast("array<int>")
    whole = (
        parents.select("ns", "key", whole_from.alias("a"), whole_to.alias("b"))
        .where(F.col("a") <= F.col("b"))
        .select("ns", "key", F.explode(F.filter(listed, lambda m: (m >= F.col("a")) & (m <= F.col("b")))).alias("month"))
        .distinct()
    )
    asked = refs.select("ns", "key", "month").distinct()
    codes = cut(dictionary(asked.select("ns", "key").distinct()))
    ref_bits = bitmaps(asked.join(codes, ["ns", "key"]))
    parent_bits = bitmaps(whole.join(codes, ["ns", "key"])).withColumnRenamed("bits", "parent_bits")
    left = (
        ref_bits.join(parent_bits, ["ns", "rng", "month"], "left")
        .select("ns", "rng", "month", F.explode(and_not("bits", "parent_bits")).alias("pos"))
        .join(codes, ["ns", "rng", "pos"])
        .select("ns", "key", "month")
    )
    suspects = refs.join(left, ["ns", "key", "month"], "left_semi")
    # parents that begin or end within the month: at most two rows for each parent
    edges = parents.select("ns", "key", "start", "stop", F.explode(F.array_distinct(F.array(month_of(F.col("start")), F.coalesce(month_of(F.col("stop")), month_of(F.col("start")))))).alias("month")).alias("p")
    s = suspects.alias("s")
    in_force = (
        (F.col("s.ns") == F.col("p.ns")) & (F.col("s.key") == F.col("p.key")) & (F.col("s.month") == F.col("p.month"))
        & (F.col("p.start") <= F.col("s.ts")) & (F.col("p.stop").isNull() | (F.col("p.stop") > F.col("s.ts")))
    )
    return s.join(edges, in_force, "left_anti")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "participants")
    f = table(spark, sf_dir, "timeseries_files")
    b = table(spark, sf_dir, "bold_runs")

    def of(df: DataFrame, tbl: str, rec: str, field: str, ns: str, key: Column, ts: str) -> DataFrame:
        return df.select(F.lit(tbl).alias("tbl"), F.col(rec).cast("long").alias("rec_id"), F.lit(field).alias("field"), F.lit(ns).alias("ns"), key.alias("key"), F.col(ts).alias("ts"))

    return (
        of(p, "participants", "record_no", "group", "group", group_key(F.col("group")), "registered_at")
        .unionByName(of(f, "timeseries_files", "file_id", "sub", "sub", subject_key(F.col("sub")), "written_at"))
        .unionByName(of(b, "bold_runs", "run_id", "sub", "sub", subject_key(F.col("sub")), "made_at"))
    )


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "participants")
    c = table(spark, sf_dir, "cohorts")
    return p.select(F.lit("sub").alias("ns"), subject_key(F.col("participant_id")).alias("key"), F.col("registered_at").alias("start"), F.col("withdrawn_at").alias("stop")).unionByName(
        c.select(F.lit("group").alias("ns"), strip_outer(F.col("group_name")).alias("key"), F.col("opened_at").alias("start"), F.col("closed_at").alias("stop"))
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(references(spark, sf_dir), parents(spark, sf_dir)).select("tbl", "rec_id", "field").distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and orphans for each table, field and month (null: records without a time)."""
    refs = references(spark, sf_dir)
    period = F.date_format(F.date_trunc("month", F.col("ts")), "yyyy-MM").alias("month")
    total = refs.where(F.col("key").isNotNull()).select("tbl", "rec_id", "field", period).distinct().groupBy("tbl", "field", "month").agg(F.count("*").alias("n_refs"))
    bad = orphan_references(refs, parents(spark, sf_dir)).select("tbl", "rec_id", "field", period).distinct().groupBy("tbl", "field", "month").agg(F.count("*").alias("n_orphans"))
    b = bad.alias("b")
    t = total.alias("t")
    same = (F.col("t.tbl") == F.col("b.tbl")) & (F.col("t.field") == F.col("b.field")) & F.col("t.month").eqNullSafe(F.col("b.month"))
    return t.join(b, same, "left").select("t.tbl", "t.field", "t.month", "t.n_refs", F.coalesce("b.n_orphans", F.lit(0)).alias("n_orphans"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}

_SQL_REFS = r"""
refs AS (
  SELECT 'participants' AS tbl, record_no AS rec_id, 'group' AS field, 'group' AS ns, trim("group", E' \t\n\r') AS key, registered_at AS ts
  FROM participants WHERE lower(trim("group", E' \t\n\r')) NOT IN ('', 'n/a', 'na', 'nan', 'none', 'null')
  UNION SELECT 'timeseries_files', file_id, 'sub', 'sub',
    CASE WHEN starts_with(trim(sub, E' \t\n\r'), 'sub-') THEN trim(sub, E' \t\n\r') ELSE 'sub-' || trim(sub, E' \t\n\r') END, written_at FROM timeseries_files WHERE sub IS NOT NULL
  UNION SELECT 'bold_runs', run_id, 'sub', 'sub',
    CASE WHEN starts_with(trim(sub, E' \t\n\r'), 'sub-') THEN trim(sub, E' \t\n\r') ELSE 'sub-' || trim(sub, E' \t\n\r') END, made_at FROM bold_runs WHERE sub IS NOT NULL),
parents AS (
  SELECT 'sub' AS ns, CASE WHEN starts_with(trim(participant_id, E' \t\n\r'), 'sub-') THEN trim(participant_id, E' \t\n\r') ELSE 'sub-' || trim(participant_id, E' \t\n\r') END AS key,
    registered_at AS a, withdrawn_at AS b FROM participants
  UNION ALL SELECT 'group', trim(group_name, E' \t\n\r'), opened_at, closed_at FROM cohorts),
bad AS (SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.ns = r.ns AND p.key = r.key AND p.a <= r.ts AND (p.b IS NULL OR p.b > r.ts)))
"""
SQL = {
    "p1_found": f"WITH {_SQL_REFS} SELECT DISTINCT tbl, rec_id, field FROM bad",
    "p1_report": f"""WITH {_SQL_REFS},
t AS (SELECT tbl, field, strftime(ts, '%Y-%m') AS month, count(DISTINCT rec_id) AS n_refs FROM refs GROUP BY ALL),
o AS (SELECT tbl, field, strftime(ts, '%Y-%m') AS month, count(DISTINCT rec_id) AS n_orphans FROM bad GROUP BY ALL)
SELECT t.tbl, t.field, t.month, t.n_refs, coalesce(o.n_orphans, 0) AS n_orphans
FROM t LEFT JOIN o ON t.tbl = o.tbl AND t.field = o.field AND t.month IS NOT DISTINCT FROM o.month""",
}
