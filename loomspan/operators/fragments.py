"""Far too many small files (problem 4): consolidation of time-series fragments.

Each fragment gets a footer (series, columns, first and last volume, number of volumes, a bitmap of its volumes in blocks
of 64). Fragments that share no volume with another are compatible blocks: their encoded lines are copied as they stand.
Only fragments that overlap (found on the footers, never on the values) lose the volumes that another one gives, so that
each volume comes out once. Overlaps are found without pairs: a block of 64 volumes is contested if its fragments have
more volumes than their union. Places in the files are computed from the footers too; the bodies move once to meet them
and once into their files. The totals are validated against the footers. The merged blocks of all series are packed one
after another into files of the target size, each with a footer that says where the volumes of a series and sidecar stand.

Text lines stand in for the column chunks of a columnar file here, because the fragments are rows with a text body;
:mod:`loomspan.sources.parquet_blocks` does the same on real Parquet files, copying row groups byte by byte.

Defined results: a fragment with a null path or a file name without a subject belongs to no series and is in no pair; a
null, empty or header-only body holds no volume; lines whose first cell is no whole number are no volumes; repeated
deliveries of a frag_id count once; of a volume that came with different values the last modified one stays (ties: the
least frag_id); a volume keeps the sidecar of the fragment it came from, as it is written (null stays null).
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.session import checkpoint_dir, cut, table
from loomspan.sources import parquet_blocks

ENTITIES = ("sub", "ses", "task", "run", "feature", "atlas")
TARGET_BYTES = 64 * 1024 * 1024  # size aimed at for a merged file
BUCKETS = 4096  # groups of series whose bytes are summed in one task
STRETCH = 4096  # volumes whose bytes are summed in one task
SMALL_FILES, FRAGMENTS_A_FILE = 64, 256  # p4_files starts from a file for each so many fragments, and so many files at least


def series_key(path: Column) -> Column:
    """``sub|ses|task|run|feature|atlas`` of the file name; folders, separators, order, chunk and ending do not matter.
    Null for a null path or a name without sub."""
    name = F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)
    name = F.regexp_replace(name, r"\.[^/]*$", "")
    part = lambda k: F.regexp_extract(name, rf"(?:^|_){k}-([^_]*)", 1)
    return F.when(part("sub") != "", F.concat_ws("|", *[part(k) for k in ENTITIES]))


def lines_of(body: Column) -> Column:
    """Array of structs (t, line): the lines of a body that hold a volume; any line ending, header or not."""
    cell = lambda x: F.trim(F.substring_index(x, "\t", 1)).try_cast("double")
    rows = F.transform(F.split(F.coalesce(body, F.lit("")), r"\r\n|\n|\r"), lambda x: F.struct(cell(x).alias("v"), x.alias("line")))
    kept = F.filter(rows, lambda r: r["v"].isNotNull() & ~F.isnan(r["v"]) & (r["v"] == F.floor(r["v"])) & (F.abs(r["v"]) < 9e15))
    return F.transform(kept, lambda r: F.struct(r["v"].cast("long").alias("t"), r["line"].alias("line")))


def footers(fragments: DataFrame) -> DataFrame:
    """One row per fragment of a series: frag_id, series, modified_at, ts (its volumes, none maybe), n_inner."""
    f = fragments.select("frag_id", series_key(F.col("path")).alias("series"), "modified_at", "body").where("series IS NOT NULL")
    f = f.select("frag_id", "series", "modified_at", F.transform(lines_of(F.col("body")), lambda r: r["t"]).alias("all"))  # bodies are parsed once: nothing filters on the result
    f = f.withColumn("ts", F.array_sort(F.array_distinct("all")))
    return f.select("frag_id", "series", "modified_at", "ts", (F.size("all") - F.size("ts")).alias("n_inner"))


def volume_blocks(foot: DataFrame) -> DataFrame:
    """frag_id, series, block, bits: the volumes of a fragment as 64-bit maps, a row for each block of 64 it touches."""
    t = foot.select("frag_id", "series", F.explode("ts").alias("t"))
    return t.groupBy("series", "frag_id", F.floor(F.col("t") / 64).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(t, 64) as int))")).alias("bits"))


def overlapping(foot: DataFrame) -> DataFrame:
    """Pairs frag_lo < frag_hi of one series with a volume in common. Keyed by series and block, so a series however
    large spreads over its blocks; the pairs themselves are the result asked for."""
    b = volume_blocks(foot)
    a = b.select("series", "block", F.col("frag_id").alias("frag_lo"), F.col("bits").alias("bits_lo"))
    z = b.select("series", "block", F.col("frag_id").alias("frag_hi"), F.col("bits").alias("bits_hi"))
    hit = a.join(z, ["series", "block"]).where((F.col("frag_lo") < F.col("frag_hi")) & (F.col("bits_lo").bitwiseAND(F.col("bits_hi")) != 0))
    return hit.select("frag_lo", "frag_hi").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlapping(footers(table(spark, sf_dir, "ts_fragments")).dropDuplicates(["frag_id"]))


def with_lines(df: DataFrame) -> DataFrame:
    """``raw``: the lines of a body as they stand; ``rows``: by volume, one of each (of several the least). A column each,
    as an expression inside a lambda is evaluated for every element."""
    df = df.withColumn("raw", lines_of(F.col("body"))).drop("body").withColumn("sorted", F.array_sort("raw"))
    rows = F.col("sorted")
    return df.withColumn("rows", F.filter(rows, lambda r, i: (i == 0) | (F.get(rows, i - 1)["t"] != r["t"]))).drop("sorted")


def lost_volumes(foot: DataFrame) -> DataFrame:
    """frag_id, block, lost for the fragments that share a volume: those of its volumes (64-bit maps) that come from another
    one, which was modified later (ties: the least frag_id). Contested blocks show in sums and unions that fold before the shuffle, the winner of a
    volume in a minimum, so no deliveries of a series are paired or gathered."""
    b = volume_blocks(foot)
    contested = b.groupBy("series", "block").agg(F.sum(F.bit_count("bits")).alias("n"), F.bit_count(F.bit_or("bits")).alias("d")).where("n > d").select("series", "block")
    rank = F.struct(F.col("modified_at").isNull().alias("none"), (-F.unix_micros(F.col("modified_at").cast("timestamp"))).alias("age"), F.col("frag_id"))
    order = foot.select("frag_id", rank.alias("rank"))
    claims = b.join(contested, ["series", "block"], "left_semi").join(order, "frag_id")
    claims = claims.select("series", "block", "frag_id", "rank", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("bits", k) == 1)).alias("k"))
    best = claims.groupBy("series", "block", "k").agg(F.min("rank").alias("best"), F.count("*").alias("n")).where("n > 1")
    held = claims.join(best, ["series", "block", "k"]).withColumn("bit", F.when(F.col("frag_id") == F.col("best.frag_id"), F.lit(0)).otherwise(F.expr("shiftleft(1L, k)")))
    return held.groupBy("frag_id", "block").agg(F.bit_or("bit").alias("lost"))


def consolidate(fragments: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Pieces of the merged files: file, series, sidecar, start (bytes before it in all files), first_t, last_t, n_volumes,
    n_blocks, n_copied, n_bytes, body (lines by volume).

    A block is what a fragment gives to a stretch of volumes of its series. All blocks stand in one order (series by hash,
    sidecar, volume), which is cut into files every ``target_bytes``: small series share a file, a large one goes over
    several."""
    stretch_of = lambda t: F.floor(t / STRETCH)
    keyed = fragments.select("frag_id", series_key(F.col("path")).alias("series"), "sidecar", "modified_at", "body").where("series IS NOT NULL")
    narrow = with_lines(keyed).select("frag_id", "series", "sidecar", "modified_at", F.transform("rows", lambda r: F.struct(r["t"].alias("t"), (F.octet_length(r["line"]) + 1).alias("b"))).alias("ls"))
    foot = cut(narrow.dropDuplicates(["frag_id"])).where(F.size("ls") > 0)
    lost = cut(lost_volumes(foot.select("frag_id", "series", "modified_at", F.transform("ls", lambda r: r["t"]).alias("ts"))))
    marked = foot.join(lost.select("frag_id", F.lit(True).alias("contested")).distinct(), "frag_id", "left")
    # a row for each fragment and stretch: its first volume and bytes. Places need short keys only: series or sidecars of
    # equal hash would stand mixed in a file, as pieces of their own
    marked = marked.select("frag_id", F.xxhash64("series").alias("s"), F.xxhash64("sidecar").alias("c"), "ls", "contested")
    part = lambda df: df.groupBy("frag_id", "s", "c", "stretch").agg(F.min("t").alias("t"), F.sum("b").cast("long").alias("bytes"))
    rows = lambda df: df.select("frag_id", "s", "c", F.explode("ls").alias("r")).select("frag_id", "s", "c", "r.t", "r.b").withColumn("stretch", stretch_of(F.col("t")))
    ends = (stretch_of(F.col("ls")[0]["t"]), stretch_of(F.element_at("ls", -1)["t"]))
    free = F.col("contested").isNull()
    whole = marked.where(free & (ends[0] == ends[1])).select("frag_id", "s", "c", ends[0].alias("stretch"), F.col("ls")[0]["t"].alias("t"), F.aggregate("ls", F.lit(0).cast("long"), lambda s, r: s + r["b"]).alias("bytes"))
    others = rows(marked.where(free & (ends[0] != ends[1])))
    kept = rows(marked.where("contested")).withColumn("block", F.floor(F.col("t") / 64)).join(lost, ["frag_id", "block"], "left").where(F.expr("coalesce(getbit(lost, cast(pmod(t, 64) as int)), 0) = 0"))
    blocks = cut(whole.unionByName(part(others)).unionByName(part(kept)))
    # bytes before a block: those of the buckets before its own, of the stretches of volumes before its own within the
    # bucket, then those within the stretch
    stretch, bucket = ["s", "c", "stretch"], F.pmod("s", F.lit(BUCKETS)).alias("bucket")
    before = lambda w: F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = blocks.groupBy(*stretch).agg(F.sum("bytes").alias("bytes")).select("*", bucket)
    buckets = sums.groupBy("bucket").agg(F.sum("bytes").alias("bytes")).select("bucket", before(Window.partitionBy(F.lit(1)).orderBy("bucket")).alias("first"))  # BUCKETS rows at most
    bases = sums.withColumn("base", before(Window.partitionBy("bucket").orderBy(*stretch))).join(buckets, "bucket").select(*stretch, (F.col("first") + F.col("base")).alias("base"))
    inner = blocks.withColumn("inner", before(Window.partitionBy(*stretch).orderBy("t", "frag_id")))  # what is kept of a stretch: a block for each volume at most
    placed = inner.join(bases, stretch).withColumn("start", F.col("base") + F.col("inner")).select("frag_id", F.struct("stretch", "start", F.floor(F.col("start") / target_bytes).alias("file")).alias("p"))
    places = placed.groupBy("frag_id").agg(F.collect_list("p").alias("places"))  # a row for each stretch of a fragment
    gone = lost.groupBy("frag_id").agg(F.map_from_entries(F.collect_list(F.struct("block", "lost"))).alias("gone"))  # a row for each block of 64 volumes of a fragment
    # the bodies meet their places by fragment, then their files
    body = with_lines(keyed.drop("modified_at").dropDuplicates(["frag_id"]).join(places, "frag_id").join(gone, "frag_id", "left"))
    left = F.when(F.col("gone").isNull(), F.col("rows")).otherwise(F.filter("rows", lambda r: F.coalesce(F.getbit(F.try_element_at("gone", F.floor(r["t"] / 64)), F.pmod(r["t"], F.lit(64)).cast("int")), F.lit(0)) == 0))
    copied = (F.col("gone").isNull() & (F.col("raw") == F.col("rows"))).cast("int")
    given = body.select("series", "sidecar", left.alias("rows"), copied.alias("copied"), "places").select("series", "sidecar", "copied", "rows", F.explode("places").alias("p"))
    given = given.select("series", "sidecar", "copied", "p.file", "p.start", F.filter("rows", lambda r: stretch_of(r["t"]) == F.col("p.stretch")).alias("rows"))
    given = given.select("file", "series", "sidecar", "start", "copied", F.col("rows")[0]["t"].alias("t"), F.element_at("rows", -1)["t"].alias("end"), F.size("rows").cast("long").alias("n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("block"))
    pieces = given.repartition("file").groupBy("file", "series", "sidecar").agg(
        F.min("start").alias("start"), F.min("t").alias("first_t"), F.max("end").alias("last_t"), F.sum("n").alias("n_volumes"), F.count("*").alias("n_blocks"), F.sum("copied").cast("long").alias("n_copied"),
        F.sum(F.octet_length("block") + 1).alias("n_bytes"), F.array_sort(F.collect_list(F.struct("start", "t", "end", "block"))).alias("blocks"),
    )
    # blocks whose volumes interleave are sorted line by line
    in_order = F.forall(F.transform("blocks", lambda b, i: (i == 0) | (F.get(F.col("blocks"), i - 1)["end"] < b["t"])), lambda ok: ok)
    by_volume = F.array_sort(F.flatten(F.transform("blocks", lambda b: lines_of(b["block"]))))
    text = F.when(in_order, F.array_join(F.transform("blocks", lambda b: b["block"]), "\n")).otherwise(F.array_join(F.transform(by_volume, lambda r: r["line"]), "\n"))
    return pieces.withColumn("body", text).drop("blocks")


def packed(pieces: DataFrame) -> DataFrame:
    """Merged files: file, n_series, n_volumes, n_blocks, n_copied, n_bytes, footer (series, sidecar, offset and bytes in the
    body, first_t, last_t, volumes of each piece, in the order they stand), body."""
    piece = F.struct("start", "series", "sidecar", "n_bytes", "first_t", "last_t", "n_volumes", "body")
    f = pieces.groupBy("file").agg(
        F.countDistinct("series").alias("n_series"), F.sum("n_volumes").alias("n_volumes"), F.sum("n_blocks").alias("n_blocks"), F.sum("n_copied").alias("n_copied"), F.sum("n_bytes").alias("n_bytes"),
        F.array_sort(F.collect_list(piece)).alias("pieces"),
    )
    entry = lambda p: F.struct(
        p["series"].alias("series"), p["sidecar"].alias("sidecar"), (p["start"] - F.col("pieces")[0]["start"]).alias("offset"), (p["n_bytes"] - 1).alias("n_bytes"), p["first_t"].alias("first_t"), p["last_t"].alias("last_t"), p["n_volumes"].alias("n_volumes")
    )
    return f.select("file", "n_series", "n_volumes", "n_blocks", "n_copied", "n_bytes", F.transform("pieces", entry).alias("footer"), F.array_join(F.transform("pieces", lambda p: p["body"]), "\n").alias("body"))


def p4_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(consolidate(table(spark, sf_dir, "ts_fragments")))


def p4_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each series before (distinct volumes in the fragments) and after; they agree for every series."""
    f = table(spark, sf_dir, "ts_fragments")
    before = footers(f).select("series", F.explode("ts").alias("t")).distinct().groupBy("series").agg(F.count("*").alias("n_before"))
    after = consolidate(f).groupBy("series").agg(F.sum("n_volumes").alias("n_after"))
    return before.join(after, "series", "full").select("series", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragments as many small Parquet files in the shared folder, merged by copying their row groups: a row per
    merged file."""
    folder = f"{re.sub('^file:/*', '/', checkpoint_dir(spark))}/fragments-{uuid.uuid4().hex}"
    once = cut(table(spark, sf_dir, "ts_fragments").select("frag_id", "path", "sidecar", "modified_at", "body").dropDuplicates(["frag_id"]))
    once.repartition(max(SMALL_FILES, once.count() // FRAGMENTS_A_FILE), "frag_id").write.parquet(f"{folder}/small")
    merged = parquet_blocks.compact(spark, f"{folder}/small", f"{folder}/large", TARGET_BYTES)
    return cut(merged).select(F.element_at(F.split("path", "/"), -1).alias("file"), "n_files", "n_blocks", "n_rows", "n_bytes", "error")


QUERIES = {"p4_found": p4_found, "p4_merged": p4_merged, "p4_check": p4_check, "p4_files": p4_files}

_VOL = r"""
n AS (SELECT DISTINCT frag_id, regexp_replace(list_last(string_split(replace(path, '\', '/'), '/')), '\.[^/]*$', '') AS name, body FROM ts_fragments WHERE path IS NOT NULL),
s AS (SELECT frag_id, concat_ws('|', regexp_extract(name, '(?:^|_)sub-([^_]*)', 1), regexp_extract(name, '(?:^|_)ses-([^_]*)', 1), regexp_extract(name, '(?:^|_)task-([^_]*)', 1),
  regexp_extract(name, '(?:^|_)run-([^_]*)', 1), regexp_extract(name, '(?:^|_)feature-([^_]*)', 1), regexp_extract(name, '(?:^|_)atlas-([^_]*)', 1)) AS series,
  unnest(regexp_split_to_array(body, '\r\n|\n|\r')) AS line FROM n WHERE regexp_extract(name, '(?:^|_)sub-([^_]*)', 1) <> ''),
v AS (SELECT DISTINCT frag_id, series, CAST(TRY_CAST(trim(string_split(line, E'\t')[1]) AS DOUBLE) AS BIGINT) AS t FROM s WHERE TRY_CAST(trim(string_split(line, E'\t')[1]) AS DOUBLE) IS NOT NULL)
"""
SQL = {
    "p4_found": f"WITH {_VOL} SELECT DISTINCT a.frag_id AS frag_lo, b.frag_id AS frag_hi FROM v a JOIN v b ON a.series = b.series AND a.t = b.t AND a.frag_id < b.frag_id",
    "p4_check": f"WITH {_VOL} SELECT series, count(DISTINCT t) AS n_before, count(DISTINCT t) AS n_after FROM v GROUP BY series",
}
