"""Column-level data quality profile (problem 3).

Every value is generalised to a mask of character classes. Masks are counted for each column and load (the only shuffle,
pre-aggregated), the dominant masks of a column are mined from the counts, and masks that are rare or do not fit the
declared form lead to the values to look at; a load is reported when its null share or its mask distribution stands far
from that of the other loads.

Defined results: null values have no mask; NaN has the mask ``NaN`` and fits no numeric form; an empty string has the
empty mask; repeated rows (same id, load and value) count once; a table without rows gives an empty profile; with a
single load there is nothing to compare, so no load is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.session import cut, table

RARE_SHARE = 0.002  # a mask with a smaller share of its column is rare
NULL_GAP, NULL_RATIO, Z_MIN = 0.08, 3.0, 5.0  # a load's nulls: share above the others', times theirs, standard errors
SHIFT_MIN = 0.1  # Jensen-Shannon divergence (bits, less its expectation by chance) of a shifted load

#: Form of a time-series path: any root with a slash, folder and name agreeing in sub and ses.
PATH_FORM = (
    r"(?s)^.*/sub-([A-Za-z0-9]+)/(?:ses-([A-Za-z0-9]+)/)?func/"
    r"sub-\1(?:_ses-([A-Za-z0-9]+))?_task-[A-Za-z0-9]+_run-[A-Za-z0-9]+_feature-[A-Za-z0-9]+_atlas-[A-Za-z0-9]+_timeseries\.tsv(?:\.gz)?\z"
)


def class_mask(c: Column) -> Column:
    """Runs of letters become ``a``, of digits ``9``, of white space ``_``; other characters stay."""
    m = F.regexp_replace(c, r"\p{L}+", "a")
    m = F.regexp_replace(m, r"\p{N}+", "9")
    return F.regexp_replace(m, r"(?U)\s+", "_")


def path_mask(c: Column) -> Column:
    """Mask of a path: labels of ``key-label`` become ``a``; labels of the name that repeat the folder's sub or ses become
    ``=``, others ``!``; what stands before the last subject folder becomes ``~``. Lossless for the path's form."""
    folder_sub = F.regexp_extract(c, r"(?s)^.*/sub-([A-Za-z0-9]+)/", 1)
    folder_ses = F.regexp_extract(c, r"(?s)^.*/sub-[A-Za-z0-9]+/ses-([A-Za-z0-9]+)/", 1)
    name = F.element_at(F.split(c, "/"), -1)
    name_sub = F.regexp_extract(name, r"^sub-([A-Za-z0-9]+)", 1)
    name_ses = F.regexp_extract(name, r"^sub-[A-Za-z0-9]+_ses-([A-Za-z0-9]+)_", 1)
    agree = F.concat(F.when(folder_sub == name_sub, "=").otherwise("!"), F.when(folder_ses == name_ses, "=").otherwise("!"), F.lit(" "))
    shape = F.regexp_replace(F.regexp_replace(c, r"(?s)^.*/(?=sub-[A-Za-z0-9]+/)", "~/"), r"(?<=[/_](?:sub|ses|task|run|feature|atlas)-)[A-Za-z0-9]+(?=[/_]|$)", "a")
    return F.concat(agree, F.regexp_replace(shape, r"\p{N}+", "9"))


#: Masks of paths that have the declared form.
PATH_MASK_FORM = r"^== ~/sub-a/(ses-a/)?func/sub-a(_ses-a)?_task-a_run-a_feature-a_atlas-a_timeseries\.tsv(\.gz)?\z"


def number_mask(c: Column) -> Column:
    """Sign, leading digit and power of ten of a number, such as ``+2e0``."""
    v = c.cast("double")
    e = F.floor(F.log10(F.abs(v)) + 1e-12)
    lead = F.floor(F.abs(v) / F.pow(F.lit(10.0), e) + 1e-9).cast("int")
    return (
        F.when(F.isnan(v), "NaN").when(v == 0, "0").when(F.abs(v) == float("inf"), F.when(v > 0, "+inf").otherwise("-inf"))
        .otherwise(F.concat(F.when(v < 0, "-").otherwise("+"), lead.cast("string"), F.lit("e"), e.cast("string")))
    )


def root_mask(c: Column) -> Column:
    """Root (digits generalised) and ending of a path, whose distribution is compared between loads."""
    root = F.regexp_replace(F.regexp_extract(c, r"(?s)^(.*?)/sub-[A-Za-z0-9]+/", 1), r"\p{N}+", "9")
    return F.concat_ws(" | ", root, F.regexp_extract(c, r"(\.[A-Za-z0-9.]+)$", 1))


def mask_counts(cells: DataFrame, column: str = "mask") -> DataFrame:
    """tbl, col, load_id, mask (null: null value) -> n; cells are distinct records. The one pass over the data."""
    return cells.groupBy("tbl", "col", "load_id", F.col(column).alias("mask")).agg(F.count("*").alias("n"))


def rare_masks(counts: DataFrame) -> DataFrame:
    """Masks with their share of the column; ``rare`` below RARE_SHARE, the others are the dominant patterns."""
    there = counts.where(F.col("mask").isNotNull())
    whole = there.groupBy("tbl", "col", "mask").agg(F.sum("n").alias("n"))
    totals = there.groupBy("tbl", "col").agg(F.sum("n").alias("total"))  # a row per column
    share = F.col("n") / F.col("total")
    return whole.join(totals, ["tbl", "col"]).select("tbl", "col", "mask", "n", share.alias("share"), (share < RARE_SHARE).alias("rare"))


def null_loads(counts: DataFrame) -> DataFrame:
    """Loads whose share of nulls lies far above that of the other loads (taken together and as their median)."""
    per = counts.groupBy("tbl", "col", "load_id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("mask").isNull(), F.col("n")).otherwise(0)).alias("nulls"))
    per = per.withColumn("share", F.col("nulls") / F.col("n"))  # a row per column and load
    whole = per.groupBy("tbl", "col").agg(F.sum("n").alias("all_n"), F.percentile("share", F.lit(0.5)).alias("middle"))
    per = per.join(whole, ["tbl", "col"]).withColumn("others_n", F.col("all_n") - F.col("n")).where(F.col("others_n") > 0)
    se = F.sqrt((F.col("middle") * (1 - F.col("middle")) + 1.0 / F.col("others_n")) / F.col("n"))
    return per.where((F.col("share") - F.col("middle") >= NULL_GAP) & (F.col("share") >= NULL_RATIO * F.col("middle")) & ((F.col("share") - F.col("middle")) >= Z_MIN * se))


def load_divergence(counts: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence in bits between the masks of each load and the median load's masks (each mask's median
    share over the loads, so that a load standing out does not blur what the others are held against).

    Only masks that a load has are looked at: of those it lacks, a median share q adds q / 2, so all of them together
    half of what its own masks leave of 1."""
    c = counts.where(F.col("mask").isNotNull())
    loads = c.groupBy("tbl", "col", "load_id").agg(F.sum("n").alias("total"))
    p = c.join(loads, ["tbl", "col", "load_id"]).withColumn("p", F.col("n") / F.col("total"))
    n_loads = loads.groupBy("tbl", "col").agg(F.count("*").alias("n_loads"))
    # median over all loads: those without the mask stand before the shares found
    at = 0.5 * (F.col("n_loads") - 1) - (F.col("n_loads") - F.size("ps"))
    place = lambda k: F.when(k < 0, F.lit(0.0)).otherwise(F.get("ps", k.cast("int")))
    low, high = F.floor(at), F.ceil(at)
    shares = p.groupBy("tbl", "col", "mask").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # a number per load
    typical = shares.join(n_loads, ["tbl", "col"]).select("tbl", "col", "mask", (place(low) + (at - low) * (place(high) - place(low))).alias("q0"))
    sums = typical.groupBy("tbl", "col").agg(F.sum("q0").alias("sum"), F.sum((F.col("q0") > 0).cast("int")).alias("n_typical")).where("sum > 0")
    g = p.join(typical, ["tbl", "col", "mask"]).join(sums, ["tbl", "col"]).withColumn("q", F.col("q0") / F.col("sum"))
    mid = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / mid)).otherwise(0.0) / 2
    return g.groupBy("tbl", "col", "load_id").agg(
        F.first("total").alias("n"), (F.sum(term(F.col("p")) + term(F.col("q"))) + F.greatest(F.lit(0.0), 1 - F.sum("q")) / 2).alias("js"),
        (F.first("n_typical") + F.sum((F.col("q0") <= 0).cast("int"))).alias("k"),
    )


def shifted_loads(counts: DataFrame) -> DataFrame:
    d = load_divergence(counts)
    chance = (F.col("k") - 1) / (8 * F.log(F.lit(2.0)) * F.col("n"))
    several = d.groupBy("tbl", "col").agg(F.count("*").alias("n_loads")).where("n_loads > 1")
    return d.withColumn("excess", F.col("js") - 2 * chance).join(several, ["tbl", "col"]).where(F.col("excess") >= SHIFT_MIN)


#: The declared form on the values: what the exact check holds against the values that the masks lead to.
FORMS = {
    "path": lambda v: v.rlike(PATH_FORM) & (F.regexp_extract(v, r"/ses-([A-Za-z0-9]+)/func/", 1) == F.regexp_extract(v, r"_ses-([A-Za-z0-9]+)_task-[^/]*$", 1)),
    "tr": lambda v: v.cast("double").between(0.2, 10.0) & ~F.isnan(v.cast("double")),
    "coverage": lambda v: v.cast("double").between(0.0, 1.0) & ~F.isnan(v.cast("double")),
}


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record and profiled column: value as text, its mask, the mask compared between loads."""
    f = table(spark, sf_dir, "timeseries_files").select(F.col("file_id").alias("rec_id"), "load_id", "path", "tr").distinct()
    n = table(spark, sf_dir, "node_sets").select(F.col("node_id").alias("rec_id"), "load_id", "coverage").distinct()

    def cells(df: DataFrame, tbl: str, col: str) -> DataFrame:
        v = F.col(col)
        mask, shape = (path_mask(v), root_mask(v)) if col == "path" else (number_mask(v), number_mask(v))
        return df.select(F.lit(tbl).alias("tbl"), F.lit(col).alias("col"), "load_id", "rec_id", v.cast("string").alias("v"), mask.alias("mask"), F.when(v.isNotNull(), shape).alias("shape"))

    return cells(f, "timeseries_files", "path").unionByName(cells(f, "timeseries_files", "tr")).unionByName(cells(n, "node_sets", "coverage"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cut(_cells(spark, sf_dir))
    full = cut(cells.groupBy("tbl", "col", "load_id", "mask", "shape").agg(F.count("*").alias("n")))
    counts = full.groupBy("tbl", "col", "load_id", "mask").agg(F.sum("n").alias("n"))
    # masks to look at: rare ones, and those of no declared form or of a form that the mask alone does not settle; a
    # dominant mask of the declared form is right without a look at its values
    m = rare_masks(counts)
    settled = (
        F.when(F.col("col") == "path", F.col("mask").rlike(PATH_MASK_FORM))
        .when(F.col("col") == "tr", F.col("mask").rlike(r"^\+([2-9]e-1|[1-9]e0)$"))
        .otherwise(F.col("mask").rlike(r"^(0|\+[1-9]e-[0-9]+)$"))
    )
    look = m.where(F.col("rare") | ~settled).select("tbl", "col", "mask")
    seen = cells.join(look, ["tbl", "col", "mask"], "left_semi")
    fits = F.when(F.col("col") == "path", FORMS["path"](F.col("v"))).when(F.col("col") == "tr", FORMS["tr"](F.col("v"))).otherwise(FORMS["coverage"](F.col("v")))
    bad = cut(seen.where(~fits).select("tbl", "col", "load_id", "rec_id", "shape"))
    none = F.lit(0).cast("long").alias("rec_id")
    values = bad.select("tbl", "col", F.lit("value").alias("issue"), "load_id", "rec_id").distinct()
    nulls = null_loads(counts).select("tbl", "col", F.lit("nulls").alias("issue"), "load_id", none)
    # shapes of the valid values: all values less the bad ones
    wrong = bad.groupBy("tbl", "col", "load_id", F.col("shape").alias("mask")).agg((-F.count("*")).alias("n"))
    all_ = full.where(F.col("shape").isNotNull()).select("tbl", "col", "load_id", F.col("shape").alias("mask"), "n")
    shapes = all_.unionByName(wrong).groupBy("tbl", "col", "load_id", "mask").agg(F.sum("n").alias("n")).where("n > 0")
    shifts = shifted_loads(shapes).select("tbl", "col", F.lit("shift").alias("issue"), "load_id", none)
    return values.unionByName(nulls).unionByName(shifts)


def column_profile(df: DataFrame, tbl: str, load: str = "load_id") -> DataFrame:
    """For every column of ``df`` but the load, one row per load: rows, nulls, distinct values (HyperLogLog), least and
    greatest value as text, number of masks. One pass over an unpivoted table; strings, numbers and times alike."""
    cols = [c for c, t in df.dtypes if c != load and not t.startswith(("array", "map", "struct", "binary"))]
    mask = {c: (number_mask(F.col(f"`{c}`")) if t in ("double", "float") else class_mask(F.col(f"`{c}`").cast("string"))) for c, t in df.dtypes if c in cols}
    order = {c: (F.col(f"`{c}`").cast("double") if t in ("double", "float", "int", "bigint", "smallint", "tinyint") else F.lit(None).cast("double")) for c, t in df.dtypes if c in cols}
    cells = df.select(F.col(load).alias("load_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("v"), mask[c].alias("mask"), order[c].alias("x")) for c in cols])).alias("c"))
    return cells.groupBy(F.lit(tbl).alias("tbl"), F.col("c.col").alias("col"), "load_id").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("c.v").isNull().cast("int")).alias("n_nulls"), F.approx_count_distinct("c.v").alias("n_distinct"),
        F.min("c.x").alias("least"), F.max("c.x").alias("greatest"), F.min("c.v").alias("first_text"), F.max("c.v").alias("last_text"), F.approx_count_distinct("c.mask").alias("n_masks"),
    )


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of every column of the manifest and node tables for each load."""
    parts = [column_profile(table(spark, sf_dir, t).distinct(), t) for t in ("timeseries_files", "node_sets")]
    return parts[0].unionByName(parts[1])


def all_cells(df: DataFrame, tbl: str, delivered: str, load: str = "load_id") -> DataFrame:
    """tbl, col, load_id, mask, shape (the mask compared between loads) for every column of every record but its load; a
    record that came more than once, at other times, counts once."""
    df = df.dropDuplicates([c for c in df.columns if c != delivered])
    kinds = {c: t for c, t in df.dtypes if c != load and not t.startswith(("array", "map", "struct", "binary"))}

    def cell(c: str, kind: str) -> Column:
        v = F.col(f"`{c}`")
        mask = path_mask(v) if c == "path" else number_mask(v) if kind in ("double", "float") else class_mask(v.cast("string"))
        return F.struct(F.lit(c).alias("col"), mask.alias("mask"), F.when(v.isNotNull(), root_mask(v) if c == "path" else mask).alias("shape"))

    cells = df.select(F.col(load).alias("load_id"), F.explode(F.array(*[cell(c, k) for c, k in kinds.items()])).alias("c"))
    return cells.select(F.lit(tbl).alias("tbl"), "c.col", "load_id", "c.mask", "c.shape")


def load_report(cells: DataFrame) -> DataFrame:
    """tbl, col, issue, load_id, mask, n, measure: for each load its masks that are rare in the column (``rare``: records,
    the mask's share), and the loads whose nulls (``nulls``: records, share of nulls) or masks (``shift``: values,
    divergence in bits) stand out."""
    counts = cut(mask_counts(cells))
    rare = counts.join(rare_masks(counts).where("rare").select("tbl", "col", "mask", "share"), ["tbl", "col", "mask"]).select("tbl", "col", F.lit("rare").alias("issue"), "load_id", "mask", "n", F.col("share").alias("measure"))
    none = F.lit(None).cast("string").alias("mask")
    nulls = null_loads(counts).select("tbl", "col", F.lit("nulls").alias("issue"), "load_id", none, "n", F.col("share").alias("measure"))
    shifts = shifted_loads(cut(mask_counts(cells, "shape"))).select("tbl", "col", F.lit("shift").alias("issue"), "load_id", none, "n", F.col("js").alias("measure"))
    return rare.unionByName(nulls).unionByName(shifts)


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_cells(table(spark, sf_dir, "timeseries_files"), "timeseries_files", "written_at").unionByName(all_cells(table(spark, sf_dir, "node_sets"), "node_sets", "built_at"))


def p3_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of every column with counts, shares and whether they are rare."""
    return rare_masks(mask_counts(_all(spark, sf_dir)))


def p3_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare masks, null shares and mask distributions of every column by load."""
    return load_report(_all(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_profile": p3_profile, "p3_masks": p3_masks, "p3_loads": p3_loads}
_FORM = r"^(?s:.*)/sub-([A-Za-z0-9]+)/(?:ses-([A-Za-z0-9]+)/)?func/sub-([A-Za-z0-9]+)(?:_ses-([A-Za-z0-9]+))?_task-[A-Za-z0-9]+_run-[A-Za-z0-9]+_feature-[A-Za-z0-9]+_atlas-[A-Za-z0-9]+_timeseries\.tsv(?:\.gz)?$"


def _digit_mask(v: str) -> str:
    e = f"floor(log10(abs({v})) + 1e-12)"
    return f"CASE WHEN {v} = 0 THEN '0' ELSE CASE WHEN {v} < 0 THEN '-' ELSE '+' END || CAST(CAST(floor(abs({v}) / pow(10, {e}) + 1e-9) AS INT) AS VARCHAR) || 'e' || CAST(CAST({e} AS INT) AS VARCHAR) END"


_G = [f"regexp_extract(path, '{_FORM}', {k})" for k in (1, 2, 3, 4)]
_CELLS = f"""f AS (SELECT DISTINCT file_id AS rec_id, load_id, path, tr FROM timeseries_files), n AS (SELECT DISTINCT node_id AS rec_id, load_id, coverage FROM node_sets),
cells AS (
  SELECT 'timeseries_files' AS tbl, 'path' AS col, load_id, rec_id, path IS NOT NULL AS there, path IS NULL OR (regexp_matches(path, '{_FORM}') AND {_G[0]} = {_G[2]} AND {_G[1]} = {_G[3]}) AS fits,
    concat_ws(' | ', regexp_replace(regexp_extract(path, '^((?s:.*?))/sub-[A-Za-z0-9]+/', 1), '[0-9]+', '9', 'g'), regexp_extract(path, '(\\.[A-Za-z0-9.]+)$', 1)) AS shape FROM f
  UNION ALL SELECT 'timeseries_files', 'tr', load_id, rec_id, tr IS NOT NULL, tr IS NULL OR tr BETWEEN 0.2 AND 10, {_digit_mask('tr')} FROM f
  UNION ALL SELECT 'node_sets', 'coverage', load_id, rec_id, coverage IS NOT NULL, coverage IS NULL OR coverage BETWEEN 0 AND 1, {_digit_mask('coverage')} FROM n),
per AS (SELECT tbl, col, load_id, count(*) AS n, count(*) FILTER (NOT there) / count(*) AS share FROM cells GROUP BY ALL),
nl AS (SELECT *, quantile_cont(share, 0.5) OVER (PARTITION BY tbl, col) AS middle, sum(n) OVER (PARTITION BY tbl, col) - n AS others FROM per),
c AS (SELECT tbl, col, load_id, shape, count(*) AS n FROM cells WHERE there AND fits GROUP BY ALL), t AS (SELECT tbl, col, load_id, sum(n) AS total FROM c GROUP BY ALL),
g AS (SELECT t.tbl, t.col, t.load_id, m.shape, t.total, coalesce(c.n, 0) / t.total AS p FROM t JOIN (SELECT DISTINCT tbl, col, shape FROM c) m ON t.tbl = m.tbl AND t.col = m.col LEFT JOIN c ON c.tbl = t.tbl AND c.col = t.col AND c.load_id = t.load_id AND c.shape = m.shape),
q0 AS (SELECT tbl, col, shape, quantile_cont(p, 0.5) AS q FROM g GROUP BY ALL), q1 AS (SELECT tbl, col, shape, q / nullif(sum(q) OVER (PARTITION BY tbl, col), 0) AS q FROM q0),
js AS (SELECT g.tbl, g.col, g.load_id, max(total) AS n, sum(CAST(p + q > 0 AS INT)) AS k,
  sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END / 2 + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END / 2) AS js FROM g JOIN q1 ON g.tbl = q1.tbl AND g.col = q1.col AND g.shape = q1.shape WHERE q IS NOT NULL GROUP BY ALL)"""
SQL = {
    "p3_found": f"""WITH {_CELLS}
SELECT DISTINCT tbl, col, 'value' AS issue, load_id, rec_id FROM cells WHERE NOT fits
UNION ALL SELECT tbl, col, 'nulls', load_id, 0 FROM nl WHERE others > 0 AND share - middle >= {NULL_GAP} AND share >= {NULL_RATIO} * middle AND share - middle >= {Z_MIN} * sqrt((middle * (1 - middle) + 1.0 / others) / n)
UNION ALL SELECT tbl, col, 'shift', load_id, 0 FROM (SELECT *, count(*) OVER (PARTITION BY tbl, col) AS loads FROM js) WHERE loads > 1 AND js - 2 * (k - 1) / (8 * ln(2) * n) >= {SHIFT_MIN}"""
}
