"""Participants, labels, manifests and masks: filters, joins, groups and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import names as N
from loomspan.plans import carriers as C
from loomspan.session import strip_outer, table

#: Words that say a group is missing (fixed values).
NO_GROUP = ("", "nan", "n/a", "na", "none", "null")


def normalise_participants(df: DataFrame, id_column: str, group_column: str) -> DataFrame:
    """participant_id (``sub-`` labels), group and the other columns; rows without a group are dropped."""
    extra = [c for c in df.columns if c not in (id_column, group_column)]
    out = df.select(N.sub_label(strip_outer(F.col(id_column))).alias("participant_id"), strip_outer(F.col(group_column)).alias("group"), *extra)
    return out.where(F.col("participant_id").isNotNull() & F.col("group").isNotNull() & ~F.lower("group").isin(*NO_GROUP))


def unique_or_raise(df: DataFrame, key: str) -> DataFrame:
    """The rows, or an error when a key stands twice (checked where the rows pass, without collecting)."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("_ok", F.assert_true(n == 1, F.concat(F.lit("duplicate "), F.col(key)))).where(F.col("_ok").isNull()).drop("_ok")


def _people(spark, d):
    return normalise_participants(table(spark, d, "participants").select("participant_id", "group", "age", "site").distinct(), "participant_id", "group")


def src_participants(spark, d):
    return _people(spark, d).select("participant_id", "group", "age", "site").distinct()


def flt_participants(spark, d):
    """Include list (semi join) and exclude list (anti join)."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, d, "orders")
    include, exclude = o.select(F.col("o_custkey").alias("c_custkey")), o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(include, "c_custkey", "left_semi").join(exclude, "c_custkey", "left_anti")


def jn_anti(spark, d):
    """Subjects on one side only: manifest against participants."""
    p = _people(spark, d).select(F.col("participant_id").alias("sub")).distinct()
    f = table(spark, d, "timeseries_files").where("sub IS NOT NULL").select(N.sub_label(strip_outer(F.col("sub"))).alias("sub")).distinct()
    return f.join(p, "sub", "left_anti").select("sub", F.lit("missing_in_tsv").alias("side")).union(p.join(f, "sub", "left_anti").select("sub", F.lit("missing_in_files").alias("side")))


def so_except(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 200000").select(F.col("o_custkey").alias("k"))
    return c.subtract(o).select("k", F.lit("never ordered").alias("side")).union(o.subtract(c).select("k", F.lit("unknown").alias("side")))


def jn_semi(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return c.join(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


def jn_label_lut(spark, d):
    """Label ids of the suppliers' voxels with names from the table, ``roi_<id>`` where there is none."""
    ids = table(spark, d, "supplier").select((F.col("s_nationkey") + 1).alias("label_id")).distinct()
    lut = C.labels(spark, d).where("label_id % 5 <> 0").select("label_id", "name", "hemisphere", "network")
    return ids.join(lut, "label_id", "left").select("label_id", F.coalesce("name", F.concat(F.lit("roi_"), F.col("label_id").cast("string"))).alias("name"), F.coalesce("hemisphere", F.lit("")).alias("hemisphere"), F.coalesce("network", F.lit("")).alias("network"))


def homotopic_pairs(parcels: DataFrame, key: str = "key") -> DataFrame:
    """Left and right parcels of one key (of several the last one)."""
    side = lambda h, c: parcels.where(F.col("hemisphere") == h).groupBy(key).agg(F.max("pos").alias(c))
    return side("L", "left_pos").join(side("R", "right_pos"), key).select("left_pos", "right_pos")


def jn_homotopic(spark, d):
    return homotopic_pairs(C.labels(spark, d).withColumn("key", F.floor(F.col("pos") / 2)))


def jn_parcel_map(spark, d):
    v = table(spark, d, "supplier").groupBy((F.col("s_nationkey") + 1).alias("label_id")).agg(F.round(F.avg("s_acctbal"), 6).alias("value"))
    return C.labels(spark, d).select("pos", "label_id", "name").join(v, "label_id", "left")


def jn_prior(spark, d):
    """Own group's prior, else the pooled one."""
    c = table(spark, d, "customer")
    prior = c.where("c_acctbal > 0").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 6).alias("own")).where("c_mktsegment <> 'BUILDING'")
    pooled = c.where("c_acctbal > 0").agg(F.round(F.avg("c_acctbal"), 6).alias("pooled"))
    one = F.lit(1).alias("k")
    x = c.select("c_custkey", "c_mktsegment", one).join(prior, "c_mktsegment", "left").join(F.broadcast(pooled.select("pooled", one)), "k")  # one row
    return x.select("c_custkey", F.coalesce("own", "pooled").alias("prior"))


def ag_groups(spark, d):
    return _people(spark, d).groupBy("group").agg(F.count("*").alias("n"), F.countDistinct("participant_id").alias("n_distinct"), F.min("participant_id").alias("first"), F.max("participant_id").alias("last"))


def sl_sorted_lists(spark, d):
    """Sorted members of each network."""
    return C.labels(spark, d).groupBy("network").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("members"))


def ag_has_task(spark, d):
    b = table(spark, d, "bold_runs").select("run_id", "sub", "task").distinct().where("sub IS NOT NULL")
    has = lambda t: F.max((F.col("task") == t).cast("int")).alias(f"has_{t}")
    return b.groupBy(N.sub_label(strip_outer(F.col("sub"))).alias("sub")).agg(has("rest"), has("nback"), F.count("*").alias("n_files"))


def src_participants_mat(spark, d):
    """Participants gathered from files of subjects and groups; several groups are joined with ``+``."""
    p = _people(spark, d)
    return p.groupBy("participant_id").agg(F.array_join(F.array_sort(F.collect_set("group")), "+").alias("group"))


def _manifest(spark, d):
    f = table(spark, d, "timeseries_files").where("path IS NOT NULL").select("file_id", "path").distinct()
    return f.select("file_id", "path", *[N.entity(F.col("path"), k).alias(k) for k in ("sub", "ses", "task", "run", "feature", "atlas")])


def src_halfpipe_ts(spark, d):
    m = _manifest(spark, d)
    name = N.base_name(F.col("path"))
    return m.where(name.contains("_feature-") & name.contains("_atlas-") & name.endswith("_timeseries.tsv") & (F.col("task") == "rest") & (F.col("atlas") == "Moro64")).select("file_id", "path")


def src_halfpipe_feats(spark, d):
    return _manifest(spark, d).where("feature IS NOT NULL AND atlas IS NOT NULL").groupBy("feature", "atlas").agg(F.countDistinct("sub").alias("n_subjects"))


def src_fmriprep(spark, d):
    """Preprocessed runs of a task in a space (letter case aside) with mask and confounds where there are any."""
    b = table(spark, d, "bold_runs").distinct()
    return b.where((F.col("task") == "rest") & (F.lower("space") == "mni152nlin6asym") & F.col("bold").endswith("_desc-preproc_bold.nii.gz")).select("run_id", "bold", "mask", "confounds", "confounds_json", "tr")


def _best_only(df: DataFrame, keys: list[str], rank) -> DataFrame:
    """Rows of the least rank (null: out) of their key: an aggregate joined back, so a key with many rows is no one task."""
    ranked = df.withColumn("_r", rank).where("_r IS NOT NULL")
    return ranked.join(ranked.groupBy(*keys).agg(F.min("_r").alias("_b")), keys).where("_r = _b").drop("_b")


def _by_priority(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("source"))
    return _best_only(df, [key], F.when(at > 0, at)).drop("_r")


def src_bold_discover(spark, d):
    """Per subject the runs of the first source that has any."""
    b = table(spark, d, "bold_runs").where("sub IS NOT NULL").select(N.sub_label(strip_outer(F.col("sub"))).alias("sub"), "run_id", "source").distinct()
    return _by_priority(b, "sub", ["fmriprep", "halfpipe"])


def src_ts_discover(spark, d):
    f = table(spark, d, "timeseries_files").where("sub IS NOT NULL").select(N.sub_label(strip_outer(F.col("sub"))).alias("sub"), "file_id", "source").distinct()
    return _by_priority(f, "sub", ["derivative", "halfpipe-timeseries"])


def src_halfpipe_bold(spark, d):
    b = table(spark, d, "bold_runs").where("sub IS NOT NULL").select(N.sub_label(strip_outer(F.col("sub"))).alias("sub"), "run_id", "source", "postprocessed").distinct()
    return _by_priority(b, "sub", ["halfpipe", "fmriprep"])


def src_subject_sc(spark, d):
    """First structural source of each customer's orders, by fixed order of priority."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("sub"), F.col("o_orderpriority").alias("source"))
    rank = F.array_position(F.array(*[F.lit(x) for x in ("3-MEDIUM", "1-URGENT", "5-LOW", "2-HIGH")]), F.col("source"))
    return o.where(rank > 0).groupBy("sub").agg(F.min_by("source", rank).alias("source"))


def src_sidecar_tr(spark, d):
    """Repetition time from a JSON side file under the first of several spellings, else inherited."""
    e = table(spark, d, "events")
    k = [F.get_json_object("props", f"$.{n}").try_cast("double") for n in ("RepetitionTime", "repetition_time", "TR", "k")]
    return e.select("event_id", F.coalesce(*k, F.lit(2.0)).alias("tr"))


def src_mat_select(spark, d):
    """Best connectivity key of each brand: by order of preference, keys with ``length`` left out, ties by name."""
    t = F.lower("p_type")
    rank = F.when(t.contains("copper"), 0).when(t.contains("brass"), 1).when(t.contains("steel"), 2).otherwise(3)
    return table(spark, d, "part").where(~t.contains("small")).groupBy("p_brand").agg(F.min_by("p_type", F.struct(rank, F.col("p_type"))).alias("key"))


def src_qsirecon(spark, d):
    """Union of listings without repeats; the hint narrows it unless nothing would remain."""
    c = table(spark, d, "customer")
    a = c.where("c_acctbal > 0").select("c_mktsegment", "c_custkey").union(c.where("c_custkey % 2 = 0").select("c_mktsegment", "c_custkey")).distinct()
    return _best_only(a, ["c_mktsegment"], F.when(F.col("c_custkey") % 97 == 0, 0).otherwise(1)).select("c_mktsegment", "c_custkey")


def src_qsiprep_dwi(spark, d):
    """Companions of each file: first mask, confounds and JSON by name."""
    b = table(spark, d, "bold_runs").distinct()
    return b.groupBy("sub").agg(F.count("*").alias("n"), F.min("mask").alias("mask"), F.min("confounds").alias("confounds"), F.min("confounds_json").alias("json"))


def src_raw_dwi(spark, d):
    """Own value, else the one inherited from the data set."""
    b = table(spark, d, "bold_runs").select("run_id", "task", "tr").distinct()
    up = b.groupBy("task").agg(F.min("tr").alias("inherited"))
    return b.join(up, "task", "left").select("run_id", F.coalesce("tr", "inherited").alias("tr"))


def src_label_find(spark, d):
    """Label file of each atlas: the candidate of best rank, then by name."""
    f = table(spark, d, "timeseries_files").where("sidecar IS NOT NULL AND atlas IS NOT NULL").select("atlas", "sidecar").distinct()
    rank = F.when(F.col("sidecar").endswith("_timeseries.json"), 0).when(F.col("sidecar").endswith(".json"), 1).otherwise(2)
    return f.groupBy("atlas").agg(F.min_by("sidecar", F.struct(rank, F.col("sidecar"))).alias("sidecar"))


def src_atlas_scan(spark, d):
    """Files that are label images by their name: neither maps of probabilities nor T1 images nor masks."""
    b = table(spark, d, "bold_runs").select(F.explode(F.array("bold", "mask")).alias("path")).where("path IS NOT NULL").distinct()
    n = F.lower(N.base_name(F.col("path")))
    return b.where(n.rlike(r"\.nii(\.gz)?$") & ~n.rlike(r"probseg|t1w|_mask|tpm"))


def src_grid_space(spark, d):
    """Known grid whose shape and corner (within 0.01) a file has."""
    g = table(spark, d, "nation").select("n_nationkey", (90 + F.col("n_nationkey") % 4).alias("nx"), (-90.0 + (F.col("n_nationkey") % 3) * 0.008).alias("x0"))
    known = spark.createDataFrame([("A", 91, -90.0), ("B", 93, -90.0)], "space string, kx int, k0 double")  # fixed values
    return g.join(F.broadcast(known), (F.col("nx") == F.col("kx")) & (F.abs(F.col("x0") - F.col("k0")) <= 0.01), "left").select("n_nationkey", F.coalesce("space", F.lit("")).alias("space"))


def src_label_table(spark, d):
    """Label table read from the text of the parcels' lines."""
    t = C.labels(spark, d).select(F.concat_ws("\t", F.col("label_id").cast("string"), "name", "hemisphere", "network").alias("line"))
    p = F.split("line", "\t")
    return t.select(p[0].cast("int").alias("label_id"), p[1].alias("name"), p[2].alias("hemisphere"), p[3].alias("network"))


def flt_atlas_select(spark, d):
    """Best match of a name among the atlases: equal, then contained, then by tokens; preferred space first."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    n = N.norm(F.col("p_name"))
    rank = F.when(n == "bluelace", 0).when(n.contains("blue"), 1).when(n.rlike("[aeiou]{2}"), 2)
    return _best_only(p, ["p_brand"], rank).select("p_brand", "p_partkey", F.col("_r").alias("r"))


def so_concat(spark, d):
    """Search stages appended, columns that a stage lacks are null."""
    s = C.searched(spark, d)
    return s.where("stage = 'coarse'").select("G", "a", "fit_rmse", F.lit("coarse").alias("stage")).unionByName(s.where("stage = 'refine'").select("G", "a", "fc_corr", F.lit("refine").alias("stage")), allowMissingColumns=True)


def so_distinct(spark, d):
    return C.points(spark, d).select("sid", "roi").distinct()


def so_unique_files(spark, d):
    f = table(spark, d, "timeseries_files")
    return f.where("sidecar IS NOT NULL").select(F.col("sidecar").alias("path")).union(f.where("path IS NOT NULL").select("path")).distinct()


def so_union_mask(spark, d):
    """Links that any participant's mask allows."""
    p = C.points(spark, d).select("sid", "roi").distinct()
    a = p.where("sid % 2 = 0").select("roi", (F.col("sid") % 25).alias("j"))
    return a.union(p.where("sid % 2 = 1").select("roi", (F.col("sid") % 25).alias("j"))).where("roi <> j").distinct()


def so_intersect(spark, d):
    """Regions that every priority class of orders reaches: an intersection of two sets and over all classes."""
    li = C.points(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("sid"), "o_orderpriority"), "sid")
    return li.where("o_orderpriority = '1-URGENT'").select("roi").intersect(li.where("o_orderpriority = '5-LOW'").select("roi"))


QUERIES = {
    f.__name__: f
    for f in (
        src_participants, flt_participants, jn_anti, so_except, jn_semi, jn_label_lut, jn_homotopic, jn_parcel_map, jn_prior, ag_groups, sl_sorted_lists, ag_has_task, src_participants_mat,
        src_halfpipe_ts, src_halfpipe_feats, src_fmriprep, src_bold_discover, src_ts_discover, src_halfpipe_bold, src_subject_sc, src_sidecar_tr, src_mat_select, src_qsirecon, src_qsiprep_dwi,
        src_raw_dwi, src_label_find, src_atlas_scan, src_grid_space, src_label_table, flt_atlas_select, so_concat, so_distinct, so_unique_files, so_union_mask, so_intersect,
    )
}

_SP = r"E' \t\n\r'"
_LBL = f"CASE WHEN starts_with(trim(%s, {_SP}), 'sub-') THEN trim(%s, {_SP}) ELSE 'sub-' || trim(%s, {_SP}) END"


def _lbl(c: str) -> str:
    return _LBL % (c, c, c)


_PEOPLE = f"""people AS (SELECT {_lbl('participant_id')} AS participant_id, trim("group", {_SP}) AS "group", age, site FROM (SELECT DISTINCT participant_id, "group", age, site FROM participants)
  WHERE participant_id IS NOT NULL AND lower(trim("group", {_SP})) NOT IN ('', 'nan', 'n/a', 'na', 'none', 'null'))"""
_MAN = "man AS (SELECT DISTINCT file_id, path, list_last(string_split(path, '/')) AS n, " + ", ".join(f"nullif(regexp_extract(list_last(string_split(path, '/')), '(?:^|_){k}-([A-Za-z0-9]+)', 1), '') AS e_{k}" for k in ("sub", "task", "feature", "atlas")) + " FROM timeseries_files WHERE path IS NOT NULL)"


def _prio(src: str, cols: str, order: list[str]) -> str:
    lst = "[" + ", ".join(f"'{x}'" for x in order) + "]"
    return f"WITH x AS (SELECT DISTINCT {_lbl('sub')} AS sub, {cols}, list_position({lst}, source) AS r FROM {src} WHERE sub IS NOT NULL), y AS (SELECT *, min(r) FILTER (r > 0) OVER (PARTITION BY sub) AS b FROM x) SELECT * EXCLUDE (r, b) FROM y WHERE r = b"


SQL = {
    "src_participants": f'WITH {_PEOPLE} SELECT DISTINCT participant_id, "group", age, site FROM people',
    "flt_participants": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "jn_anti": f"WITH {_PEOPLE}, p AS (SELECT DISTINCT participant_id AS sub FROM people), f AS (SELECT DISTINCT {_lbl('sub')} AS sub FROM timeseries_files WHERE sub IS NOT NULL) SELECT sub, 'missing_in_tsv' AS side FROM f WHERE sub NOT IN (SELECT sub FROM p) UNION ALL SELECT sub, 'missing_in_files' FROM p WHERE sub NOT IN (SELECT sub FROM f)",
    "so_except": "(SELECT k, 'never ordered' AS side FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)) UNION ALL (SELECT k, 'unknown' FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 EXCEPT SELECT c_custkey FROM customer))",
    "jn_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "jn_label_lut": f"WITH {C.LABELS}, i AS (SELECT DISTINCT s_nationkey + 1 AS label_id FROM supplier) SELECT i.label_id, coalesce(name, 'roi_' || i.label_id) AS name, coalesce(hemisphere, '') AS hemisphere, coalesce(network, '') AS network FROM i LEFT JOIN (SELECT * FROM labels WHERE label_id % 5 <> 0) l ON i.label_id = l.label_id",
    "jn_homotopic": f"WITH {C.LABELS}, k AS (SELECT *, pos // 2 AS key FROM labels) SELECT l.pos AS left_pos, r.pos AS right_pos FROM (SELECT key, max(pos) AS pos FROM k WHERE hemisphere = 'L' GROUP BY 1) l JOIN (SELECT key, max(pos) AS pos FROM k WHERE hemisphere = 'R' GROUP BY 1) r ON l.key = r.key",
    "jn_parcel_map": f"WITH {C.LABELS} SELECT pos, l.label_id, name, value FROM labels l LEFT JOIN (SELECT s_nationkey + 1 AS label_id, round(avg(s_acctbal), 6) AS value FROM supplier GROUP BY 1) v ON l.label_id = v.label_id",
    "jn_prior": "WITH p AS (SELECT c_mktsegment, round(avg(c_acctbal), 6) AS own FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING' GROUP BY 1) SELECT c_custkey, coalesce(own, (SELECT round(avg(c_acctbal), 6) FROM customer WHERE c_acctbal > 0)) AS prior FROM customer c LEFT JOIN p ON c.c_mktsegment = p.c_mktsegment",
    "ag_groups": f'WITH {_PEOPLE} SELECT "group", count(*) AS n, count(DISTINCT participant_id) AS n_distinct, min(participant_id) AS first, max(participant_id) AS last FROM people GROUP BY 1',
    "sl_sorted_lists": f"WITH {C.LABELS} SELECT network, string_agg(name, ',' ORDER BY name) AS members FROM labels GROUP BY 1",
    "ag_has_task": f"SELECT {_lbl('sub')} AS sub, max(CAST(task = 'rest' AS INT)) AS has_rest, max(CAST(task = 'nback' AS INT)) AS has_nback, count(*) AS n_files FROM (SELECT DISTINCT run_id, sub, task FROM bold_runs WHERE sub IS NOT NULL) GROUP BY 1",
    "src_participants_mat": f"WITH {_PEOPLE} SELECT participant_id, string_agg(DISTINCT \"group\", '+' ORDER BY \"group\") AS \"group\" FROM people GROUP BY 1",
    "src_halfpipe_ts": f"WITH {_MAN} SELECT file_id, path FROM man WHERE contains(n, '_feature-') AND contains(n, '_atlas-') AND ends_with(n, '_timeseries.tsv') AND e_task = 'rest' AND e_atlas = 'Moro64'",
    "src_halfpipe_feats": f"WITH {_MAN} SELECT e_feature AS feature, e_atlas AS atlas, count(DISTINCT e_sub) AS n_subjects FROM man WHERE e_feature IS NOT NULL AND e_atlas IS NOT NULL GROUP BY ALL",
    "src_fmriprep": "SELECT DISTINCT run_id, bold, mask, confounds, confounds_json, tr FROM bold_runs WHERE task = 'rest' AND lower(space) = 'mni152nlin6asym' AND ends_with(bold, '_desc-preproc_bold.nii.gz')",
    "src_bold_discover": _prio("bold_runs", "run_id, source", ["fmriprep", "halfpipe"]),
    "src_ts_discover": _prio("timeseries_files", "file_id, source", ["derivative", "halfpipe-timeseries"]),
    "src_halfpipe_bold": _prio("bold_runs", "run_id, source, postprocessed", ["halfpipe", "fmriprep"]),
    "src_subject_sc": "SELECT o_custkey AS sub, arg_min(o_orderpriority, list_position(['3-MEDIUM', '1-URGENT', '5-LOW', '2-HIGH'], o_orderpriority)) AS source FROM orders WHERE o_orderpriority IN ('3-MEDIUM', '1-URGENT', '5-LOW', '2-HIGH') GROUP BY 1",
    "src_sidecar_tr": "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 2.0) AS tr FROM events",
    "src_mat_select": "WITH t AS (SELECT p_brand, p_type, CASE WHEN contains(lower(p_type), 'copper') THEN 0 WHEN contains(lower(p_type), 'brass') THEN 1 WHEN contains(lower(p_type), 'steel') THEN 2 ELSE 3 END AS r FROM part WHERE NOT contains(lower(p_type), 'small')) SELECT p_brand, p_type AS key FROM (SELECT DISTINCT p_brand, p_type, r FROM t) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY r, p_type) = 1",
    "src_qsirecon": "WITH a AS (SELECT c_mktsegment, c_custkey FROM customer WHERE c_acctbal > 0 UNION SELECT c_mktsegment, c_custkey FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT *, c_custkey % 97 = 0 AS hit, max(CAST(c_custkey % 97 = 0 AS INT)) OVER (PARTITION BY c_mktsegment) AS anyhit FROM a) SELECT c_mktsegment, c_custkey FROM b WHERE hit OR anyhit = 0",
    "src_qsiprep_dwi": "SELECT sub, count(*) AS n, min(mask) AS mask, min(confounds) AS confounds, min(confounds_json) AS json FROM (SELECT DISTINCT * FROM bold_runs) GROUP BY 1",
    "src_raw_dwi": "SELECT run_id, coalesce(tr, min(tr) OVER (PARTITION BY task)) AS tr FROM (SELECT DISTINCT run_id, task, tr FROM bold_runs)",
    "src_label_find": "SELECT atlas, sidecar FROM (SELECT DISTINCT atlas, sidecar, CASE WHEN ends_with(sidecar, '_timeseries.json') THEN 0 WHEN ends_with(sidecar, '.json') THEN 1 ELSE 2 END AS r FROM timeseries_files WHERE sidecar IS NOT NULL AND atlas IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY atlas ORDER BY r, sidecar) = 1",
    "src_atlas_scan": "SELECT DISTINCT path FROM (SELECT unnest([bold, mask]) AS path FROM bold_runs) WHERE path IS NOT NULL AND regexp_matches(lower(list_last(string_split(path, '/'))), '\\.nii(\\.gz)?$') AND NOT regexp_matches(lower(list_last(string_split(path, '/'))), 'probseg|t1w|_mask|tpm')",
    "src_grid_space": "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 1 AND (n_nationkey % 3) * 0.008 <= 0.01 THEN 'A' WHEN n_nationkey % 4 = 3 AND (n_nationkey % 3) * 0.008 <= 0.01 THEN 'B' ELSE '' END AS space FROM nation",
    "src_label_table": f"WITH {C.LABELS} SELECT label_id, name, hemisphere, network FROM labels",
    "flt_atlas_select": "WITH n AS (SELECT p_brand, p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS n FROM part), r AS (SELECT p_brand, p_partkey, CASE WHEN n = 'bluelace' THEN 0 WHEN contains(n, 'blue') THEN 1 WHEN regexp_matches(n, '[aeiou]{2}') THEN 2 END AS r FROM n) SELECT p_brand, p_partkey, r FROM r WHERE r IS NOT NULL QUALIFY r = min(r) OVER (PARTITION BY p_brand)",
    "so_concat": f"WITH {C.SEARCHED} SELECT G, a, fit_rmse, CAST(NULL AS DOUBLE) AS fc_corr, 'coarse' AS stage FROM searched WHERE stage = 'coarse' UNION ALL SELECT G, a, NULL, fc_corr, 'refine' FROM searched WHERE stage = 'refine'",
    "so_distinct": f"WITH {C.POINTS} SELECT DISTINCT sid, roi FROM points",
    "so_unique_files": "SELECT sidecar AS path FROM timeseries_files WHERE sidecar IS NOT NULL UNION SELECT path FROM timeseries_files WHERE path IS NOT NULL",
    "so_union_mask": f"WITH {C.POINTS} SELECT DISTINCT roi, sid % 25 AS j FROM points WHERE roi <> sid % 25",
    "so_intersect": f"WITH {C.POINTS}, x AS (SELECT roi, o_orderpriority FROM points JOIN orders ON sid = o_orderkey) SELECT roi FROM x WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT roi FROM x WHERE o_orderpriority = '5-LOW'",
}
