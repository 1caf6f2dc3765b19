"""Queries of the string functions on the manifests' paths and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import names as N
from loomspan.session import table


def _paths(spark, d):
    return table(spark, d, "timeseries_files").where("path IS NOT NULL").select("path").distinct()


def str_strip_ext(spark, d):
    return _paths(spark, d).select("path", N.strip_ext(F.col("path")).alias("stem"), N.extension(F.col("path")).alias("ext"))


def str_entities(spark, d):
    e = N.entities(F.col("path"))
    x = _paths(spark, d).select("path", e.alias("e"))
    pick = [F.coalesce(F.element_at("e", F.lit(k)), F.lit("")).alias(k) for k in ("sub", "ses", "task", "run", "feature", "atlas", "suffix", "_extra")]
    return x.select("path", *pick)


def str_build_name(spark, d):
    e = N.entities(F.col("path"))
    return _paths(spark, d).where(F.col("path").rlike(r"_timeseries\.tsv(\.gz)?$")).select("path", N.build_name(e, F.lit("bold"), F.lit(".nii.gz")).alias("name"))


def str_sub_label(spark, d):
    return table(spark, d, "timeseries_files").where("sub IS NOT NULL").select("sub").distinct().select("sub", N.sub_label(F.col("sub")).alias("label"))


def str_norm_subject(spark, d):
    s = table(spark, d, "customer").select(F.concat(F.when(F.col("c_custkey") % 3 == 0, "Sub-").when(F.col("c_custkey") % 3 == 1, "participant_").otherwise(" "), F.col("c_custkey").cast("string")).alias("raw"))
    return s.select("raw", N.norm_subject(F.col("raw"), 3).alias("label"))


def str_entity(spark, d):
    return _paths(spark, d).select("path", N.entity(F.col("path"), "task").alias("task"), N.entity(F.col("path"), "ses").alias("ses"))


def str_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", N.slug(F.concat_ws(" - ", "p_name", "p_type", "p_brand")).alias("slug"))


def str_norm(spark, d):
    return table(spark, d, "part").select("p_partkey", N.norm(F.concat_ws("/", "p_name", "p_brand")).alias("norm"))


def _names(spark, d):
    return table(spark, d, "node_sets").where("name IS NOT NULL").select("name").distinct()


def str_hemisphere(spark, d):
    return _names(spark, d).select("name", N.hemisphere(F.col("name")).alias("hemisphere"))


def str_homotopic_key(spark, d):
    return _names(spark, d).select("name", N.homotopic_key(F.col("name")).alias("key"))


def str_tag(spark, d):
    b = table(spark, d, "bold_runs").select("run_id", "sub", "ses", "task", "run").distinct()
    return b.select("run_id", N.tag(F.col("sub"), F.col("ses"), F.col("task"), F.col("run").cast("string")).alias("tag"))


QUERIES = {f.__name__: f for f in (str_strip_ext, str_entities, str_build_name, str_sub_label, str_norm_subject, str_entity, str_slug, str_norm, str_hemisphere, str_homotopic_key, str_tag)}

_P = "p AS (SELECT DISTINCT path, list_last(string_split(path, '/')) AS n FROM timeseries_files WHERE path IS NOT NULL), q AS (SELECT path, n, regexp_extract(n, '(\\.(?:nii|tsv|mat|txt)\\.gz|\\.[^.]*)$', 1) AS ext FROM p), s AS (SELECT path, n, ext, left(n, length(n) - length(ext)) AS stem FROM q)"
_E = "e AS (SELECT path, stem, list_filter(string_split(stem, '_'), lambda x: regexp_matches(x, '^[A-Za-z]+-')) AS pairs, list_filter(string_split(stem, '_'), lambda x: NOT regexp_matches(x, '^[A-Za-z]+-')) AS bare, NOT regexp_matches(list_last(string_split(stem, '_')), '^[A-Za-z]+-') AS ends FROM s)"


def _val(k: str) -> str:
    return f"coalesce(substr(list_last(list_filter(pairs, lambda x: starts_with(x, '{k}-'))), {len(k) + 2}), '')"


_TRIM = "trim(sub)"
SQL = {
    "str_strip_ext": f"WITH {_P} SELECT path, stem, ext FROM s",
    "str_entities": f"WITH {_P}, {_E} SELECT path, " + ", ".join(f"{_val(k)} AS {k}" for k in ("sub", "ses", "task", "run", "feature", "atlas")) + ", CASE WHEN ends THEN list_last(bare) ELSE '' END AS suffix, coalesce(array_to_string(CASE WHEN ends THEN bare[:-2] ELSE bare END, '_'), '') AS _extra FROM e",
    "str_build_name": f"WITH {_P}, {_E} SELECT path, concat_ws('_', " + ", ".join(f"CASE WHEN {_val(k)} <> '' THEN '{k}-' || {_val(k)} END" for k in N.ENTITY_ORDER) + ", nullif(array_to_string(list_filter(pairs, lambda x: NOT list_contains(["
    + ", ".join(f"'{k}'" for k in N.ENTITY_ORDER) + "], split_part(x, '-', 1))), '_'), ''), 'bold') || '.nii.gz' AS name FROM e WHERE regexp_matches(path, '_timeseries\\.tsv(\\.gz)?$')",
    "str_sub_label": f"SELECT DISTINCT sub, CASE WHEN starts_with({_TRIM}, 'sub-') THEN {_TRIM} ELSE 'sub-' || {_TRIM} END AS label FROM timeseries_files WHERE sub IS NOT NULL",
    "str_norm_subject": "SELECT raw, 'sub-' || CASE WHEN length(t) < 3 THEN lpad(t, 3, '0') ELSE t END AS label FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN 'Sub-' WHEN 1 THEN 'participant_' ELSE ' ' END || c_custkey AS raw, CAST(c_custkey AS VARCHAR) AS t FROM customer)",
    "str_entity": f"WITH {_P} SELECT path, nullif(regexp_extract(n, '(?:^|_)task-([A-Za-z0-9]+)', 1), '') AS task, nullif(regexp_extract(n, '(?:^|_)ses-([A-Za-z0-9]+)', 1), '') AS ses FROM p",
    "str_slug": "SELECT p_partkey, substr(regexp_replace(p_name || ' - ' || p_type || ' - ' || p_brand, '[^A-Za-z0-9]', '', 'g'), 1, 60) AS slug FROM part",
    "str_norm": "SELECT p_partkey, regexp_replace(lower(p_name || '/' || p_brand), '[^a-z0-9]', '', 'g') AS norm FROM part",
    "str_hemisphere": "SELECT DISTINCT name, upper(substr(regexp_extract(name, '(?:^|[-_\\s.])(LH|RH|lh|rh|L|R|Left|Right|left|right)(?:$|[-_\\s.])', 1), 1, 1)) AS hemisphere FROM node_sets WHERE name IS NOT NULL",
    # RE2 has no lookahead: the separator after the token is taken and put back (tokens next to each other do not occur)
    "str_homotopic_key": "SELECT DISTINCT name, regexp_replace(name, '(^|[-_\\s.])(?:LH|RH|lh|rh|L|R|Left|Right|left|right)($|[-_\\s.])', '\\1*\\2', 'g') AS key FROM node_sets WHERE name IS NOT NULL",
    "str_tag": "SELECT DISTINCT run_id, concat_ws('_', sub, CASE WHEN ses <> '' THEN 'ses-' || ses END, CASE WHEN task <> '' THEN 'task-' || task END, CASE WHEN CAST(run AS VARCHAR) <> '' THEN 'run-' || run END) AS tag FROM bold_runs",
}
