"""Column functions on file names, labels and identifiers. A null argument gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of the entities in a file name (fixed values).
ENTITY_ORDER = ("sub", "ses", "task", "acq", "ce", "rec", "dir", "run", "echo", "space", "res", "den", "atlas", "seg", "feature", "setting", "model", "group", "hemi", "desc", "stat")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Ending of the file name: ``.nii.gz`` and the like count as one."""
    return F.regexp_extract(base_name(path), r"(\.(?:nii|tsv|mat|txt)\.gz|\.[^.]*)$", 1)


def strip_ext(path: Column) -> Column:
    n = base_name(path)
    return F.left(n, F.length(n) - F.length(extension(path)))


def entities(path: Column) -> Column:
    """Map of key-value parts of the stem (keys are letters), the last bare part as ``suffix``, other bare parts joined as
    ``_extra``, the ``extension``; of a key that stands twice the last value stays."""
    parts = F.split(strip_ext(path), "_")
    is_pair = lambda x: x.rlike(r"^[A-Za-z]+-")
    key = lambda x: F.substring_index(x, "-", 1)
    pairs = F.filter(parts, is_pair)
    keys = F.array_distinct(F.transform(pairs, key))
    last = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.transform(F.filter(pairs, lambda x: key(x) == k), lambda x: F.substring(x, F.length(k) + 2, F.length(x))), -1).alias("value")))
    bare = F.filter(parts, lambda x: ~is_pair(x))
    suffix = F.when(~is_pair(F.element_at(parts, -1)), F.array(F.struct(F.lit("suffix").alias("key"), F.element_at(parts, -1).alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    rest = F.when(~is_pair(F.element_at(parts, -1)), F.slice(bare, 1, F.greatest(F.size(bare) - 1, F.lit(0)))).otherwise(bare)
    extra = F.when(F.size(rest) > 0, F.array(F.struct(F.lit("_extra").alias("key"), F.array_join(rest, "_").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    return F.map_from_entries(F.concat(last, suffix, extra, F.array(F.struct(F.lit("extension").alias("key"), extension(path).alias("value")))))


def entity(path: Column, key: str) -> Column:
    """Value of one entity, null where there is none."""
    v = F.regexp_extract(base_name(path), rf"(?:^|_){key}-([A-Za-z0-9]+)", 1)
    return F.when(v != "", v)


def build_name(ents: Column, suffix: Column | None = None, ext: Column | None = None) -> Column:
    """Name from a map: entities in their order, others after them by key, empty ones left out."""
    order = F.array(*[F.lit(k) for k in ENTITY_ORDER])
    others = F.array_sort(F.filter(F.map_keys(ents), lambda k: ~k.isin(*ENTITY_ORDER, "suffix", "_extra", "extension")))
    named = F.transform(F.filter(F.concat(order, others), lambda k: F.coalesce(F.element_at(ents, k), F.lit("")) != ""), lambda k: F.concat(k, F.lit("-"), F.element_at(ents, k)))
    end = suffix if suffix is not None else F.element_at(ents, F.lit("suffix"))
    return F.concat(F.concat_ws("_", named, end), F.coalesce(ext, F.lit("")) if ext is not None else F.lit(""))


def sub_label(s: Column) -> Column:
    t = F.trim(s)
    return F.when(t.startswith("sub-"), t).otherwise(F.concat(F.lit("sub-"), t))


def norm_subject(s: Column, pad: int = 0) -> Column:
    """``sub-`` and the letters and digits of a subject without its prefix; pure digits are padded with zeros, never cut."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\s+", ""), r"(?i)^(sub|subject|participant)[-_]?", ""), r"[^A-Za-z0-9]", "")
    return F.concat(F.lit("sub-"), F.when(t.rlike(r"^[0-9]+$") & (F.length(t) < pad), F.lpad(t, pad, "0")).otherwise(t))


def slug(s: Column) -> Column:
    return F.substring(F.regexp_replace(s, "[^A-Za-z0-9]", ""), 1, 60)


def norm(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


SIDES = "LH|RH|lh|rh|L|R|Left|Right|left|right"  # fixed values


def hemisphere(name: Column) -> Column:
    """L, R or empty: the first token for a side."""
    return F.upper(F.substring(F.regexp_extract(name, rf"(?:^|[-_\s.])({SIDES})(?=$|[-_\s.])", 1), 1, 1))


def homotopic_key(name: Column) -> Column:
    return F.regexp_replace(name, rf"(^|[-_\s.])(?:{SIDES})(?=$|[-_\s.])", "$1*")


def tag(sub: Column, ses: Column, task: Column, run: Column) -> Column:
    part = lambda k, c: F.when(c != "", F.concat(F.lit(f"{k}-"), c))
    return F.concat_ws("_", sub, part("ses", ses), part("task", task), part("run", run))
