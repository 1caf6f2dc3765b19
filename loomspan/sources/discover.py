"""Files of a data set found by their names: listings are DataFrames, companions come by joins on the entities."""

from __future__ import annotations

import glob
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import names as N
from loomspan.sources import formats

#: Entities that a run shares with its mask, confounds and side files (fixed values).
RUN_ENTITIES = ("sub", "ses", "task", "acq", "rec", "dir", "run", "echo")
TR_KEYS = ("RepetitionTime", "repetition_time", "TR", "tr")
#: Rank of connectivity keys (fixed values).
PREFERRED = ("sift.*count", "sift.*connectivity", r"radius\d+_count", "count", "sift")


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, folder, name of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), N.base_name(F.col("path")).alias("name"))


def with_entities(files: DataFrame) -> DataFrame:
    return files.select("*", *[N.entity(F.col("name"), k).alias(k) for k in (*RUN_ENTITIES, "space", "res", "feature", "setting", "atlas", "desc")])


def _companion(runs: DataFrame, others: DataFrame, value: str, name: str, keys: tuple[str, ...]) -> DataFrame:
    """The runs with the companion that has the same folder and entities (missing ones equal too)."""
    key = lambda k: F.coalesce(F.col(k), F.lit("")).alias(f"_{k}")
    o = others.select(*[key(k) for k in ("folder", *keys)], F.col(value).alias(name))
    return runs.select("*", *[key(k) for k in ("folder", *keys)]).join(o, [f"_{k}" for k in ("folder", *keys)], "left").select(*runs.columns, name)


def space_key(c: Column) -> Column:
    return N.norm(c)


def bold_runs(spark: SparkSession, root: str, task: str | None = "rest", space: str | None = "MNI152NLin2009cAsym", res: str | None = "2", ses: str | None = None, run: str | None = None) -> DataFrame:
    """Preprocessed runs with mask, confounds (``timeseries`` before ``regressors``) and their JSON where there are any."""
    f = with_entities(listing(spark, root))
    b = f.where(F.col("name").endswith("_desc-preproc_bold.nii.gz"))
    for k, v in (("task", task), ("ses", ses), ("run", run)):
        b = b.where(F.col(k) == v) if v else b
    if space:
        b = b.where(space_key(F.col("space")) == re.sub("[^a-z0-9]", "", space.lower()))
    if res is not None:
        b = b.where(F.col("res").isNull() | F.col("res").isin(str(res), f"{int(res):02d}" if str(res).isdigit() else str(res)))
    m = f.where(F.col("name").endswith("_desc-brain_mask.nii.gz"))
    out = _companion(b, m, "path", "mask", (*RUN_ENTITIES, "space", "res"))
    rank = F.when(F.col("name").endswith("_desc-confounds_timeseries.tsv"), 0).when(F.col("name").endswith("_desc-confounds_regressors.tsv"), 1)
    c = f.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("folder", *RUN_ENTITIES).agg(F.min_by("path", "rank").alias("confounds"))
    out = _companion(out, c.withColumnRenamed("confounds", "found"), "found", "confounds", RUN_ENTITIES)
    j = f.where(F.col("name").endswith(".json")).select(F.col("path").alias("confounds_json"))
    return out.join(j, F.regexp_replace("confounds", r"\.tsv$", ".json") == F.col("confounds_json"), "left").select("path", "sub", "ses", "task", "run", "space", "res", "mask", "confounds", "confounds_json")


def feature_series(spark: SparkSession, root: str, task: str | None = None, feature: str | None = None, atlas: str | None = None) -> DataFrame:
    """Ready series ``*_feature-*_atlas-*_timeseries.tsv``."""
    f = with_entities(listing(spark, root, "*_timeseries.tsv")).where("feature IS NOT NULL AND atlas IS NOT NULL")
    for k, v in (("task", task), ("feature", feature), ("atlas", atlas)):
        f = f.where(F.col(k) == v) if v else f
    return f.select("path", "sub", "ses", "task", "run", "feature", "atlas")


def repetition_times(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """path, tr: from the JSON beside a file under the first of several keys, else from the data set's ``task-..._bold.json``."""
    js = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.regexp_replace(F.input_file_name(), "^file:/*", "/").alias("json"), "value")
    tr = F.coalesce(*[F.nullif(F.get_json_object("value", f"$.{k}").try_cast("double"), F.lit(0.0)) for k in TR_KEYS])
    own = js.select("json", tr.alias("own"))
    inherited = js.where(N.base_name(F.col("json")).rlike("^task-.*_bold.json$")).select(N.entity(F.col("json"), "task").alias("task"), F.get_json_object("value", "$.RepetitionTime").try_cast("double").alias("up")).groupBy("task").agg(F.min("up").alias("inherited"))
    x = files.select("path", N.entity(F.col("path"), "task").alias("task"), F.regexp_replace("path", r"\.(nii|tsv)(\.gz)?$", ".json").alias("json"))
    return x.join(own, "json", "left").join(inherited, "task", "left").select("path", F.coalesce("own", "inherited").alias("tr"))


def derivative_roots(folder: str) -> dict[str, str | None]:
    """Folders of the two kinds of derivatives from any usual entry point: the first candidate with subjects in it."""
    has = lambda d, pattern="sub-*": bool(glob.glob(os.path.join(glob.escape(d), pattern)))
    ready = lambda d: has(d) and (os.path.basename(d.rstrip("/")) == "halfpipe" or has(d, "sub-*/func/*_feature-*") or has(d, "sub-*/func/*_setting-*"))
    join = os.path.join
    return {
        "halfpipe": next((d for d in (folder, join(folder, "derivatives", "halfpipe"), join(folder, "halfpipe")) if ready(d)), None),
        "fmriprep": next((d for d in (join(folder, "derivatives", "fmriprep"), join(folder, "fmriprep"), join(os.path.dirname(folder.rstrip("/")), "fmriprep")) if has(d)), None),
    }


def subjects_as_participants(spark: SparkSession, folder: str) -> DataFrame:
    """Without a table: every ``sub-*`` folder is a participant of the group ``all``."""
    found = sorted(os.path.basename(d) for d in glob.glob(os.path.join(glob.escape(folder), "sub-*")) if os.path.isdir(d))
    return spark.createDataFrame([(s, "all") for s in found], "participant_id string, group string")


def templates(folder: str | None, brain_mask: str | None = None, wm: str | None = None) -> dict[str, str]:
    """Template images: as given, else by name in the folder."""
    out = {k: v for k, v in (("brain_mask", brain_mask), ("wm", wm)) if v}
    wanted = {"brain_mask": ("*NLin6Asym*res-02*brain_mask*", "MNI152_T1_2mm_brain_mask.nii.gz"), "wm": ("*NLin6Asym*res-02*label-WM*probseg*",), "t1": ("*NLin6Asym*res-02_T1w*", "MNI152_T1_2mm.nii.gz")}
    for k, patterns in wanted.items():
        hits = [h for p in patterns for h in sorted(glob.glob(os.path.join(glob.escape(folder), p)))] if folder else []
        if hits:
            out.setdefault(k, hits[0])
    return out


def mat_keys(spark: SparkSession, path: str) -> DataFrame:
    """path, name: variables of MATLAB files."""
    formats.register(spark)
    return spark.read.format("matv5").load(path).select("path", F.regexp_replace("name", r"\[\d+\]$", "").alias("name")).distinct()


def select_key(keys: list[str], pattern: str | None = None, atlas: str | None = None) -> str:
    """Name of the connectivity matrix: by pattern, narrowed by the atlas, then by preference; lengths last."""
    likely = [k for k in keys if re.search("connectivity|count|sift|weight|fa|md", k.lower()) and not re.search("region|label|command|atlas_names", k.lower())]
    if pattern:
        likely = [k for k in keys if re.search(pattern, k, re.I)]
        if len(likely) == 1:
            return likely[0]
    if atlas:
        plain = lambda s: re.sub("[^a-z0-9]", "", s.lower())
        likely = [k for k in likely if plain(atlas) in plain(k)] or likely
    for p in PREFERRED:
        hits = sorted(k for k in likely if re.search(p, k, re.I) and "length" not in k.lower())
        if hits:
            return hits[0]
    if not likely:
        raise KeyError(f"no connectivity matrix among {keys}")
    return sorted(likely)[0]


def mat_matrix(spark: SparkSession, path: str, pattern: str | None = None, atlas: str | None = None) -> DataFrame:
    """i, j, v of the connectivity matrix of one file, which has to be square."""
    key = select_key([r["name"] for r in mat_keys(spark, path).select("name").distinct().collect()], pattern, atlas)  # the variables of a file
    m = spark.read.format("matv5").load(path).where((F.col("name") == key) & F.col("v").isNotNull()).select("i", "j", "v")
    size = m.agg(F.max("i"), F.max("j")).first()
    if size[0] != size[1]:
        raise ValueError(f"{path}: {key} is not square")
    return m


def mat_fibers(spark: SparkSession, path: str, name: str = "fibers") -> DataFrame:
    """sid, p, x, y, z of a cell of point lists (L x 3, or 3 x L)."""
    formats.register(spark)
    cells = spark.read.format("matv5").load(path).where(F.col("name").rlike(rf"^{name}\[\d+\]$")).select(F.regexp_extract("name", r"\[(\d+)\]$", 1).cast("long").alias("sid"), "i", "j", "v")
    wide = cells.groupBy("sid").agg(F.max("j").alias("nj"))
    c = cells.join(wide, "sid")
    p, axis = F.when(F.col("nj") > 2, F.col("j")).otherwise(F.col("i")), F.when(F.col("nj") > 2, F.col("i")).otherwise(F.col("j"))
    return c.select("sid", p.alias("p"), axis.alias("axis"), "v").groupBy("sid", "p").pivot("axis", [0, 1, 2]).agg(F.first("v")).toDF("sid", "p", "x", "y", "z")


def atlas_parcels(spark: SparkSession, image: str, labels: DataFrame | None = None) -> DataFrame:
    """pos, label_id, name, hemisphere, network of a label image: ids ascending, ``roi_<id>`` where the table has none."""
    formats.register(spark)
    ids = spark.read.format("nifti").load(image).where("t = 0").select(F.rint("v").cast("int").alias("label_id")).where("label_id > 0").distinct()
    pos = (F.row_number().over(Window.orderBy("label_id")) - 1).alias("pos")  # a row per parcel
    if labels is None:
        labels = spark.createDataFrame([], "label_id int, name string, hemisphere string, network string")
    x = ids.join(labels.select("label_id", "name", "hemisphere", "network"), "label_id", "left")
    name = F.coalesce("name", F.concat(F.lit("roi_"), F.col("label_id").cast("string")))
    return x.select(pos, "label_id", name.alias("name"), F.coalesce(F.nullif("hemisphere", F.lit("")), N.hemisphere(name)).alias("hemisphere"), F.coalesce("network", F.lit("")).alias("network"))
