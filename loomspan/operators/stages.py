"""Queries of the stages' inputs and outputs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.functions import names as N
from loomspan.operators import models, paths
from loomspan.operators.paths import _NORM
from loomspan.plans import carriers as C
from loomspan.session import table
from loomspan.sources import sinks


def src_participants_fallback(spark, d):
    """Without a table: every subject of the manifest is in the group ``all``."""
    s = N.entity(F.col("path"), "sub")
    return table(spark, d, "timeseries_files").where("path IS NOT NULL").select(F.concat(F.lit("sub-"), s).alias("participant_id"), F.lit("all").alias("group")).where("participant_id IS NOT NULL").distinct()


def src_atlas_image(spark, d):
    """Parcels of the voxels: ids ascending, names from the table or ``roi_<id>``, position by rank."""
    ids = table(spark, d, "supplier").select((F.col("s_nationkey") + 1).alias("label_id")).distinct()
    pos = ids.select("label_id", (F.row_number().over(Window.orderBy("label_id")) - 1).alias("pos"))  # a row per parcel
    lut = C.labels(spark, d).where("label_id % 5 <> 0").select("label_id", "name")
    return pos.join(lut, "label_id", "left").select("pos", "label_id", F.coalesce("name", F.concat(F.lit("roi_"), F.col("label_id").cast("string"))).alias("name"))


def mk_affine(spark, d):
    """Atlas voxel of each 1-based voxel by two affine maps: to millimetres, then by the atlas' inverse (half-even)."""
    p = C.points(spark, d).select("sid", "p", "roi", "qty")
    mm = lambda c: 2.0 * (F.col(c) - 1) - 90.0
    return p.select("sid", "p", F.rint((mm("roi") + 98.0) / 2.5).cast("int").alias("i"), F.rint((134.0 - mm("qty")) / 2.5).cast("int").alias("j"))


def snk_normative(spark, d):
    n = paths._norm(spark, d)
    return sinks.by_weight(n).select("weight", "i", "j", F.round("v", 5).alias("v"))


def snk_fit(spark, d):
    """A row per run and method: error, iterations, sum of the links."""
    f = models.mk_fit_one(spark, d)
    return f.groupBy("participant", "run", "method").agg(F.first("fit_rmse").alias("fit_rmse"), F.first("n_iter").alias("n_iter"), F.sum("ec").alias("ec_sum"), F.first("error").alias("error"))


def snk_summary(spark, d):
    """The search table's summary as one JSON text."""
    s = C.searched(spark, d).groupBy("stage").agg(F.count("*").alias("n"), F.sum((~F.col("valid")).cast("long")).alias("n_invalid"))
    return s.agg(F.to_json(F.array_sort(F.collect_list(F.struct("stage", "n", "n_invalid")))).alias("summary"))  # a row per stage


QUERIES = {f.__name__: f for f in (src_participants_fallback, src_atlas_image, mk_affine, snk_normative, snk_fit, snk_summary)}
QUERIES |= {"mk_loss_multi": models.mk_loss_multi, "mk_bwd_multi": models.mk_bwd_multi, "src_mat_fibers": lambda spark, d: C.points(spark, d).select("sid", "p", "roi")}
SQL = {
    "src_participants_fallback": "SELECT DISTINCT 'sub-' || regexp_extract(list_last(string_split(path, '/')), '(?:^|_)sub-([A-Za-z0-9]+)', 1) AS participant_id, 'all' AS \"group\" FROM timeseries_files WHERE regexp_extract(list_last(string_split(path, '/')), '(?:^|_)sub-([A-Za-z0-9]+)', 1) <> ''",
    "src_atlas_image": f"WITH {C.LABELS}, i AS (SELECT DISTINCT s_nationkey + 1 AS label_id FROM supplier) SELECT row_number() OVER (ORDER BY i.label_id) - 1 AS pos, i.label_id, coalesce(name, 'roi_' || i.label_id) AS name FROM i LEFT JOIN (SELECT * FROM labels WHERE label_id % 5 <> 0) l ON i.label_id = l.label_id",
    "mk_affine": f"WITH {C.POINTS} SELECT sid, p, CAST(round_even((2.0 * (roi - 1) - 90.0 + 98.0) / 2.5, 0) AS INT) AS i, CAST(round_even((134.0 - (2.0 * (qty - 1) - 90.0)) / 2.5, 0) AS INT) AS j FROM points",
    "snk_normative": f"WITH n AS ({_NORM}) SELECT unnest(['count', 'volcorr', 'lencorr', 'combined']) AS weight, i, j, unnest([CAST(count AS DOUBLE), volcorr, lencorr, combined]) AS v FROM n",
    "snk_summary": f"WITH {C.SEARCHED}, s AS (SELECT stage, count(*) AS n, CAST(sum(CAST(NOT valid AS INT)) AS BIGINT) AS n_invalid FROM searched GROUP BY 1) SELECT '[' || string_agg('{{\"stage\":\"' || stage || '\",\"n\":' || n || ',\"n_invalid\":' || n_invalid || '}}', ',' ORDER BY stage) || ']' AS summary FROM s",
    "src_mat_fibers": f"WITH {C.POINTS} SELECT sid, p, roi FROM points",
}
