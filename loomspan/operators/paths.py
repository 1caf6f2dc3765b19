"""Connectivity from paths of points: pairs of regions touched or connected, weights, normalisation and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.plans import carriers as C
from loomspan.session import table


def touched_pairs(points: DataFrame, lengths: DataFrame) -> DataFrame:
    """i, j, count, lenw over all paths: ordered pairs of different regions a path touches, weighted by 1 / length.

    A path meets at most all regions, so its pairs are bounded by their number squared; the distinct (path, region) rows
    are made first and the pairs fold in a partial aggregate before they are shuffled."""
    hits = points.select("sid", "roi").distinct().join(lengths, "sid").select("sid", "roi", (1.0 / F.col("length")).alias("w"))
    other = hits.select("sid", F.col("roi").alias("j"))
    return hits.join(other, "sid").where("roi <> j").groupBy(F.col("roi").alias("i"), "j").agg(F.count("*").alias("count"), F.sum("w").alias("lenw"))


def endpoint_pairs(points: DataFrame, lengths: DataFrame) -> DataFrame:
    """i, j, count, lenw of first and last regions, both directions, paths that end where they begin left out."""
    ends = points.groupBy("sid").agg(F.min_by("roi", "p").alias("a"), F.max_by("roi", "p").alias("b")).where("a <> b").join(lengths, "sid")
    both = ends.select(F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))).alias("e"), "length")
    return both.groupBy("e.i", "e.j").agg(F.count("*").alias("count"), F.sum(1.0 / F.col("length")).alias("lenw"))


def normalised(pairs: DataFrame, volumes: DataFrame) -> DataFrame:
    """count / sqrt(vi vj), lenw, lenw / sqrt(vi vj); 0 where a volume is 0 or missing."""
    vi, vj = volumes.select(F.col("roi").alias("i"), F.col("n").alias("vi")), volumes.select(F.col("roi").alias("j"), F.col("n").alias("vj"))
    x = pairs.join(vi, "i", "left").join(vj, "j", "left").withColumn("s", F.sqrt(F.coalesce(F.col("vi") * F.col("vj"), F.lit(0)).cast("double")))
    part = lambda c: F.coalesce(F.try_divide(c, "s"), F.lit(0.0))
    return x.select("i", "j", "count", part(F.col("count")).alias("volcorr"), F.col("lenw").alias("lencorr"), part(F.col("lenw")).alias("combined"))


def prepared(matrix: DataFrame, top: float = 0.2, threshold: float = 0.01, clip: float = 6.0) -> DataFrame:
    """i, j, v -> NaN 0, diagonal 0, symmetric, log1p, clipped, small links 0, greatest link ``top``; in this order."""
    clean = matrix.where("i <> j").select("i", "j", F.when(F.isnan("v"), 0.0).otherwise(F.coalesce("v", F.lit(0.0))).alias("v"))
    both = clean.select("i", "j", (0.5 * F.col("v")).alias("v")).union(clean.select(F.col("j").alias("i"), F.col("i").alias("j"), (0.5 * F.col("v")).alias("v")))
    m = both.groupBy("i", "j").agg(F.sum("v").alias("v")).select("i", "j", F.least(F.log1p("v"), F.lit(clip)).alias("v"))
    greatest = m.agg(F.max("v").alias("m"))
    x = m.withColumn("k", F.lit(1)).join(F.broadcast(greatest.withColumn("k", F.lit(1))), "k")  # one row
    return x.select("i", "j", F.when(F.col("v") >= threshold * F.col("m"), F.coalesce(F.try_divide(F.col("v"), F.col("m")), F.lit(0.0)) * top).otherwise(0.0).alias("v"))


def summary(pairs: DataFrame, parcels: DataFrame) -> DataFrame:
    """One row: density, greatest link, empty nodes, symmetry, mean row sums of the sides, share between the sides."""
    n = parcels.agg(F.count("*").alias("n"))
    h = parcels.select("pos", "hemisphere")
    e = pairs.join(h.select(F.col("pos").alias("i"), F.col("hemisphere").alias("hi")), "i").join(h.select(F.col("pos").alias("j"), F.col("hemisphere").alias("hj")), "j")
    back = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("count").alias("back"))
    agg = e.join(back, ["i", "j"], "left").agg(
        F.sum((F.col("count") > 0).cast("int")).alias("links"), F.max("count").alias("max_edge"), F.countDistinct("i").alias("met"),
        F.coalesce(F.bool_and(F.col("count") == F.coalesce("back", F.lit(0))), F.lit(True)).alias("symmetric"), F.sum("count").alias("total"),
        F.sum(F.when(F.col("hi") == "L", F.col("count"))).alias("left_sum"), F.sum(F.when(F.col("hi") == "R", F.col("count"))).alias("right_sum"), F.sum(F.when(F.col("hi") != F.col("hj"), F.col("count"))).alias("between"),
    )
    sides = parcels.agg(F.sum((F.col("hemisphere") == "L").cast("int")).alias("nl"), F.sum((F.col("hemisphere") == "R").cast("int")).alias("nr"))
    one = lambda x: x.withColumn("k", F.lit(1))
    x = one(agg).join(one(n), "k").join(one(sides), "k")
    z = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return x.select(
        z(F.col("links"), F.col("n") * (F.col("n") - 1)).alias("density"), F.coalesce("max_edge", F.lit(0)).alias("max_edge"), (F.col("n") - F.col("met")).alias("empty_nodes"), "symmetric",
        z(F.col("left_sum"), F.col("nl")).alias("left_mean"), z(F.col("right_sum"), F.col("nr")).alias("right_mean"), z(F.col("between"), F.col("total")).alias("interhemispheric"),
    )


def _touched(spark, d):
    return touched_pairs(C.points(spark, d), C.path_lengths(spark, d))


def _volumes(spark, d):
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("roi")).agg(F.count("*").alias("n"))


def jn_pairs_touched(spark, d):
    return _touched(spark, d).select("i", "j", "count", F.round("lenw", 5).alias("lenw"))


def jn_pairs_endpoints(spark, d):
    return endpoint_pairs(C.points(spark, d), C.path_lengths(spark, d)).select("i", "j", "count", F.round("lenw", 5).alias("lenw"))


def _norm(spark, d):
    return normalised(_touched(spark, d), _volumes(spark, d))


def ag_norm_sc(spark, d):
    return _norm(spark, d).select("i", "j", "count", *[F.round(c, 5).alias(c) for c in ("volcorr", "lencorr", "combined")])


def mk_normative(spark, d):
    """The whole builder: paths touched, weights, normalisation, and the matrix prepared for a model (each link and weight)."""
    n = _norm(spark, d).select("i", "j", F.round("combined", 6).alias("v"))
    return prepared(n).select("i", "j", F.round("v", 6).alias("v"))


def mk_sl_conn(spark, d):
    """The same plan on paths of two points at least, distances as weights."""
    p = C.points(spark, d)
    long = p.groupBy("sid").agg(F.count("*").alias("n")).where("n >= 2").select("sid")
    return endpoint_pairs(p.join(long, "sid", "left_semi"), C.path_lengths(spark, d)).select("i", "j", "count", F.round("lenw", 5).alias("lenw"))


def ag_roi_volume(spark, d):
    return _volumes(spark, d)


def ag_density3d(spark, d):
    """Points per voxel: 1-based indices to 0, points outside the box left out."""
    p = C.points(spark, d).select((F.col("roi")).alias("i"), (F.col("part") % 12 - 1).alias("j"), (F.col("qty").cast("int") % 10 - 1).alias("k"))
    return p.where("i BETWEEN 0 AND 24 AND j BETWEEN 0 AND 10 AND k BETWEEN 0 AND 8").groupBy("i", "j", "k").agg(F.count("*").alias("n"))


def _matrix(spark, d):
    return _touched(spark, d).select("i", "j", F.round(F.col("lenw"), 6).alias("v"))


def prj_prepare_sc(spark, d):
    return prepared(_matrix(spark, d)).select("i", "j", F.round("v", 6).alias("v"))


def ag_sc_summary(spark, d):
    return summary(_touched(spark, d), C.labels(spark, d))


def jn_transpose(spark, d):
    m = _touched(spark, d).select("i", "j", (F.col("count") * (F.col("i") + 1)).alias("v"))
    t = m.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("back"))
    return m.join(t, ["i", "j"]).select("i", "j", (0.5 * (F.col("v") + F.col("back"))).alias("symmetric"), (F.col("v") - F.col("back")).alias("asymmetry"))


def ag_compare_sc(spark, d):
    """Touched against end-point connectivity: links of either, correlation of log1p over the upper triangle, equal or not."""
    a = _touched(spark, d).where("i < j").select("i", "j", F.log1p("count").alias("x"))
    b = endpoint_pairs(C.points(spark, d), C.path_lengths(spark, d)).where("i < j").select("i", "j", F.log1p("count").alias("y"))
    return a.join(b, ["i", "j"], "full").select(F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y")).agg(
        F.sum((F.col("x") > 0).cast("int")).alias("links_a"), F.sum((F.col("y") > 0).cast("int")).alias("links_b"), F.round(correlation("x", "y"), 5).alias("r"), F.bool_and(F.abs(F.col("x") - F.col("y")) < 1e-9).alias("equal")
    )


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation as an aggregate; null where a column is constant (the built-in raises there in ANSI mode)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(F.when(y.isNotNull(), x)) * F.var_pop(F.when(x.isNotNull(), y))))


def wn_diff(spark, d):
    return C.path_lengths(spark, d).select("sid", F.round("length", 6).alias("length"))


def ag_orientation(spark, d):
    """Two orientations of the axis: share of points inside and correlation of log density with a map; best first."""
    p = C.points(spark, d)
    flip = p.select(F.explode(F.array(F.struct(F.lit("as is").alias("o"), F.col("roi").alias("v")), F.struct(F.lit("flipped").alias("o"), (24 - F.col("roi")).alias("v")))).alias("x")).select("x.o", "x.v")
    dens = flip.groupBy("o", "v").agg(F.count("*").alias("n"))
    v = _volumes(spark, d).select(F.col("roi").alias("v"), F.col("n").alias("vol"))
    x = dens.join(v, "v", "left")
    return x.groupBy("o").agg(F.round(F.try_divide(F.sum(F.when(F.col("vol").isNotNull(), F.col("n")).otherwise(0)), F.sum("n")), 6).alias("inside"), F.round(correlation(F.log1p("n"), F.coalesce(F.col("vol"), F.lit(0)).cast("double")), 5).alias("r"))


def jn_point_atlas(spark, d):
    """Voxel of each point by an affine map (half-even rounding), label of the atlas or -1."""
    p = C.points(spark, d).select("sid", "p", F.rint(0.5 * F.col("roi") + 0.25).cast("int").alias("vi"), F.rint(F.col("qty") / 4 - 1.5).cast("int").alias("vj"))
    atlas = table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 13).cast("int").alias("vi"), (F.col("s_nationkey") % 12).cast("int").alias("vj")).agg(F.max("s_nationkey").alias("label"))
    return p.join(atlas, ["vi", "vj"], "left").select("sid", "p", F.coalesce("label", F.lit(-1)).alias("label"))


def jn_grid_nn(spark, d):
    """A labelled grid on another one: each voxel of a grid of half the width takes its nearest one's label, -1 outside."""
    own = table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 13).cast("int").alias("vi"), (F.col("s_nationkey") % 12).cast("int").alias("vj")).agg(F.max("s_nationkey").alias("label"))
    fine = spark.range(30 * 28).select((F.col("id") % 30).cast("int").alias("i"), F.floor(F.col("id") / 30).cast("int").alias("j"))  # the other grid's voxels
    at = fine.select("i", "j", F.rint(0.5 * F.col("i") - 0.25).cast("int").alias("vi"), F.rint(0.5 * F.col("j") - 0.25).cast("int").alias("vj"))
    return at.join(own, ["vi", "vj"], "left").select("i", "j", F.coalesce("label", F.lit(-1)).alias("label"))


def mk_map_pts(spark, d):
    """Points by a composed affine map: x' = A x + b of each coordinate, not rounded."""
    p = C.points(spark, d)
    return p.select("sid", "p", F.round(0.5 * F.col("roi") + 0.1 * F.col("qty") + 0.25, 6).alias("x"), F.round(F.col("qty") / 4 - 1.5, 6).alias("y"), F.round(-0.2 * F.col("roi") + 2.0, 6).alias("z"))


def snk_cache(spark, d):
    """Narrowest type that holds each path's coordinates; values outside the range raise."""
    c = F.assert_true(F.col("qty") == F.floor("qty"), F.lit("not whole"))
    p = C.points(spark, d).withColumn("ok", c).where("ok IS NULL")
    width = F.when(F.max("qty") < 256, "uint8").when(F.max("qty") < 32768, "int16").otherwise("float32")
    return p.groupBy("sid").agg(width.alias("dtype"), F.min("qty").alias("least"), F.max("qty").alias("most"))


def src_fiber_cache(spark, d):
    """Offsets of each path in the packed points: number of points before it."""
    n = C.points(spark, d).groupBy("sid").agg(F.count("*").alias("n"))
    block = n.withColumn("b", F.floor(F.col("sid") / 1024))
    sums = block.groupBy("b").agg(F.sum("n").alias("m"))
    before = sums.withColumn("base", F.coalesce(F.sum("m").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return block.withColumn("inner", inner).join(before, "b").select("sid", "n", (F.col("base") + F.col("inner")).alias("offset"))


QUERIES = {
    "jn_pairs_touched": jn_pairs_touched, "jn_pairs_endpoints": jn_pairs_endpoints, "ag_norm_sc": ag_norm_sc, "mk_normative": mk_normative, "mk_sl_conn": mk_sl_conn, "ag_roi_volume": ag_roi_volume,
    "ag_density3d": ag_density3d, "prj_prepare_sc": prj_prepare_sc, "ag_sc_summary": ag_sc_summary, "jn_transpose": jn_transpose, "ag_compare_sc": ag_compare_sc, "wn_diff": wn_diff,
    "ag_orientation": ag_orientation, "jn_point_atlas": jn_point_atlas, "jn_grid_nn": jn_grid_nn, "mk_map_pts": mk_map_pts, "snk_cache": snk_cache, "src_fiber_cache": src_fiber_cache,
}

_T = f"""{C.POINTS}, {C.LENGTHS}, hits AS (SELECT DISTINCT sid, roi FROM points),
touched AS (SELECT a.roi AS i, b.roi AS j, count(*) AS count, sum(1.0 / length) AS lenw FROM hits a JOIN hits b ON a.sid = b.sid AND a.roi <> b.roi JOIN lengths l ON a.sid = l.sid GROUP BY ALL)"""
_ENDS = """ends AS (SELECT sid, arg_min(roi, p) AS a, arg_max(roi, p) AS b FROM points GROUP BY 1),
endp AS (SELECT i, j, count(*) AS count, sum(1.0 / length) AS lenw FROM (SELECT sid, a AS i, b AS j FROM ends WHERE a <> b UNION ALL SELECT sid, b, a FROM ends WHERE a <> b) e JOIN lengths l ON e.sid = l.sid GROUP BY 1, 2)"""
_V = "vol AS (SELECT s_nationkey AS roi, count(*) AS n FROM supplier GROUP BY 1)"
_NORM = f"WITH {_T}, {_V} SELECT i, j, count, round(coalesce(count / nullif(sqrt(a.n * b.n), 0), 0), 5) AS volcorr, round(lenw, 5) AS lencorr, round(coalesce(lenw / nullif(sqrt(a.n * b.n), 0), 0), 5) AS combined FROM touched LEFT JOIN vol a ON i = a.roi LEFT JOIN vol b ON j = b.roi"
_ATLAS = f"WITH {C.POINTS}, v AS (SELECT sid, p, CAST(round_even(0.5 * roi + 0.25, 0) AS INT) AS vi, CAST(round_even(qty / 4 - 1.5, 0) AS INT) AS vj FROM points), a AS (SELECT CAST(s_suppkey % 13 AS INT) AS vi, CAST(s_nationkey % 12 AS INT) AS vj, max(s_nationkey) AS label FROM supplier GROUP BY 1, 2) SELECT sid, p, coalesce(label, -1) AS label FROM v LEFT JOIN a ON v.vi = a.vi AND v.vj = a.vj"
SQL = {
    "jn_pairs_touched": f"WITH {_T} SELECT i, j, count, round(lenw, 5) AS lenw FROM touched",
    "jn_pairs_endpoints": f"WITH {C.POINTS}, {C.LENGTHS}, {_ENDS} SELECT i, j, count, round(lenw, 5) AS lenw FROM endp",
    "ag_norm_sc": _NORM,
    "mk_normative": f"WITH n AS ({_NORM.replace(', 5) AS combined', ', 6) AS combined')}), s AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, 0.5 * combined AS v FROM n UNION ALL SELECT j, i, 0.5 * combined FROM n) GROUP BY 1, 2), m AS (SELECT i, j, least(ln(1 + v), 6.0) AS v FROM s), g AS (SELECT max(v) AS g FROM m) SELECT i, j, round(CASE WHEN v >= 0.01 * g THEN coalesce(v / nullif(g, 0), 0) * 0.2 ELSE 0 END, 6) AS v FROM m, g",
    "mk_sl_conn": f"WITH {C.POINTS}, {C.LENGTHS}, {_ENDS} SELECT i, j, count, round(lenw, 5) AS lenw FROM endp",
    "ag_roi_volume": f"WITH {_V} SELECT roi, n FROM vol",
    "ag_density3d": f"WITH {C.POINTS}, x AS (SELECT roi AS i, part % 12 - 1 AS j, CAST(qty AS INT) % 10 - 1 AS k FROM points) SELECT i, j, k, count(*) AS n FROM x WHERE i BETWEEN 0 AND 24 AND j BETWEEN 0 AND 10 AND k BETWEEN 0 AND 8 GROUP BY ALL",
    "prj_prepare_sc": f"WITH {_T}, m0 AS (SELECT i, j, round(lenw, 6) AS v FROM touched), s AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, 0.5 * v AS v FROM m0 UNION ALL SELECT j, i, 0.5 * v FROM m0) GROUP BY 1, 2), m AS (SELECT i, j, least(ln(1 + v), 6.0) AS v FROM s), g AS (SELECT max(v) AS g FROM m) SELECT i, j, round(CASE WHEN v >= 0.01 * g THEN coalesce(v / nullif(g, 0), 0) * 0.2 ELSE 0 END, 6) AS v FROM m, g",
    "ag_sc_summary": f"WITH {_T}, {C.LABELS}, e AS (SELECT t.i, t.j, t.count, a.hemisphere AS hi, b.hemisphere AS hj, u.count AS back FROM touched t JOIN labels a ON t.i = a.pos JOIN labels b ON t.j = b.pos LEFT JOIN touched u ON t.i = u.j AND t.j = u.i) SELECT round(coalesce(count(*) / nullif((SELECT count(*) * (count(*) - 1) FROM labels), 0), 0), 6) AS density, coalesce(max(count), 0) AS max_edge, (SELECT count(*) FROM labels) - count(DISTINCT i) AS empty_nodes, coalesce(bool_and(count = coalesce(back, 0)), true) AS symmetric, round(coalesce(sum(count) FILTER (hi = 'L') / nullif((SELECT count(*) FROM labels WHERE hemisphere = 'L'), 0), 0), 6) AS left_mean, round(coalesce(sum(count) FILTER (hi = 'R') / nullif((SELECT count(*) FROM labels WHERE hemisphere = 'R'), 0), 0), 6) AS right_mean, round(coalesce(sum(count) FILTER (hi <> hj) / nullif(sum(count), 0), 0), 6) AS interhemispheric FROM e",
    "jn_transpose": f"WITH {_T}, m AS (SELECT i, j, count * (i + 1) AS v FROM touched) SELECT a.i, a.j, 0.5 * (a.v + b.v) AS symmetric, a.v - b.v AS asymmetry FROM m a JOIN m b ON a.i = b.j AND a.j = b.i",
    "ag_compare_sc": f"WITH {_T}, {_ENDS}, f AS (SELECT coalesce(a.x, 0) AS x, coalesce(b.y, 0) AS y FROM (SELECT i, j, ln(1 + count) AS x FROM touched WHERE i < j) a FULL JOIN (SELECT i, j, ln(1 + count) AS y FROM endp WHERE i < j) b ON a.i = b.i AND a.j = b.j) SELECT sum(CAST(x > 0 AS INT)) AS links_a, sum(CAST(y > 0 AS INT)) AS links_b, round(covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0), 5) AS r, bool_and(abs(x - y) < 1e-9) AS equal FROM f",
    "wn_diff": f"WITH {C.POINTS}, {C.LENGTHS} SELECT sid, round(length, 6) AS length FROM lengths",
    "ag_orientation": f"WITH {C.POINTS}, {_V}, f AS (SELECT 'as is' AS o, roi AS v FROM points UNION ALL SELECT 'flipped', 24 - roi FROM points), dn AS (SELECT o, v, count(*) AS n FROM f GROUP BY 1, 2), x AS (SELECT o, dn.n, vol.n AS vol FROM dn LEFT JOIN vol ON dn.v = vol.roi) SELECT o, round(coalesce(sum(n) FILTER (vol IS NOT NULL), 0) / sum(n), 6) AS inside, round(covar_pop(ln(1 + n), coalesce(vol, 0)) / nullif(sqrt(var_pop(ln(1 + n)) * var_pop(coalesce(vol, 0))), 0), 5) AS r FROM x GROUP BY 1",
    "jn_point_atlas": _ATLAS,
    "jn_grid_nn": "WITH a AS (SELECT CAST(s_suppkey % 13 AS INT) AS vi, CAST(s_nationkey % 12 AS INT) AS vj, max(s_nationkey) AS label FROM supplier GROUP BY 1, 2), g AS (SELECT CAST(k % 30 AS INT) AS i, CAST(k // 30 AS INT) AS j FROM range(840) t(k)) SELECT i, j, coalesce(label, -1) AS label FROM g LEFT JOIN a ON vi = CAST(round_even(0.5 * i - 0.25, 0) AS INT) AND vj = CAST(round_even(0.5 * j - 0.25, 0) AS INT)",
    "mk_map_pts": f"WITH {C.POINTS} SELECT sid, p, round(0.5 * CAST(roi AS DOUBLE) + 0.1 * qty + 0.25, 6) AS x, round(qty / 4 - 1.5, 6) AS y, round(-0.2 * CAST(roi AS DOUBLE) + 2.0, 6) AS z FROM points",
    "snk_cache": f"WITH {C.POINTS} SELECT sid, CASE WHEN max(qty) < 256 THEN 'uint8' WHEN max(qty) < 32768 THEN 'int16' ELSE 'float32' END AS dtype, min(qty) AS least, max(qty) AS most FROM points GROUP BY 1",
    "src_fiber_cache": f"WITH {C.POINTS}, n AS (SELECT sid, count(*) AS n FROM points GROUP BY 1) SELECT sid, n, CAST(coalesce(sum(n) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM n",
}
