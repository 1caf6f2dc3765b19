"""The driver's tables as panels, matrices, points and grids, in Spark and as common table expressions in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.session import table

STEPS, HOURS, PEOPLE = 120, 6, 4
ORIGIN_US = 1_704_067_200_000_000  # 2024-01-01
WIDE = 64  # values of an embedding: all are nodes
STRETCH = 8192  # ids that are numbered in one task


def day(ts: Column) -> Column:
    """Days since the origin, whatever the session's time zone."""
    return F.unix_date(ts.cast("date")) - ORIGIN_US // 86_400_000_000


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant, node, t, x: events summed into 6-hour steps, missing steps 0."""
    ev = table(spark, sf_dir, "events")
    step = (day(F.col("ts")) * (24 // HOURS) + F.floor(F.hour("ts") / HOURS)).cast("int")
    cells = ev.where(F.col("event_type").isNotNull()).select((F.col("user_id") % PEOPLE).cast("int").alias("participant"), F.col("event_type").alias("kind"), step.alias("t"), "value")
    sums = cells.groupBy("participant", "kind", "t").agg(F.sum("value").alias("x"))
    kinds = sums.groupBy("participant", "kind").agg(F.count("*").alias("n"))
    node = (F.dense_rank().over(Window.partitionBy("participant").orderBy("kind")) - 1).cast("int")
    grid = kinds.select("participant", "kind", node.alias("node"), F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("t"))
    return grid.join(sums, ["participant", "kind", "t"], "left").select("participant", "node", "t", F.coalesce("x", F.lit(0.0)).alias("x"))


PANEL = f"""
pcells AS (SELECT CAST(user_id % {PEOPLE} AS INT) AS participant, event_type AS kind, CAST(floor((epoch_us(ts) - {ORIGIN_US}) / {HOURS * 3600000000}.0) AS INT) AS t, sum(value) AS x
  FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2, 3),
pgrid AS (SELECT participant, kind, node, CAST(unnest(range({STEPS})) AS INT) AS t FROM (
  SELECT participant, kind, CAST(dense_rank() OVER (PARTITION BY participant ORDER BY kind) - 1 AS INT) AS node FROM (SELECT DISTINCT participant, kind FROM pcells))),
panel AS (SELECT g.participant, g.node, g.t, coalesce(c.x, 0.0) AS x FROM pgrid g LEFT JOIN pcells c ON g.participant = c.participant AND g.kind = c.kind AND g.t = c.t)"""


def numbered(e: DataFrame) -> DataFrame:
    """Rows with t, their place among those of their label in id order: counts of stretches of ids, then places within a
    stretch, so no window runs over a whole label."""
    e = e.withColumn("part", F.floor(F.col("vec_id") / STRETCH))
    counts = e.groupBy("label", "part").agg(F.count("*").alias("k"))  # a row for each stretch
    w = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("label").alias("label_"), F.col("part").alias("part_"), F.coalesce(F.sum("k").over(w), F.lit(0)).alias("before"))
    t = (F.row_number().over(Window.partitionBy("label", "part").orderBy("vec_id")) - 1).cast("int")
    x = e.withColumn("t", t).join(before, F.col("label").eqNullSafe(F.col("label_")) & (F.col("part") == F.col("part_")))
    return x.withColumn("t", (F.col("before") + F.col("t")).cast("int")).drop("label_", "part_", "before", "part")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant, grp, t, node, x: embeddings of a label in id order as a series, all values as nodes."""
    rows = numbered(table(spark, sf_dir, "embeddings")).select(F.col("label").alias("participant"), (F.col("label") % 2).alias("grp"), "t", F.posexplode("embedding").alias("node", "v"))
    return rows.select("participant", "grp", "t", "node", F.col("v").cast("double").alias("x"))


WIDE_SQL = f"""
wide AS (SELECT label AS participant, label % 2 AS grp, t, CAST(node AS INT) AS node, CAST(embedding[node + 1] AS DOUBLE) AS x
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS t, unnest(range({WIDE})) AS node FROM embeddings))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, p, roi, part, qty: the lines of an order as the points of a path, the supplier's nation as region."""
    li = table(spark, sf_dir, "lineitem")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("roi"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return li.join(su, li.l_suppkey == su.s_suppkey).select(F.col("l_orderkey").alias("sid"), F.row_number().over(w).alias("p"), "roi", F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"))


POINTS = """
points AS (SELECT l_orderkey AS sid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS p, s_nationkey AS roi, l_partkey AS part, l_quantity AS qty
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, length: sum of distances between successive points of a path, 2 at least."""
    p = points(spark, sf_dir)
    nxt = Window.partitionBy("sid").orderBy("p")
    d = F.sqrt(F.pow(F.lead("roi").over(nxt) - F.col("roi"), 2) + F.pow((F.lead("qty").over(nxt) - F.col("qty")), 2))
    return p.select("sid", d.alias("d")).groupBy("sid").agg(F.greatest(F.coalesce(F.sum("d"), F.lit(0.0)), F.lit(2.0)).alias("length"))


LENGTHS = """
lengths AS (SELECT sid, greatest(coalesce(sum(d), 0.0), 2.0) AS length FROM (
  SELECT sid, sqrt(pow(lead(roi) OVER (PARTITION BY sid ORDER BY p) - roi, 2) + pow(lead(qty) OVER (PARTITION BY sid ORDER BY p) - qty, 2)) AS d FROM points) GROUP BY sid)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, label_id, name, hemisphere, network of the nations as parcels."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("pos"), (F.col("n_nationkey") + 1).alias("label_id"), F.col("n_name").alias("name"),
        F.when(F.col("n_nationkey") % 2 == 0, "L").otherwise("R").alias("hemisphere"), F.col("r_name").alias("network"),
    )


LABELS = """
labels AS (SELECT n_nationkey AS pos, n_nationkey + 1 AS label_id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'L' ELSE 'R' END AS hemisphere, r_name AS network
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G, a, ordinal, stage, valid, fit_rmse, fc_corr of a grid of part sizes and brands: the metrics are averages."""
    p = table(spark, sf_dir, "part")
    g = p.groupBy("p_size", "p_brand").agg(F.avg("p_retailprice").alias("m"), F.count("*").alias("n"))
    axis = F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("p_brand"))  # a row per size and brand: a small table
    g = g.select((F.col("p_size") / 10).alias("G"), F.round(-0.01 * axis, 10).alias("a"), F.when(F.col("p_size") <= 40, "coarse").when(F.col("p_size") <= 45, "extended").otherwise("refine").alias("stage"), "m", "n", "p_size")
    return g.select("G", "a", "stage", (F.col("n") % 7 != 0).alias("valid"), F.when(F.col("n") % 7 != 0, F.round(F.col("m") / 1000, 9)).alias("fit_rmse"), F.when(F.col("n") % 7 != 0, F.round(1 - F.col("m") / 4000, 9)).alias("fc_corr"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("G", F.desc("a"))).alias("ordinal"))


SEARCHED = """
grid0 AS (SELECT p_size, p_brand, avg(p_retailprice) AS m, count(*) AS n FROM part GROUP BY ALL),
grid1 AS (SELECT p_size / 10.0 AS G, round(-0.01 * dense_rank() OVER (ORDER BY p_brand), 10) AS a, CASE WHEN p_size <= 40 THEN 'coarse' WHEN p_size <= 45 THEN 'extended' ELSE 'refine' END AS stage, m, n FROM grid0),
searched AS (SELECT CAST(G AS DOUBLE) AS G, CAST(a AS DOUBLE) AS a, stage, n % 7 <> 0 AS valid, CASE WHEN n % 7 <> 0 THEN round(m / 1000, 9) END AS fit_rmse, CASE WHEN n % 7 <> 0 THEN round(1 - m / 4000, 9) END AS fc_corr,
  row_number() OVER (ORDER BY G, a DESC) AS ordinal FROM grid1)"""
