"""Matrices as edge tables (i, j, v): masks, projections, node sets, errors, statistics and the parameter search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators import signals as S
from loomspan.operators.paths import correlation, touched_pairs
from loomspan.operators.signals import r
from loomspan.plans import carriers as C
from loomspan.session import table

SC_MAX = 0.2
EDGE = ("participant", "i", "j")


# ---------------------------------------------------------------------------------------------------- masks, projections
def link_mask(sc: DataFrame, pairs: DataFrame) -> DataFrame:
    """Allowed links: those of the structure and the homotopic pairs both ways; never the diagonal."""
    hom = pairs.select(F.explode(F.array(F.struct(F.col("left_pos").alias("i"), F.col("right_pos").alias("j")), F.struct(F.col("right_pos").alias("i"), F.col("left_pos").alias("j")))).alias("e")).select("e.i", "e.j")
    return sc.where("v > 0").select("i", "j").union(hom).where("i <> j").distinct()


def initial_links(mask: DataFrame, sc: DataFrame) -> DataFrame:
    """Structure on the mask; allowed links that it lacks get a tenth of the greatest weight."""
    return mask.join(sc, ["i", "j"], "left").select("i", "j", F.coalesce(F.nullif(F.col("v"), F.lit(0.0)), F.lit(0.1 * SC_MAX)).alias("v"))


def projected(m: DataFrame, mask: DataFrame, top: float = SC_MAX) -> DataFrame:
    """Links off the mask, negative ones and the diagonal 0, greatest link ``top`` (per participant)."""
    x = m.join(mask.withColumn("ok", F.lit(True)), ["i", "j"], "left").select(*EDGE, F.when(F.col("ok") & (F.col("i") != F.col("j")), F.greatest("v", F.lit(0.0))).otherwise(0.0).alias("v"))
    g = x.groupBy("participant").agg(F.max("v").alias("g"))
    return x.join(g, "participant").select(*EDGE, F.coalesce(F.try_divide("v", "g"), F.lit(0.0)).alias("v")).withColumn("v", F.col("v") * top)


def _sc(spark, d):
    return touched_pairs(C.points(spark, d), C.path_lengths(spark, d)).where("count > 20").select("i", "j", r("lenw", 6).alias("v"))


def _pairs(spark, d):
    lab = C.labels(spark, d)
    side = lambda h, c: lab.where(F.col("hemisphere") == h).groupBy(F.floor(F.col("pos") / 2).alias("key")).agg(F.max("pos").alias(c))
    return side("L", "left_pos").join(side("R", "right_pos"), "key").select("left_pos", "right_pos")


def flt_mask(spark, d):
    return link_mask(_sc(spark, d), _pairs(spark, d))


def prj_init_ec(spark, d):
    return initial_links(flt_mask(spark, d), _sc(spark, d)).select("i", "j", r("v").alias("v"))


def _fc(spark, d):
    return S.connectivity(C.wide(spark, d)).withColumnRenamed("fc", "v")


def prj_project(spark, d):
    m = _fc(spark, d)
    mask = m.where("participant = 0 AND v > -0.1").select("i", "j")
    return projected(m, mask).select(*EDGE, r("v", 5).alias("v"))


def prj_zscore(spark, d):
    """z of a parcel map over the parcels that have a value (population sd), 0 where it is missing."""
    v = table(spark, d, "supplier").where("s_nationkey % 6 <> 0").groupBy(F.col("s_nationkey").alias("pos")).agg(F.avg("s_acctbal").alias("value"))
    x = C.labels(spark, d).select("pos").join(v, "pos", "left").withColumn("k", F.lit(1))
    s = x.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")).withColumn("k", F.lit(1))
    return x.join(F.broadcast(s), "k").select("pos", r(F.coalesce(F.try_divide(F.col("value") - F.col("m"), "sd"), F.lit(0.0))).alias("z"))  # one row


def prj_hetero_a(spark, d):
    """a0 + slope times map, kept within -0.9 and 0.9."""
    z = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("pos")).agg((F.avg("s_acctbal") / 4000).alias("z"))
    return z.select("pos", r(F.least(F.greatest(-0.1 + 0.5 * F.col("z"), F.lit(-0.9)), F.lit(0.9))).alias("a"))


def linspace(spark, start: float, stop: float, step: float) -> DataFrame:
    """start, start + step .. stop (within a slack of 1e-9 steps)."""
    n = int((stop - start) / step + 1e-9)
    return spark.range(n + 1).select(F.col("id").alias("k"), (F.lit(start) + F.col("id") * F.lit(step)).alias("value"))


def prj_linspace(spark, d):
    """Grid of each brand: from its least to its greatest size in steps of 0.5."""
    s = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    return s.select("p_brand", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / 0.5 + 1e-9).cast("int")), lambda k: F.col("lo") + 0.5 * k)).alias("value"))


def prj_triu(spark, d):
    return _fc(spark, d).where("i < j").select(*EDGE, r("v").alias("v"))


def prj_offdiag(spark, d):
    return _fc(spark, d).where("i <> j").select(*EDGE, r("v").alias("v"))


def jn_cross_grid(spark, d):
    """Every G with every a (by exploding the second axis, no cross join) for each brand's size range."""
    s = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_size").alias("lo"))
    g = s.select("p_brand", F.explode(F.sequence(F.col("lo"), F.col("lo") + 4)).alias("g"))
    return g.select("p_brand", (F.col("g") / 10).alias("G"), F.explode(F.array(*[F.lit(x) for x in (-0.05, -0.02, 0.0)])).alias("a"))


def jn_expand(spark, d):
    """Matrix of the kept nodes on the full atlas, NaN where a node was dropped."""
    m = _sc(spark, d)
    keep = C.labels(spark, d).where("label_id % 4 <> 0").select("pos")
    kept = m.join(keep.withColumnRenamed("pos", "i"), "i", "left_semi").join(keep.withColumnRenamed("pos", "j"), "j", "left_semi")
    grid = C.labels(spark, d).select(F.col("pos").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("j"))
    return grid.join(kept, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(float("nan"))).alias("v"))


# ---------------------------------------------------------------------------------------------------- errors
def _two(spark, d):
    """participant, i, j, x, y, tx, ty: connectivity and lagged correlation of a participant and of the next one."""
    w = C.wide(spark, d)
    a = S.connectivity(w).join(S.lagged_correlation(w, [1]).drop("lag"), list(EDGE))
    b = a.select((F.col("participant") - 1).alias("participant"), "i", "j", F.col("fc").alias("y"), F.col("v").alias("ty"))
    return a.select("participant", "i", "j", F.col("fc").alias("x"), F.col("v").alias("tx")).join(b, list(EDGE))


def rms(c: Column) -> Column:
    return F.sqrt(F.avg(c * c))


def fit_error(two: DataFrame) -> DataFrame:
    off, up = F.col("i") != F.col("j"), F.col("i") < F.col("j")
    e = two.groupBy("participant").agg(
        rms(F.when(off, F.col("x") - F.col("y"))).alias("fc_rmse"), rms(F.col("tx") - F.col("ty")).alias("tau_rmse"),
        correlation(F.when(up, F.col("x")), F.when(up, F.col("y"))).alias("fc_corr"), correlation("tx", "ty").alias("tau_corr"),
    )
    return e.withColumn("fit_rmse", F.sqrt(0.5 * (F.pow("fc_rmse", 2) + F.pow("tau_rmse", 2))))


def ag_fit_error(spark, d):
    e = fit_error(_two(spark, d))
    return e.select("participant", *[r(c, 5).alias(c) for c in ("fc_rmse", "tau_rmse", "fit_rmse", "fc_corr", "tau_corr")])


def ag_rmse(spark, d):
    return _two(spark, d).groupBy("participant").agg(r(rms(F.col("x") - F.col("y")), 5).alias("rmse"))


def ag_corr_upper(spark, d):
    return _two(spark, d).where("i < j").groupBy("participant").agg(r(correlation("x", "y"), 5).alias("r"))


def ag_ndte_sim(spark, d):
    return _two(spark, d).where("i <> j").groupBy("participant").agg(r(correlation("tx", "ty"), 5).alias("ndte_corr"), r(rms(F.col("tx") - F.col("ty")), 5).alias("ndte_rmse"))


def ag_tau_all(spark, d):
    """Mean over lags of the error of the lagged correlations."""
    v = S.lagged_correlation(C.wide(spark, d), [1, 2, 3])
    b = v.select((F.col("participant") - 1).alias("participant"), "lag", "i", "j", F.col("v").alias("y"))
    e = v.join(b, ["participant", "lag", "i", "j"]).groupBy("participant", "lag").agg(rms(F.col("v") - F.col("y")).alias("e"))
    return e.groupBy("participant").agg(r(F.avg("e"), 5).alias("tau_rmse_all"))


# ---------------------------------------------------------------------------------------------------- nodes
def flt_validity(spark, d):
    """A node is valid in a run when all its values are numbers and differ."""
    v = table(spark, d, "ts_panel").distinct().select("path", F.posexplode(F.slice("x", 1, 4)).alias("node", "v"))
    ok = F.bool_and(F.col("v").isNotNull() & ~F.isnan(F.coalesce("v", F.lit(0.0)))) & (F.coalesce(F.max("v") - F.min("v"), F.lit(0.0)) > 0)
    return v.groupBy("path", "node").agg(ok.alias("valid"))


def _valid(spark, d):
    v = flt_validity(spark, d)
    sub = F.regexp_extract("path", r"(sub-[A-Za-z0-9]+)_", 1)
    return v.select(sub.alias("sub"), "node", "valid")


def ag_scan_valid(spark, d):
    """Valid in all runs of a subject."""
    return _valid(spark, d).groupBy("sub", "node").agg(F.bool_and("valid").alias("valid"))


def _coverage(spark, d):
    return ag_scan_valid(spark, d).groupBy("node").agg(F.avg(F.col("valid").cast("int")).alias("coverage"), F.count("*").alias("n"))


def ag_coverage(spark, d):
    """Share of subjects in which a node is valid, kept from half on; subjects that lack a kept node are counted."""
    c = _coverage(spark, d)
    lost = ag_scan_valid(spark, d).where("NOT valid").join(c.where("coverage >= 0.5"), "node").groupBy("node").agg(F.count("*").alias("n_excluded"))
    return c.join(lost, "node", "left").select("node", r("coverage").alias("coverage"), (F.col("coverage") >= 0.5).alias("kept"), F.coalesce("n_excluded", F.lit(0)).alias("n_excluded"))


def flt_dummy(spark, d):
    """Volumes after the flagged first ones, numbered anew."""
    v = table(spark, d, "confound_volumes").select("tag", "t", "trans_x", "non_steady_state_outlier").distinct()
    n = v.groupBy("tag").agg(F.sum("non_steady_state_outlier").alias("n"))
    return v.join(n, "tag").where(F.col("t") >= F.col("n")).groupBy("tag").agg(F.count("*").alias("n"), F.min(F.col("t") - F.col("n")).alias("first"), F.max(F.col("t") - F.col("n")).alias("last"))


def flt_short_runs(spark, d):
    """Runs too short or with a constant series: the reason, null for usable ones."""
    v = table(spark, d, "confound_volumes").select("tag", "t", "trans_x", "trans_y").distinct()
    g = v.groupBy("tag").agg(F.countDistinct("t").alias("n"), F.max("trans_y").alias("hi"), F.min("trans_y").alias("lo"))
    return g.select("tag", "n", F.when(F.col("n") < 90, "too short").when(F.col("hi") <= F.col("lo"), "constant").alias("reason"))


def prj_spikes(spark, d):
    """One column per volume of large displacement, as rows (t, spike), and the share of such volumes."""
    v = table(spark, d, "confound_volumes").select("tag", "t", "framewise_displacement").distinct()
    hot = v.where("framewise_displacement > 0.5 AND NOT isnan(framewise_displacement)")
    return hot.select("tag", "t", (F.row_number().over(Window.partitionBy("tag").orderBy("t")) - 1).alias("spike"), F.lit(1.0).alias("v"))


def prj_confounds(spark, d):
    """Components of each dataset's files by explained variance, the best two of each mask, those retained only."""
    from loomspan.operators.drift import unified

    f = table(spark, d, "confound_files").select("run_id", "dataset", "seq", "body", "json_body").dropDuplicates(["run_id", "dataset", "seq"])
    c = unified(f, "confounds_json").select("run_id", "component", F.col("Mask").cast("string").alias("mask"), F.col("VarianceExplained").cast("string").try_cast("double").alias("ve"))
    w = Window.partitionBy("run_id", "mask").orderBy(F.desc("ve"), "component")
    return c.where("mask IS NOT NULL AND ve IS NOT NULL").withColumn("k", F.row_number().over(w)).where("k <= 2").select("run_id", "mask", "component", "k")


def wn_rank_acompcor(spark, d):
    """The n best of each group by value (ties by name)."""
    w = Window.partitionBy("p_brand", "p_size").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("k", F.row_number().over(w)).where("k <= 2").select("p_brand", "p_size", "p_partkey", "k")


def sl_acompcor(spark, d):
    """The n best of the retained ones only, whatever their group (ties by name)."""
    kept = table(spark, d, "part").where("p_size > 10")
    best = kept.withColumn("g", F.pmod("p_partkey", F.lit(64))).withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("p_retailprice"), "p_partkey"))).where("k <= 5")  # 5 of each part, then 5 of those
    return best.select("p_partkey", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("k")).where("k <= 5")


# ---------------------------------------------------------------------------------------------------- group statistics
def _groups(spark, d):
    w = C.wide(spark, d)
    return _fc(spark, d).join(w.select("participant", "grp").distinct(), "participant").where("i <> j")


def welch(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, df, mean_0, mean_1 of grp 0 against grp 1; NaN and nulls left out; null t where a variance is missing."""
    v = F.when(~F.isnan("v"), F.col("v"))
    side = lambda k: F.when(F.col("grp") == k, v)
    g = values.groupBy(*keys).agg(*[f(side(k)).alias(f"{n}{k}") for k in (0, 1) for f, n in ((F.avg, "m"), (F.var_samp, "s"), (F.count, "n"))])
    e0, e1 = F.try_divide("s0", "n0"), F.try_divide("s1", "n1")
    df = F.try_divide(F.pow(e0 + e1, 2), F.try_divide(e0 * e0, F.col("n0") - 1) + F.try_divide(e1 * e1, F.col("n1") - 1))
    return g.select(*keys, F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(e0 + e1)).alias("t"), df.alias("df"), F.col("m0").alias("mean_0"), F.col("m1").alias("mean_1"))


def ag_welch(spark, d):
    return welch(_groups(spark, d), ["i", "j"]).select("i", "j", *[r(c, 4).alias(c) for c in ("t", "df", "mean_0", "mean_1")])


def ag_strength(spark, d):
    """Mean link and asymmetry of each participant's lagged correlations over the off-diagonal."""
    v = S.lagged_correlation(C.wide(spark, d), [1]).where("i <> j")
    b = v.select("participant", F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("back"))
    g = v.join(b, list(EDGE)).groupBy("participant").agg(F.avg("v").alias("m"), F.avg(F.abs(F.col("v") - F.col("back"))).alias("a"))
    return g.select("participant", r("m").alias("mean_strength"), r(F.col("a") / (F.abs("m") + 1e-12), 3).alias("asymmetry"))


def fdr(values: DataFrame, q: float) -> DataFrame:
    """key, p -> rejections by Benjamini-Hochberg: ranks by p (non-finite last), all ranks up to the last with p <= q rank / n.

    Equal p are counted once (their last rank decides), ranges of p give their counts first: no window over all rows."""
    ok = F.col("p").isNotNull() & ~F.isnan("p")
    c = values.where(ok).groupBy("p").agg(F.count("*").alias("c")).withColumn("b", F.floor(F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)) * 1023))
    before = c.groupBy("b").agg(F.sum("c").alias("s")).select("b", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s0"), F.sum("s").over(Window.partitionBy(F.lit(1))).alias("n"))
    ranked = c.join(before, "b").withColumn("rank", F.col("s0") + F.sum("c").over(Window.partitionBy("b").orderBy("p")))
    last = ranked.where(F.col("p") <= q * F.col("rank") / F.col("n")).agg(F.max("p").alias("limit")).withColumn("k", F.lit(1))
    return values.withColumn("k", F.lit(1)).join(F.broadcast(last), "k").drop("k").withColumn("reject", F.coalesce(ok & (F.col("p") <= F.col("limit")), F.lit(False))).drop("limit")  # one row


def wn_rank_fdr(spark, d):
    """p of an order from its total price's share; rejections at 0.05 and their number."""
    o = table(spark, d, "orders").select("o_orderkey", (F.pow(F.col("o_totalprice") / 500000.0, 3)).alias("p"))
    return fdr(o, 0.05).groupBy("reject").agg(F.count("*").alias("n"), r(F.max("p"), 9).alias("p_max"))


def _flow(spark, d):
    """Directed flow between nodes: absolute lagged correlation, links above 0.05 count as significant."""
    return S.lagged_correlation(C.wide(spark, d), [1]).where("i <> j").select("participant", "i", "j", F.abs("v").alias("v"))


def flows(flow: DataFrame) -> DataFrame:
    """in (row), out (column) and total flow of the significant links of each node."""
    f = flow.withColumn("s", F.when(F.col("v") > 0.05, F.col("v")).otherwise(0.0))
    both = f.select("participant", F.col("i").alias("region"), F.col("s").alias("a"), F.lit(0.0).alias("b")).union(f.select("participant", "j", F.lit(0.0), "s"))
    g = both.groupBy("participant", "region").agg(F.sum("a").alias("in_flow"), F.sum("b").alias("out_flow"))
    return g.withColumn("total_flow", F.col("in_flow") + F.col("out_flow"))


def ag_flows(spark, d):
    return flows(_flow(spark, d)).select("participant", "region", *[r(c, 5).alias(c) for c in ("in_flow", "out_flow", "total_flow")])


def sl_flow_sort(spark, d):
    """The table of flows with each region's place, greatest total flow first (ties by participant and region)."""
    f = flows(_flow(spark, d)).withColumn("key", F.round("total_flow", 9))
    blocks = f.groupBy("key").agg(F.count("*").alias("n"))  # places start from counts of equal flows
    first = blocks.select("key", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("key")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy("key").orderBy("participant", "region")
    return f.join(first, "key").select((F.col("before") + F.row_number().over(w)).alias("place"), "participant", "region", r("total_flow", 5).alias("total_flow"))


def sl_top_regions(spark, d):
    """The three regions of the greatest total flow of each participant (ties by region)."""
    w = Window.partitionBy("participant").orderBy(F.desc(F.round("total_flow", 9)), "region")
    return flows(_flow(spark, d)).withColumn("k", F.row_number().over(w)).where("k <= 3").select("participant", "k", "region", r("total_flow", 5).alias("total_flow"))


def ag_surrogate_stats(spark, d):
    """Mean, population sd, z and empirical p of each link against surrogates (its correlations at other lags)."""
    v = _flow(spark, d)
    s = S.lagged_correlation(C.wide(spark, d), list(range(3, 12))).where("i <> j").select("participant", "i", "j", F.abs("v").alias("s"))
    g = s.join(v, list(EDGE)).groupBy(*EDGE).agg(F.first("v").alias("v"), F.avg("s").alias("mu"), F.stddev_pop("s").alias("sd"), F.count("*").alias("n"), F.sum((F.col("s") >= F.col("v")).cast("int")).alias("ge"))
    return g.select(*EDGE, r("mu", 5).alias("mu"), r("sd", 5).alias("sd"), r(F.coalesce(F.try_divide(F.col("v") - F.col("mu"), "sd"), F.lit(0.0)), 3).alias("z"), r((1 + F.col("ge")) / (1 + F.col("n"))).alias("p_emp"))


def ag_ndte_group(spark, d):
    g = _flow(spark, d).join(C.wide(spark, d).select("participant", "grp").distinct(), "participant")
    return S._with_all(g, "grp").groupBy("grp", "i", "j").agg(r(F.avg("v"), 5).alias("mean"), r(F.avg((F.col("v") > 0.05).cast("int")), 5).alias("share"), F.count("*").alias("n"))


# ---------------------------------------------------------------------------------------------------- parameter search
def select_best(points: DataFrame, metric: str, higher: bool = False) -> DataFrame:
    """Best valid point: G = 0 only where nothing else is valid, first of equal ones."""
    ok = points.where(F.col("valid") & F.col(metric).isNotNull())
    key = F.struct((F.col("G") <= 0).cast("int"), (-F.col(metric) if higher else F.col(metric)), F.col("ordinal"))
    return ok.agg(F.min_by(F.struct("G", "a", F.col(metric).alias("value"), "ordinal"), key).alias("b")).select("b.*")


def sl_best(spark, d):
    s = C.searched(spark, d)
    a = select_best(s, "fit_rmse").withColumn("metric", F.lit("fit_rmse"))
    return a.union(select_best(s, "fc_corr", True).withColumn("metric", F.lit("fc_corr")))


def axis_values(points: DataFrame, axis: str) -> DataFrame:
    return points.groupBy(axis).agg(F.bool_or("valid").alias("any_valid"))


def wn_axis_step(spark, d):
    v = axis_values(C.searched(spark, d), "G")
    step = F.col("G") - F.lag("G").over(Window.orderBy("G"))  # one row per value of an axis
    return v.select(step.alias("s")).where("s > 1e-12").agg(r(F.min("s"), 9).alias("step"))


def wn_border(spark, d):
    """For the best point: edge, invalid or null on either side of each axis."""
    s = C.searched(spark, d)
    best = select_best(s, "fit_rmse")
    out = None
    for axis in ("G", "a"):
        w = Window.orderBy(axis)
        v = axis_values(s, axis).select(F.col(axis).alias("v"), F.lag("any_valid").over(w).alias("below"), F.lead("any_valid").over(w).alias("above"))
        flag = lambda c: F.when(F.col(c).isNull(), "edge").when(~F.col(c), "invalid")
        x = best.select(F.col(axis).alias("v")).join(v, "v").select(F.lit(axis).alias("axis"), flag("below").alias("low"), flag("above").alias("high"))
        out = x if out is None else out.union(x)
    return out


def wn_extend(spark, d):
    """Values beyond the upper edge: a share of the span in steps, at least one, within the cap."""
    v = axis_values(C.searched(spark, d), "G").agg(F.min("G").alias("lo"), F.max("G").alias("hi"), (F.count("*") - 1).alias("n"))
    v = v.withColumn("step", F.round((F.col("hi") - F.col("lo")) / F.col("n"), 10)).withColumn("m", F.greatest(F.lit(1), F.rint(0.5 * (F.col("hi") - F.col("lo")) / F.col("step")).cast("int")))
    return v.select(F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.col("m")), lambda k: F.round(F.col("hi") + F.col("step") * k, 10)), lambda x: x <= 10 + 1e-12)).alias("G"))


def wn_refine(spark, d):
    """Seven values within one step of the best G, known ones left out."""
    s = C.searched(spark, d)
    best = select_best(s, "fit_rmse").select(F.col("G").alias("c"))
    fine = best.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.round(F.col("c") - 0.1 + k * (0.2 / 6), 9))).alias("G"))
    known = s.select(F.round("G", 9).alias("G")).distinct()
    return fine.join(known, "G", "left_anti")


def jn_not_known(spark, d):
    s = C.searched(spark, d)
    new = s.select(F.round(F.col("G") + F.when(F.col("ordinal") % 3 == 0, 0.05).otherwise(0.0), 9).alias("G"), F.round("a", 9).alias("a")).distinct()
    return new.join(s.select(F.round("G", 9).alias("G"), F.round("a", 9).alias("a")).distinct(), ["G", "a"], "left_anti")


def wn_parabola(spark, d):
    """Vertex through each point and its neighbours along G: bracketed minima only."""
    w = Window.partitionBy("a").orderBy("G")
    p = C.searched(spark, d).where("fit_rmse IS NOT NULL").select("a", F.lag("G").over(w).alias("x0"), F.col("G").alias("x1"), F.lead("G").over(w).alias("x2"), F.lag("fit_rmse").over(w).alias("y0"), F.col("fit_rmse").alias("y1"), F.lead("fit_rmse").over(w).alias("y2"))
    den = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y2")) - (F.col("x1") - F.col("x2")) * (F.col("y1") - F.col("y0"))
    num = F.pow(F.col("x1") - F.col("x0"), 2) * (F.col("y1") - F.col("y2")) - F.pow(F.col("x1") - F.col("x2"), 2) * (F.col("y1") - F.col("y0"))
    bend = ((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")) - (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))) / (F.col("x2") - F.col("x0"))
    p = p.where("x0 IS NOT NULL AND x2 IS NOT NULL").select("a", "x0", "x1", "x2", F.try_divide(num, F.when(F.abs(den) >= 1e-18, den)).alias("q"), bend.alias("c2"))
    return p.withColumn("vertex", F.col("x1") - 0.5 * F.col("q")).where("c2 > 0 AND vertex > x0 AND vertex < x2").select("a", r("x1").alias("G"), r("vertex", 4).alias("vertex"))


def so_error_surface(spark, d):
    """Metric as a matrix: rows G, a column for each of the first four a; stages coarse and extended only."""
    s = C.searched(spark, d).where("stage IN ('coarse', 'extended')")
    return s.groupBy(r("G", 3).alias("G")).pivot("a", [-0.01, -0.02, -0.03, -0.04]).agg(F.first("fit_rmse")).toDF("G", "a1", "a2", "a3", "a4")


def ag_search_summary(spark, d):
    return C.searched(spark, d).groupBy("stage").agg(F.count("*").alias("n"), F.sum((~F.col("valid")).cast("int")).alias("n_invalid"))


def snk_search(spark, d):
    return C.searched(spark, d).select("ordinal", r("G").alias("G"), r("a").alias("a"), "stage", "valid", "fit_rmse", "fc_corr")


# ---------------------------------------------------------------------------------------------------- matrices in and out
def snk_matrix(spark, d):
    """Edge table as a matrix, a row for each i."""
    columns = [f"c{k}" for k in range(C.WIDE)]
    return _fc(spark, d).groupBy("participant", "i").pivot("j", list(range(C.WIDE))).agg(F.first(r("v", 5))).toDF("participant", "i", *columns)


def snk_timeseries(spark, d):
    return C.panel(spark, d).where("node < 3").groupBy("participant", "t").pivot("node", [0, 1, 2]).agg(F.first(r("x", 4))).toDF("participant", "t", "r0", "r1", "r2")


def src_timeseries(spark, d):
    """Wide rows of a series file to long ones."""
    w = table(spark, d, "confound_volumes").select("tag", "t", "trans_x", "trans_y", "trans_z").distinct()
    return w.unpivot(["tag", "t"], ["trans_x", "trans_y", "trans_z"], "node", "x").groupBy("tag", "node").agg(F.count("x").alias("n"), r(F.max("x"), 6).alias("most"))


def src_matrix(spark, d):
    """Rows of text to (i, j, v)."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 4).cast("string")), "\t").alias("line"))
    return e.select("i", F.posexplode(F.split("line", "\t")).alias("j", "s")).select("i", "j", r(F.col("s").cast("double"), 4).alias("v"))


def src_mrtrix_csv(spark, d):
    """The same from comma-separated lines."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 4).cast("string")), ",").alias("line"))
    return e.select("i", F.posexplode(F.split("line", ",")).alias("j", "s")).select("i", "j", r(F.col("s").cast("double"), 4).alias("v"))


def src_parcel_map(spark, d):
    """Values to parcels by name; ``n/a`` is missing."""
    v = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("v")).select("s_nationkey", F.when(F.col("s_nationkey") % 5 == 0, "n/a").otherwise(F.round("v", 4).cast("string")).alias("text"))
    lab = C.labels(spark, d)
    named = v.join(lab.select(F.col("pos").alias("s_nationkey"), "name"), "s_nationkey").select("name", F.col("text").try_cast("double").alias("value"))
    return lab.select("pos", "name").join(named, "name", "left")


def src_map(spark, d):
    """The map's values as z-scores over the parcels that have one (sd 0 counts as 1), and how many have none."""
    m = src_parcel_map(spark, d)
    s = m.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"), F.count_if(F.col("value").isNull()).alias("n_missing"))
    x = m.withColumn("k", F.lit(1)).join(F.broadcast(s.withColumn("k", F.lit(1))), "k")  # one row
    return x.select("pos", "name", r((F.col("value") - F.col("m")) / F.coalesce(F.nullif("sd", F.lit(0.0)), F.lit(1.0)), 5).alias("z"), "n_missing")


def snk_labels(spark, d):
    return C.labels(spark, d).select(F.concat_ws("\t", F.col("label_id").cast("string"), "name", "hemisphere", "network").alias("line"))


def snk_json(spark, d):
    """Records with NaN as null."""
    x = jn_expand(spark, d).where("i < 5 AND j < 5")
    return x.select("i", "j", F.nanvl("v", F.lit(None).cast("double")).alias("v"))


def snk_qsirecon(spark, d):
    return _sc(spark, d)


def snk_plots(spark, d):
    """The data behind the figures: log10 of the links, asymmetry, both over the upper triangle."""
    m = _sc(spark, d)
    b = m.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("back"))
    return m.join(b, ["i", "j"]).where("i < j").select("i", "j", r(F.log10("v"), 5).alias("log10"), r(F.col("v") - F.col("back"), 5).alias("asymmetry"))


def mk_jacobian(spark, d):
    """Entries of the 2N x 2N block matrix of the linearised model on the structure scaled to 0.2."""
    m = _sc(spark, d)
    g = m.agg(F.max("v").alias("g")).withColumn("k", F.lit(1))
    c = m.withColumn("k", F.lit(1)).join(F.broadcast(g), "k").select("i", "j", (F.col("v") / F.col("g") * 0.2).alias("v"))  # one row
    s = c.groupBy("i").agg(F.sum("v").alias("s"))
    n = C.labels(spark, d).select(F.col("pos").alias("i")).join(s, "i", "left").select("i", F.coalesce("s", F.lit(0.0)).alias("s"))
    w = 0.2 + 0.01 * F.col("i")
    diag = n.select("i", F.explode(F.array(
        F.struct(F.col("i").alias("a"), F.col("i").alias("b"), (-0.02 - F.col("s")).alias("v")), F.struct((F.col("i") + 25).alias("a"), (F.col("i") + 25).alias("b"), (-0.02 - F.col("s")).alias("v")),
        F.struct(F.col("i").alias("a"), (F.col("i") + 25).alias("b"), (-w).alias("v")), F.struct((F.col("i") + 25).alias("a"), F.col("i").alias("b"), w.alias("v")),
    )).alias("e")).select("e.*")
    off = c.where("i <> j").select(F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b"), "v"), F.struct((F.col("i") + 25).alias("a"), (F.col("j") + 25).alias("b"), "v"))).alias("e")).select("e.*")
    return diag.union(off).select("a", "b", r("v", 5).alias("v"))


QUERIES = {
    k: f
    for k, f in list(globals().items())
    if callable(f) and k.split("_")[0] in ("flt", "prj", "jn", "ag", "wn", "sl", "so", "snk", "src", "mk") and getattr(f, "__module__", "") == __name__
}

from loomspan.operators.paths import _T  # noqa: E402
from loomspan.operators.signals import _WCEN, _r  # noqa: E402

_SCQ = f"{_T}, sc AS (SELECT i, j, {_r('lenw')} AS v FROM touched WHERE count > 20)"
_MASK = f"{_SCQ}, {C.LABELS}, hp AS (SELECT l.pos AS a, q.pos AS b FROM (SELECT pos // 2 AS k, max(pos) AS pos FROM labels WHERE hemisphere = 'L' GROUP BY 1) l JOIN (SELECT pos // 2 AS k, max(pos) AS pos FROM labels WHERE hemisphere = 'R' GROUP BY 1) q ON l.k = q.k), mask AS (SELECT i, j FROM sc WHERE v > 0 AND i <> j UNION SELECT a, b FROM hp UNION SELECT b, a FROM hp)"


def _wl(lags: str) -> str:
    return f"wq AS (SELECT participant, node, sum(x * x) AS q, count(*) AS n FROM wcen GROUP BY 1, 2), wl AS (SELECT a.participant, lag, a.node AS i, b.node AS j, coalesce(sum(a.x * b.x) / (max(p.n) - lag) / nullif(sqrt(max(p.q) / max(p.n) * max(q.q) / max(q.n)), 0), 0) AS v FROM (SELECT *, unnest({lags}) AS lag FROM wcen) a JOIN wcen b ON a.participant = b.participant AND a.t - lag = b.t JOIN wq p ON p.participant = a.participant AND p.node = a.node JOIN wq q ON q.participant = b.participant AND q.node = b.node GROUP BY 1, 2, 3, 4)"


_TWO = f"{_WCEN}, {_wl('[1]')}, two AS (SELECT a.participant, a.i, a.j, a.fc AS x, b.fc AS y, c.v AS tx, e.v AS ty FROM wf a JOIN wf b ON a.participant = b.participant - 1 AND a.i = b.i AND a.j = b.j JOIN wl c ON c.participant = a.participant AND c.i = a.i AND c.j = a.j JOIN wl e ON e.participant = b.participant AND e.i = a.i AND e.j = a.j)"


def _corr(x: str, y: str, cond: str = "true") -> str:
    return f"covar_pop({x}, {y}) FILTER ({cond}) / nullif(sqrt(var_pop({x}) FILTER ({cond}) * var_pop({y}) FILTER ({cond})), 0)"


_VALID = r"nv AS (SELECT path, node, bool_and(v IS NOT NULL AND NOT isnan(coalesce(v, 0))) AND coalesce(max(v) - min(v), 0) > 0 AS valid FROM (SELECT path, unnest(range(4)) AS node, unnest([x[1], x[2], x[3], x[4]]) AS v FROM (SELECT DISTINCT * FROM ts_panel)) GROUP BY 1, 2), sv AS (SELECT regexp_extract(path, '(sub-[A-Za-z0-9]+)_', 1) AS sub, node, bool_and(valid) AS valid FROM nv GROUP BY 1, 2)"
_FLOW = f"{_WCEN}, {_wl('[1]')}, flow AS (SELECT participant, i, j, abs(v) AS v FROM wl WHERE i <> j), fl AS (SELECT participant, region, sum(a) AS in_flow, sum(b) AS out_flow FROM (SELECT participant, i AS region, CASE WHEN v > 0.05 THEN v ELSE 0 END AS a, 0.0 AS b FROM flow UNION ALL SELECT participant, j, 0.0, CASE WHEN v > 0.05 THEN v ELSE 0 END FROM flow) GROUP BY 1, 2)"
_FLOWQ = f"WITH {_FLOW} SELECT participant, region, {_r('in_flow', 5)} AS in_flow, {_r('out_flow', 5)} AS out_flow, {_r('in_flow + out_flow', 5)} AS total_flow FROM fl"
_ACOMP = "SELECT p_brand, p_size, p_partkey, row_number() OVER w AS k FROM part WINDOW w AS (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey) QUALIFY k <= 2"
_BEST = "(SELECT G, a, fit_rmse AS value, ordinal FROM searched WHERE valid AND fit_rmse IS NOT NULL ORDER BY CASE WHEN G <= 0 THEN 1 ELSE 0 END, fit_rmse, ordinal LIMIT 1)"
_PMAP = f"WITH {C.LABELS}, v AS (SELECT s_nationkey, avg(s_acctbal) AS v FROM supplier GROUP BY 1) SELECT pos, name, CASE WHEN s_nationkey % 5 <> 0 THEN round(v, 4) END AS value FROM labels LEFT JOIN v ON pos = s_nationkey"
_MAT = "SELECT vec_id AS i, CAST(unnest(range(len(embedding))) AS INT) AS j, round(CAST(unnest(embedding) AS DOUBLE), 4) + 0.0 AS v FROM embeddings"


def _axis(axis: str) -> str:
    return f"(SELECT '{axis}' AS axis, CASE WHEN below IS NULL THEN 'edge' WHEN NOT below THEN 'invalid' END AS low, CASE WHEN above IS NULL THEN 'edge' WHEN NOT above THEN 'invalid' END AS high FROM (SELECT {axis} AS v, lag(bool_or(valid)) OVER (ORDER BY {axis}) AS below, lead(bool_or(valid)) OVER (ORDER BY {axis}) AS above FROM searched GROUP BY {axis}) WHERE v = (SELECT {axis} FROM {_BEST}))"


SQL = {
    "flt_mask": f"WITH {_MASK} SELECT i, j FROM mask",
    "prj_init_ec": f"WITH {_MASK} SELECT m.i, m.j, {_r('coalesce(nullif(v, 0), 0.02)')} AS v FROM mask m LEFT JOIN sc s ON m.i = s.i AND m.j = s.j",
    "prj_project": f"WITH {_WCEN}, ok AS (SELECT i, j FROM wf WHERE participant = 0 AND fc > -0.1), x AS (SELECT participant, wf.i, wf.j, CASE WHEN ok.i IS NOT NULL AND wf.i <> wf.j THEN greatest(fc, 0) ELSE 0 END AS v FROM wf LEFT JOIN ok ON wf.i = ok.i AND wf.j = ok.j) SELECT participant, i, j, {_r('coalesce(v / nullif(max(v) OVER (PARTITION BY participant), 0), 0) * 0.2', 5)} AS v FROM x",
    "prj_zscore": f"WITH {C.LABELS}, v AS (SELECT s_nationkey, avg(s_acctbal) AS value FROM supplier WHERE s_nationkey % 6 <> 0 GROUP BY 1) SELECT pos, {_r('coalesce((value - avg(value) OVER ()) / nullif(stddev_pop(value) OVER (), 0), 0)')} AS z FROM labels LEFT JOIN v ON pos = s_nationkey",
    "prj_hetero_a": f"SELECT s_nationkey AS pos, {_r('least(greatest(-0.1 + 0.5 * (avg(s_acctbal) / 4000), -0.9), 0.9)')} AS a FROM supplier GROUP BY 1",
    "prj_linspace": "SELECT p_brand, lo + 0.5 * unnest(range(CAST(floor((hi - lo) / 0.5 + 1e-9) AS INT) + 1)) AS value FROM (SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1)",
    "prj_triu": f"WITH {_WCEN} SELECT participant, i, j, {_r('fc')} AS v FROM wf WHERE i < j",
    "prj_offdiag": f"WITH {_WCEN} SELECT participant, i, j, {_r('fc')} AS v FROM wf WHERE i <> j",
    "jn_cross_grid": "SELECT p_brand, (lo + g) / 10.0 AS G, CAST(a AS DOUBLE) AS a FROM (SELECT p_brand, min(p_size) AS lo FROM part GROUP BY 1), (SELECT unnest(range(5)) AS g), (SELECT unnest([-0.05, -0.02, 0.0]) AS a)",
    "jn_expand": f"WITH {_SCQ}, {C.LABELS}, keep AS (SELECT pos FROM labels WHERE label_id % 4 <> 0), kept AS (SELECT * FROM sc WHERE i IN (SELECT pos FROM keep) AND j IN (SELECT pos FROM keep)), grid AS (SELECT pos AS i, CAST(unnest(range(25)) AS INT) AS j FROM labels) SELECT g.i, g.j, coalesce(v, 'nan'::DOUBLE) AS v FROM grid g LEFT JOIN kept k ON g.i = k.i AND g.j = k.j",
    "ag_fit_error": f"WITH {_TWO}, e AS (SELECT participant, sqrt(avg((x - y) * (x - y)) FILTER (i <> j)) AS a, sqrt(avg((tx - ty) * (tx - ty))) AS b, {_corr('x', 'y', 'i < j')} AS c, {_corr('tx', 'ty')} AS d FROM two GROUP BY 1) SELECT participant, {_r('a', 5)} AS fc_rmse, {_r('b', 5)} AS tau_rmse, {_r('sqrt(0.5 * (a * a + b * b))', 5)} AS fit_rmse, {_r('c', 5)} AS fc_corr, {_r('d', 5)} AS tau_corr FROM e",
    "ag_rmse": f"WITH {_TWO} SELECT participant, {_r('sqrt(avg((x - y) * (x - y)))', 5)} AS rmse FROM two GROUP BY 1",
    "ag_corr_upper": f"WITH {_TWO} SELECT participant, {_r(_corr('x', 'y', 'i < j'), 5)} AS r FROM two GROUP BY 1",
    "ag_ndte_sim": f"WITH {_TWO} SELECT participant, {_r(_corr('tx', 'ty', 'i <> j'), 5)} AS ndte_corr, {_r('sqrt(avg((tx - ty) * (tx - ty)) FILTER (i <> j))', 5)} AS ndte_rmse FROM two GROUP BY 1",
    "ag_tau_all": f"WITH {_WCEN}, {_wl('[1, 2, 3]')}, e AS (SELECT a.participant, a.lag, sqrt(avg((a.v - b.v) * (a.v - b.v))) AS e FROM wl a JOIN wl b ON a.participant = b.participant - 1 AND a.lag = b.lag AND a.i = b.i AND a.j = b.j GROUP BY 1, 2) SELECT participant, {_r('avg(e)', 5)} AS tau_rmse_all FROM e GROUP BY 1",
    "flt_validity": f"WITH {_VALID} SELECT path, CAST(node AS INT) AS node, valid FROM nv",
    "ag_scan_valid": f"WITH {_VALID} SELECT sub, CAST(node AS INT) AS node, valid FROM sv",
    "ag_coverage": f"WITH {_VALID}, c AS (SELECT node, avg(CAST(valid AS INT)) AS coverage, count(*) FILTER (NOT valid) AS bad FROM sv GROUP BY 1) SELECT CAST(node AS INT) AS node, {_r('coverage')} AS coverage, coverage >= 0.5 AS kept, CASE WHEN coverage >= 0.5 THEN bad ELSE 0 END AS n_excluded FROM c",
    "flt_dummy": "WITH v AS (SELECT DISTINCT tag, t, trans_x, non_steady_state_outlier FROM confound_volumes), n AS (SELECT tag, CAST(sum(non_steady_state_outlier) AS BIGINT) AS n FROM v GROUP BY 1) SELECT v.tag, count(*) AS n, min(t - n.n) AS first, max(t - n.n) AS last FROM v JOIN n ON v.tag = n.tag WHERE t >= n.n GROUP BY 1",
    "flt_short_runs": "SELECT tag, count(DISTINCT t) AS n, CASE WHEN count(DISTINCT t) < 90 THEN 'too short' WHEN max(trans_y) <= min(trans_y) THEN 'constant' END AS reason FROM confound_volumes GROUP BY 1",
    "prj_spikes": "SELECT tag, t, row_number() OVER (PARTITION BY tag ORDER BY t) - 1 AS spike, CAST(1.0 AS DOUBLE) AS v FROM (SELECT DISTINCT tag, t, framewise_displacement FROM confound_volumes WHERE framewise_displacement > 0.5 AND NOT isnan(framewise_displacement))",
    "wn_rank_acompcor": _ACOMP, "sl_acompcor": "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k FROM part WHERE p_size > 10 QUALIFY k <= 5",
    "ag_welch": f"WITH {_WCEN}, g AS (SELECT i, j, avg(fc) FILTER (grp = 0) AS m0, avg(fc) FILTER (grp = 1) AS m1, var_samp(fc) FILTER (grp = 0) AS s0, var_samp(fc) FILTER (grp = 1) AS s1, count(*) FILTER (grp = 0) AS n0, count(*) FILTER (grp = 1) AS n1 FROM wfg WHERE i <> j GROUP BY 1, 2) SELECT i, j, {_r('(m0 - m1) / sqrt(s0 / n0 + s1 / n1)', 4)} AS t, {_r('pow(s0 / n0 + s1 / n1, 2) / (pow(s0 / n0, 2) / (n0 - 1) + pow(s1 / n1, 2) / (n1 - 1))', 4)} AS df, {_r('m0', 4)} AS mean_0, {_r('m1', 4)} AS mean_1 FROM g",
    "ag_strength": f"WITH {_WCEN}, {_wl('[1]')}, g AS (SELECT a.participant, avg(a.v) AS m, avg(abs(a.v - b.v)) AS s FROM wl a JOIN wl b ON a.participant = b.participant AND a.i = b.j AND a.j = b.i WHERE a.i <> a.j GROUP BY 1) SELECT participant, {_r('m')} AS mean_strength, {_r('s / (abs(m) + 1e-12)', 3)} AS asymmetry FROM g",
    "wn_rank_fdr": f"WITH o AS (SELECT pow(o_totalprice / 500000.0, 3) AS p FROM orders), k AS (SELECT p, row_number() OVER (ORDER BY p) AS rank, count(*) OVER () AS n FROM o), l AS (SELECT max(p) AS lim FROM k WHERE p <= 0.05 * rank / n) SELECT coalesce(p <= lim, false) AS reject, count(*) AS n, {_r('max(p)', 9)} AS p_max FROM o, l GROUP BY 1",
    "ag_flows": _FLOWQ,
    "sl_flow_sort": f"WITH {_FLOW} SELECT row_number() OVER (ORDER BY round(in_flow + out_flow, 9) DESC, participant, region) AS place, participant, region, {_r('in_flow + out_flow', 5)} AS total_flow FROM fl",
    "sl_top_regions": f"WITH {_FLOW} SELECT participant, row_number() OVER w AS k, region, {_r('in_flow + out_flow', 5)} AS total_flow FROM fl WINDOW w AS (PARTITION BY participant ORDER BY round(in_flow + out_flow, 9) DESC, region) QUALIFY k <= 3",
    "ag_surrogate_stats": f"WITH {_WCEN}, {_wl('[1, 3, 4, 5, 6, 7, 8, 9, 10, 11]')}, g AS (SELECT s.participant, s.i, s.j, max(abs(v.v)) AS v, avg(abs(s.v)) AS mu, stddev_pop(abs(s.v)) AS sd, count(*) AS n, sum(CAST(abs(s.v) >= abs(v.v) AS INT)) AS ge FROM wl s JOIN wl v ON s.participant = v.participant AND s.i = v.i AND s.j = v.j AND v.lag = 1 AND s.lag > 1 WHERE s.i <> s.j GROUP BY 1, 2, 3) SELECT participant, i, j, {_r('mu', 5)} AS mu, {_r('sd', 5)} AS sd, {_r('coalesce((v - mu) / nullif(sd, 0), 0)', 3)} AS z, {_r('(1 + ge) / (1 + n)')} AS p_emp FROM g",
    "ag_ndte_group": f"WITH {_FLOW}, a AS (SELECT f.*, unnest([CAST(g.grp AS VARCHAR), 'all']) AS grp FROM flow f JOIN (SELECT DISTINCT participant, grp FROM wide) g ON f.participant = g.participant) SELECT grp, i, j, {_r('avg(v)', 5)} AS mean, {_r('avg(CAST(v > 0.05 AS INT))', 5)} AS share, count(*) AS n FROM a GROUP BY 1, 2, 3",
    "sl_best": f"WITH {C.SEARCHED} SELECT G, a, value, ordinal, 'fit_rmse' AS metric FROM {_BEST} UNION ALL SELECT G, a, value, ordinal, 'fc_corr' FROM (SELECT G, a, fc_corr AS value, ordinal FROM searched WHERE valid AND fc_corr IS NOT NULL ORDER BY CASE WHEN G <= 0 THEN 1 ELSE 0 END, fc_corr DESC, ordinal LIMIT 1)",
    "wn_axis_step": f"WITH {C.SEARCHED}, v AS (SELECT DISTINCT G FROM searched) SELECT {_r('min(s)', 9)} AS step FROM (SELECT G - lag(G) OVER (ORDER BY G) AS s FROM v) WHERE s > 1e-12",
    "wn_border": f"WITH {C.SEARCHED} {_axis('G')} UNION ALL {_axis('a')}",
    "wn_extend": f"WITH {C.SEARCHED}, v AS (SELECT min(G) AS lo, max(G) AS hi, count(DISTINCT G) - 1 AS n FROM searched), w AS (SELECT *, round((hi - lo) / n, 10) AS step FROM v), x AS (SELECT round(hi + step * unnest(range(1, greatest(1, CAST(round_even(0.5 * (hi - lo) / step, 0) AS INT)) + 1)), 10) AS G FROM w) SELECT G FROM x WHERE G <= 10 + 1e-12",
    "wn_refine": f"WITH {C.SEARCHED}, f AS (SELECT round(G - 0.1 + unnest(range(7)) * ({0.2 / 6!r}), 9) AS G FROM {_BEST}) SELECT G FROM f WHERE G NOT IN (SELECT round(G, 9) FROM searched)",
    "jn_not_known": f"WITH {C.SEARCHED}, n AS (SELECT DISTINCT round(G + CASE WHEN ordinal % 3 = 0 THEN 0.05 ELSE 0 END, 9) AS G, round(a, 9) AS a FROM searched) SELECT G, a FROM n ANTI JOIN (SELECT DISTINCT round(G, 9) AS G, round(a, 9) AS a FROM searched) k USING (G, a)",
    "wn_parabola": f"WITH {C.SEARCHED}, p AS (SELECT a, lag(G) OVER w AS x0, G AS x1, lead(G) OVER w AS x2, lag(fit_rmse) OVER w AS y0, fit_rmse AS y1, lead(fit_rmse) OVER w AS y2 FROM searched WHERE fit_rmse IS NOT NULL WINDOW w AS (PARTITION BY a ORDER BY G)), q AS (SELECT *, (x1 - x0) * (y1 - y2) - (x1 - x2) * (y1 - y0) AS den, pow(x1 - x0, 2) * (y1 - y2) - pow(x1 - x2, 2) * (y1 - y0) AS num, ((y2 - y1) / (x2 - x1) - (y1 - y0) / (x1 - x0)) / (x2 - x0) AS c2 FROM p WHERE x0 IS NOT NULL AND x2 IS NOT NULL), v AS (SELECT *, x1 - 0.5 * num / CASE WHEN abs(den) >= 1e-18 THEN den END AS vertex FROM q) SELECT a, {_r('x1')} AS G, {_r('vertex', 4)} AS vertex FROM v WHERE c2 > 0 AND vertex > x0 AND vertex < x2",
    "so_error_surface": f"WITH {C.SEARCHED} SELECT {_r('G', 3)} AS G, max(fit_rmse) FILTER (round(a, 4) = -0.01) AS a1, max(fit_rmse) FILTER (round(a, 4) = -0.02) AS a2, max(fit_rmse) FILTER (round(a, 4) = -0.03) AS a3, max(fit_rmse) FILTER (round(a, 4) = -0.04) AS a4 FROM searched WHERE stage IN ('coarse', 'extended') GROUP BY 1",
    "ag_search_summary": f"WITH {C.SEARCHED} SELECT stage, count(*) AS n, sum(CAST(NOT valid AS INT)) AS n_invalid FROM searched GROUP BY 1",
    "snk_search": f"WITH {C.SEARCHED} SELECT ordinal, {_r('G')} AS G, {_r('a')} AS a, stage, valid, fit_rmse, fc_corr FROM searched",
    "snk_matrix": f"WITH {_WCEN} SELECT participant, i, " + ", ".join(f"max({_r('fc', 5)}) FILTER (j = {k}) AS c{k}" for k in range(C.WIDE)) + " FROM wf GROUP BY 1, 2",
    "snk_timeseries": f"WITH {C.PANEL} SELECT participant, t, " + ", ".join(f"max({_r('x', 4)}) FILTER (node = {k}) AS r{k}" for k in range(3)) + " FROM panel WHERE node < 3 GROUP BY 1, 2",
    "src_timeseries": f"SELECT tag, node, count(x) AS n, {_r('max(x)')} AS most FROM (SELECT tag, unnest(['trans_x', 'trans_y', 'trans_z']) AS node, unnest([trans_x, trans_y, trans_z]) AS x FROM (SELECT DISTINCT tag, t, trans_x, trans_y, trans_z FROM confound_volumes)) GROUP BY 1, 2",
    "src_matrix": _MAT, "src_mrtrix_csv": _MAT, "src_parcel_map": _PMAP,
    "src_map": f"WITH pm AS ({_PMAP}) SELECT pos, name, {_r('(value - (SELECT avg(value) FROM pm)) / coalesce(nullif((SELECT stddev_pop(value) FROM pm), 0), 1)', 5)} AS z, (SELECT count(*) FILTER (value IS NULL) FROM pm) AS n_missing FROM pm",
    "snk_labels": f"WITH {C.LABELS} SELECT concat_ws(E'\\t', label_id, name, hemisphere, network) AS line FROM labels",
    "snk_json": f"WITH {_SCQ}, {C.LABELS}, keep AS (SELECT pos FROM labels WHERE label_id % 4 <> 0), grid AS (SELECT pos AS i, CAST(unnest(range(25)) AS INT) AS j FROM labels) SELECT g.i, g.j, k.v FROM grid g LEFT JOIN (SELECT * FROM sc WHERE i IN (SELECT pos FROM keep) AND j IN (SELECT pos FROM keep)) k ON g.i = k.i AND g.j = k.j WHERE g.i < 5 AND g.j < 5",
    "snk_qsirecon": f"WITH {_SCQ} SELECT i, j, v FROM sc",
    "snk_plots": f"WITH {_SCQ} SELECT a.i, a.j, {_r('log10(a.v)', 5)} AS log10, {_r('a.v - b.v', 5)} AS asymmetry FROM sc a JOIN sc b ON a.i = b.j AND a.j = b.i WHERE a.i < a.j",
    "mk_jacobian": f"WITH {_SCQ}, {C.LABELS}, c AS (SELECT i, j, v / (SELECT max(v) FROM sc) * 0.2 AS v FROM sc), n AS (SELECT pos AS i, coalesce((SELECT sum(v) FROM c WHERE c.i = pos), 0) AS s FROM labels), e AS (SELECT i AS a, i AS b, -0.02 - s AS v FROM n UNION ALL SELECT i + 25, i + 25, -0.02 - s FROM n UNION ALL SELECT i, i + 25, -(0.2 + 0.01 * i) FROM n UNION ALL SELECT i + 25, i, 0.2 + 0.01 * i FROM n UNION ALL SELECT i, j, v FROM c WHERE i <> j UNION ALL SELECT i + 25, j + 25, v FROM c WHERE i <> j) SELECT a, b, {_r('v', 5)} AS v FROM e",
}
