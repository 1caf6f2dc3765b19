"""Time-series operators on long panels (participant, node, t, x) as plans of joins, windows and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.paths import correlation
from loomspan.plans import carriers as C
from loomspan.session import table

TR = 2.0  # seconds between the steps of the carrier panel
SERIES = ("participant", "node")


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def centred(panel: DataFrame) -> DataFrame:
    """x less the mean of its series: a pre-aggregated mean joined back, so no series has to fit one task."""
    m = panel.groupBy(*SERIES).agg(F.avg("x").alias("m"))
    return panel.join(m, list(SERIES)).withColumn("x", F.col("x") - F.col("m")).drop("m")


def detrended(panel: DataFrame) -> DataFrame:
    """Residual of the least-squares line on t; a series of one point gives 0."""
    s = panel.groupBy(*SERIES).agg(F.avg("t").alias("mt"), F.avg("x").alias("mx"), F.covar_pop("t", "x").alias("cv"), F.var_pop("t").alias("vt"))
    s = s.withColumn("b", F.coalesce(F.try_divide("cv", "vt"), F.lit(0.0))).drop("cv", "vt")
    return panel.join(s, list(SERIES)).withColumn("x", F.col("x") - F.col("mx") - F.col("b") * (F.col("t") - F.col("mt"))).drop("mt", "mx", "b")


def standardised(panel: DataFrame, how: str) -> DataFrame:
    """zscore (population sd), zscore_sample (sample sd) or psc (percent of the mean of absolute values); sd 0 counts as 1."""
    s = panel.groupBy(*SERIES).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sp"), F.stddev_samp("x").alias("ss"), F.avg(F.abs("x")).alias("ma"))
    one = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(1.0))
    x = {"zscore": (F.col("x") - F.col("m")) / one("sp"), "zscore_sample": (F.col("x") - F.col("m")) / one("ss"), "psc": 100 * (F.col("x") - F.col("m")) / one("ma")}[how]
    return panel.join(s, list(SERIES)).withColumn("x", x).drop("m", "sp", "ss", "ma")


def pair_moments(a: DataFrame, b: DataFrame) -> DataFrame:
    """participant, i, j, n, sum of products at equal t; partial aggregates fold the pairs before they are shuffled."""
    left = a.select("participant", "t", F.col("node").alias("i"), F.col("x").alias("xi"))
    right = b.select("participant", "t", F.col("node").alias("j"), F.col("x").alias("xj"))
    return left.join(right, ["participant", "t"]).groupBy("participant", "i", "j").agg(F.count("*").alias("n"), F.sum(F.col("xi") * F.col("xj")).alias("s"))


def _squares(panel: DataFrame) -> DataFrame:
    return panel.groupBy(*SERIES).agg(F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))


def connectivity(panel: DataFrame) -> DataFrame:
    """participant, i, j, fc: Pearson correlations of all nodes; a constant node gives 0, the diagonal is 1."""
    c = centred(panel)
    q = _squares(c)
    m = pair_moments(c, c).join(q.select("participant", F.col("node").alias("i"), F.col("q").alias("qi")), ["participant", "i"]).join(q.select("participant", F.col("node").alias("j"), F.col("q").alias("qj")), ["participant", "j"])
    return m.select("participant", "i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.coalesce(F.try_divide("s", F.sqrt(F.col("qi") * F.col("qj"))), F.lit(0.0))).alias("fc"))


def lagged_correlation(panel: DataFrame, lags: list[int]) -> DataFrame:
    """participant, lag, i, j, v: sum x_i(t+lag) x_j(t) / (T - lag) over the population sds of the whole series; sd 0
    gives 0; a negative lag is the transpose."""
    c = centred(panel)
    q = _squares(c)
    shifted = c.select("participant", F.col("node").alias("i"), F.col("x").alias("xi"), F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("t") - abs(k)).alias("t")) for k in lags])).alias("l")).select("participant", "i", "xi", "l.lag", "l.t")
    m = shifted.join(c.select("participant", F.col("node").alias("j"), F.col("x").alias("xj"), "t"), ["participant", "t"]).groupBy("participant", "lag", "i", "j").agg(F.sum(F.col("xi") * F.col("xj")).alias("s"))
    m = m.join(q.select("participant", F.col("node").alias("i"), F.col("q").alias("qi"), F.col("n").alias("steps")), ["participant", "i"]).join(q.select("participant", F.col("node").alias("j"), F.col("q").alias("qj")), ["participant", "j"])
    v = F.coalesce(F.try_divide(F.col("s") / (F.col("steps") - F.abs("lag")), F.sqrt(F.col("qi") / F.col("steps") * F.col("qj") / F.col("steps"))), F.lit(0.0))
    out = m.select("participant", "lag", "i", "j", v.alias("v"))
    return out.select("participant", "lag", F.when(F.col("lag") < 0, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(F.col("lag") < 0, F.col("i")).otherwise(F.col("j")).alias("j"), "v")


def lagged_covariance(panel: DataFrame, n_lags: int, nodes: int | None = None) -> DataFrame:
    """participant, a, b, cov: sample covariance of the lag-embedded vectors, index node * n_lags + lag."""
    x = panel if nodes is None else panel.where(F.col("node") < nodes)
    last = x.groupBy("participant").agg(F.max("t").alias("steps"))
    e = x.select("participant", "node", "x", "t", F.explode(F.sequence(F.lit(0), F.lit(n_lags - 1))).alias("p")).withColumn("t", F.col("t") + F.col("p")).join(last, "participant").where((F.col("t") >= n_lags - 1) & (F.col("t") <= F.col("steps")))
    e = e.select("participant", "t", (F.col("node") * n_lags + F.col("p")).alias("a"), "x")
    m = e.groupBy("participant", "a").agg(F.avg("x").alias("m"))
    e = e.join(m, ["participant", "a"]).select("participant", "t", "a", (F.col("x") - F.col("m")).alias("x"))
    return e.join(e.select("participant", "t", F.col("a").alias("b"), F.col("x").alias("y")), ["participant", "t"]).groupBy("participant", "a", "b").agg((F.sum(F.col("x") * F.col("y")) / (F.count("*") - 1)).alias("cov"))


def toeplitz(c: DataFrame, n_lags: int) -> DataFrame:
    """Block-Toeplitz covariance from c(lag)[n, m] = cov(x_n(t+lag), x_m(t)), made symmetric."""
    pq = F.explode(F.sequence(F.lit(0), F.lit(n_lags - 1)))
    up = c.select("participant", "lag", "i", "j", "v", pq.alias("p")).where(F.col("p") + F.col("lag") < n_lags)
    cell = up.select("participant", (F.col("i") * n_lags + F.col("p")).alias("a"), (F.col("j") * n_lags + F.col("p") + F.col("lag")).alias("b"), "v", "lag")
    down = cell.where("lag > 0").select("participant", F.col("b").alias("a"), F.col("a").alias("b"), "v", "lag")
    s = cell.union(down).select("participant", "a", "b", "v")
    half = s.select("participant", "a", "b", (0.5 * F.col("v")).alias("v")).union(s.select("participant", F.col("b").alias("a"), F.col("a").alias("b"), (0.5 * F.col("v")).alias("v")))
    return half.groupBy("participant", "a", "b").agg(F.sum("v").alias("v"))


def fourier(panel: DataFrame, n_freq: int | None = None) -> DataFrame:
    """participant, node, f, re, im, steps of the centred series at the first n_freq frequencies, by default at all up to
    the Nyquist frequency."""
    c = centred(panel)
    T = c.groupBy("participant").agg((F.max("t") + 1).alias("steps"))
    a = F.lit(2 * math.pi) * F.col("f") * F.col("t") / F.col("steps")
    last = F.floor(F.col("steps") / 2).cast("int") if n_freq is None else F.lit(n_freq - 1)
    e = c.join(T, "participant").select("participant", "node", "t", "x", "steps", F.explode(F.sequence(F.lit(0), last)).alias("f"))
    return e.groupBy("participant", "node", "f", "steps").agg(F.sum(F.col("x") * F.cos(a)).alias("re"), F.sum(-F.col("x") * F.sin(a)).alias("im"))


def spectrum(panel: DataFrame, n_freq: int | None = None, tr: float = TR) -> DataFrame:
    """participant, node, f, freq, p: one-sided periodogram |X|^2 / (T / tr)."""
    return fourier(panel, n_freq).select("participant", "node", "f", (F.col("f") / (F.col("steps") * tr)).alias("freq"), ((F.pow("re", 2) + F.pow("im", 2)) * tr / F.col("steps")).alias("p"))


def smoothed(spec: DataFrame, sigma: float) -> DataFrame:
    """Gaussian smoothing along the frequencies, window cut at four sigmas, ends repeated."""
    radius = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v / sum(w)).alias("w")) for k, v in zip(range(-radius, radius + 1), w)])
    last = spec.groupBy(*SERIES).agg(F.max("f").alias("last"))
    e = spec.join(last, list(SERIES)).select("participant", "node", "f", "freq", "last", F.explode(weights).alias("k"))
    src = e.select("participant", "node", "f", "freq", F.col("k.w").alias("w"), F.least(F.greatest(F.col("f") + F.col("k.k"), F.lit(0)), F.col("last")).alias("g"))
    return src.join(spec.select("participant", "node", F.col("f").alias("g"), "p"), ["participant", "node", "g"]).groupBy("participant", "node", "f", "freq").agg(F.sum(F.col("w") * F.col("p")).alias("p"))


def peak_frequencies(spec: DataFrame, lo: float, hi: float) -> DataFrame:
    """Frequency of the greatest value in the band (the least of several); all frequencies where none is in it."""
    inside = F.col("freq").between(lo, hi)
    pick = lambda c: F.max_by(F.when(c, F.col("freq")), F.when(c, F.struct(F.round("p", 9), -F.col("freq"))))
    return spec.groupBy(*SERIES).agg(F.coalesce(pick(inside), F.max_by("freq", F.struct(F.round("p", 9), -F.col("freq")))).alias("f_peak"))


def window_connectivity(panel: DataFrame, width: int, step: int) -> DataFrame:
    """participant, w, i, j, c over windows [w step, w step + width); the windows a step is in come by arithmetic."""
    last = panel.groupBy("participant").agg(F.max("t").alias("last"))
    n = F.floor((F.col("last") + 1 - width) / step)
    w0 = F.greatest(F.lit(0), F.ceil((F.col("t") - width + 1) / step)).cast("int")
    w1 = F.least(F.floor(F.col("t") / step), n).cast("int")
    e = panel.join(last, "participant").where(w0 <= w1).select("participant", "node", "t", "x", F.explode(F.sequence(w0, w1)).alias("w"))
    a = e.select("participant", "w", "t", F.col("node").alias("i"), "x")
    b = e.select("participant", "w", "t", F.col("node").alias("j"), F.col("x").alias("y"))
    return a.join(b, ["participant", "w", "t"]).where("i < j").groupBy("participant", "w", "i", "j").agg(F.coalesce(correlation("x", "y"), F.lit(0.0)).alias("c"))


def dynamics(panel: DataFrame, width: int = 30, step: int = 3) -> DataFrame:
    """participant, w1, w2, fcd: correlation of the connectivity of every two windows (w1 < w2)."""
    v = window_connectivity(panel, width, step)
    b = v.select("participant", F.col("w").alias("w2"), "i", "j", F.col("c").alias("d"))
    return v.withColumnRenamed("w", "w1").join(b, ["participant", "i", "j"]).where("w1 < w2").groupBy("participant", "w1", "w2").agg(F.coalesce(correlation("c", "d"), F.lit(0.0)).alias("fcd"))


def ks_distance(values: DataFrame) -> Column | DataFrame:
    """grp (0 or 1), v -> one row: greatest gap between the distributions; null with fewer than two values on a side.

    Counts of distinct values are ranked, so ties are one step; blocks of values give their totals first, so the running
    sums are not one task over all rows."""
    c = values.groupBy("v").agg(F.sum((F.col("grp") == 0).cast("long")).alias("a"), F.sum((F.col("grp") == 1).cast("long")).alias("b"))
    total = c.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    lo_hi = c.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    one = F.lit(1).alias("k")
    x = c.withColumn("k", F.lit(1)).join(F.broadcast(total.select("*", one)), "k").join(F.broadcast(lo_hi.select("*", one)), "k")  # one row each
    x = x.withColumn("blk", F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * 1023), F.lit(0)))
    before = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy("blk").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb")).select("blk", F.coalesce(F.sum("sa").over(before), F.lit(0)).alias("a0"), F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("b0"))
    run = Window.partitionBy("blk").orderBy("v")
    y = x.join(sums, "blk").withColumn("gap", F.abs((F.col("a0") + F.sum("a").over(run)) / F.col("na") - (F.col("b0") + F.sum("b").over(run)) / F.col("nb")))
    return y.agg(F.max(F.when((F.col("na") >= 2) & (F.col("nb") >= 2), F.col("gap"))).alias("ks"))


# ---------------------------------------------------------------------------------------------------- queries
def ag_fc(spark, d):
    return connectivity(C.panel(spark, d)).select("participant", "i", "j", r("fc").alias("fc"))


def jn_pairwise(spark, d):
    p = C.panel(spark, d)
    return pair_moments(p, p).select("participant", "i", "j", "n", r("s", 4).alias("s"))


def ag_lagcorr(spark, d):
    return lagged_correlation(C.panel(spark, d), [1]).select("participant", "i", "j", r("v").alias("v"))


def ag_lagcorr_multi(spark, d):
    return lagged_correlation(C.panel(spark, d), [1, 2, 5, -1]).select("participant", "lag", "i", "j", r("v").alias("v"))


def jn_lag(spark, d):
    p = C.panel(spark, d)
    s = p.select("participant", F.col("node").alias("i"), (F.col("t") - 2).alias("t"), F.col("x").alias("xi"))
    return s.join(p.select("participant", F.col("node").alias("j"), "t", F.col("x").alias("xj")), ["participant", "t"]).groupBy("participant", "i", "j").agg(F.count("*").alias("n"), r(F.sum(F.col("xi") * F.col("xj")), 4).alias("s"))


def ag_lagcov(spark, d):
    return lagged_covariance(C.panel(spark, d), 3).select("participant", "a", "b", r("cov", 4).alias("cov"))


def ag_toeplitz(spark, d):
    return toeplitz(lagged_correlation(C.panel(spark, d), [0, 1, 2]), 3).select("participant", "a", "b", r("v", 5).alias("v"))


def mk_psd(spark, d):
    return spectrum(C.panel(spark, d), 20).select("participant", "node", "f", r("freq", 9).alias("freq"), r("p", 3).alias("p"))


def cross_periodograms(panel: DataFrame, n_freq: int | None = None) -> DataFrame:
    """participant, f, steps, i, j, re, im of X X^H tr / T."""
    x = fourier(panel, n_freq)
    y = x.select("participant", "f", F.col("node").alias("j"), F.col("re").alias("rj"), F.col("im").alias("ij"))
    z = x.withColumnRenamed("node", "i").join(y, ["participant", "f"])
    k = F.lit(TR) / F.col("steps")
    return z.select("participant", "f", "steps", "i", "j", ((F.col("re") * F.col("rj") + F.col("im") * F.col("ij")) * k).alias("re"), ((F.col("im") * F.col("rj") - F.col("re") * F.col("ij")) * k).alias("im"))


def average_periodograms(runs: list[DataFrame]) -> DataFrame:
    """f, i, j, re, im, n_items: cross-periodograms averaged over runs and participants on the coarsest grid; of a finer
    grid, the mean of the frequencies whose first coarse one at or above is f."""
    items = [cross_periodograms(p).withColumn("run", F.lit(k)) for k, p in enumerate(runs)]
    x = items[0]
    for y in items[1:]:
        x = x.unionByName(y)
    one = x.agg(F.min("steps").alias("coarse"), F.countDistinct("participant", "run").alias("n_items"))
    x = x.crossJoin(F.broadcast(one))  # one row
    at = F.least(F.ceil(F.col("f") * F.col("coarse") / F.col("steps") - 1e-9), F.floor(F.col("coarse") / 2)).cast("int")
    bins = x.groupBy("participant", "run", at.alias("at"), "i", "j", "n_items").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    return bins.groupBy(F.col("at").alias("f"), "i", "j", "n_items").agg((F.sum("re") / F.first("n_items")).alias("re"), (F.sum("im") / F.first("n_items")).alias("im"))


def mk_csd(spark, d):
    """Cross-periodograms as real and imaginary parts; the lowest 6 frequencies, as its SQL has them (all: mk_csd_all)."""
    return cross_periodograms(C.panel(spark, d), 6).select("participant", "f", "i", "j", r("re", 3).alias("re"), r("im", 3).alias("im"))


def mk_csd_all(spark, d):
    return cross_periodograms(C.panel(spark, d)).select("participant", "f", "i", "j", r("re", 3).alias("re"), r("im", 3).alias("im"))


def mk_psd_all(spark, d):
    return spectrum(C.panel(spark, d)).select("participant", "node", "f", r("freq", 9).alias("freq"), r("p", 3).alias("p"))


def wn_smooth_all(spark, d):
    return smoothed(spectrum(C.panel(spark, d)), 1.5).select("participant", "node", "f", r("p", 3).alias("p"))


def mk_avg_csd_all(spark, d):
    """Average over participants and two runs of unequal length of the panel."""
    p = C.panel(spark, d)
    runs = [p.where("t < 45"), p.where("t >= 45").withColumn("t", F.col("t") - 45)]
    return average_periodograms(runs).select("f", "i", "j", "n_items", r("re", 3).alias("re"), r("im", 3).alias("im"))


def wn_smooth(spark, d):
    return smoothed(spectrum(C.panel(spark, d), 20), 1.5).select("participant", "node", "f", r("p", 3).alias("p"))


def sl_peakfreq(spark, d):
    return peak_frequencies(smoothed(spectrum(C.panel(spark, d), 40), 1.5), 0.02, 0.1).select("participant", "node", r("f_peak", 9).alias("f_peak"))


def jn_windows(spark, d):
    p = C.panel(spark, d)
    last = p.groupBy("participant").agg(F.max("t").alias("last"))
    w0 = F.greatest(F.lit(0), F.ceil((F.col("t") - 29) / 3)).cast("int")
    w1 = F.least(F.floor(F.col("t") / 3), F.floor((F.col("last") - 29) / 3)).cast("int")
    return p.join(last, "participant").where(w0 <= w1).select("participant", "node", "x", F.explode(F.sequence(w0, w1)).alias("w")).groupBy("participant", "node", "w").agg(F.count("*").alias("n"), r(F.avg("x"), 5).alias("m"))


def wn_fcd(spark, d):
    return dynamics(C.panel(spark, d)).select("participant", "w1", "w2", r("fcd", 4).alias("fcd"))


def wn_kuramoto(spark, d):
    """Order parameter per step from phases (the centred values in radians), its mean and population sd."""
    c = centred(C.panel(spark, d))
    k = c.groupBy("participant", "t").agg(F.sqrt(F.pow(F.avg(F.cos("x")), 2) + F.pow(F.avg(F.sin("x")), 2)).alias("R"))
    return k.groupBy("participant").agg(r(F.avg("R"), 5).alias("synchrony"), r(F.stddev_pop("R"), 5).alias("metastability"))


def wn_ks(spark, d):
    e = table(spark, d, "events").where("event_type IN ('click', 'view') AND value IS NOT NULL")
    return ks_distance(e.select((F.col("event_type") == "view").cast("int").alias("grp"), F.col("value").alias("v"))).select(r("ks").alias("ks"))


def wn_detrend(spark, d):
    return detrended(C.panel(spark, d)).select("participant", "node", "t", r("x", 4).alias("x"))


def wn_demean(spark, d):
    return centred(C.panel(spark, d)).select("participant", "node", "t", r("x", 5).alias("x"))


def wn_standardize(spark, d):
    p = C.panel(spark, d)
    z = [standardised(p, h).select("participant", "node", "t", F.lit(h).alias("how"), r("x", 5).alias("x")) for h in ("zscore", "zscore_sample", "psc")]
    return z[0].union(z[1]).union(z[2])


def wn_lag(spark, d):
    w = Window.partitionBy(*SERIES).orderBy("t")
    return C.panel(spark, d).select("participant", "node", "t", r(F.lag("x", 1).over(w), 6).alias("before"), r(F.lead("x", 2).over(w), 6).alias("after"))


def wn_circshift(spark, d):
    """Circular shift of each node by its own offset within 5 to 95 % of the length."""
    p = C.panel(spark, d)
    T = p.groupBy("participant").agg((F.max("t") + 1).alias("steps"))
    s = F.ceil(0.05 * F.col("steps")) + F.pmod(F.col("node") * 37 + F.col("participant") * 11, F.ceil(0.9 * F.col("steps")))
    return p.join(T, "participant").select("participant", "node", F.pmod(F.col("t") - s, F.col("steps")).cast("int").alias("t"), r("x").alias("x"))


def wn_halves(spark, d):
    """Halves of a series: by parity of the run where there are two runs at least, else first and second half in time."""
    p = C.panel(spark, d)
    s = p.groupBy("participant").agg((F.max("t") + 1).alias("steps"), F.countDistinct("node").alias("runs"))
    half = F.when(F.col("runs") >= 6, F.col("node") % 2).otherwise((F.col("t") >= F.floor(F.col("steps") / 2)).cast("int"))
    return p.join(s, "participant").groupBy("participant", "node", half.alias("half")).agg(F.count("*").alias("n"), r(F.sum("x"), 5).alias("s"))


def flt_band(spark, d):
    """Frequencies within the band, narrowed by a tenth of its width on either side, above 0."""
    s = spectrum(C.panel(spark, d), 40)
    lo, hi = 0.02, 0.1
    k = 0.1 * (hi - lo)
    return s.where(F.col("freq").between(lo + k, hi - k) & (F.col("freq") > 0)).select("participant", "node", "f", r("freq", 9).alias("freq"))


def jn_asof_freq(spark, d):
    """Spectra of runs of unequal length averaged on the finest grid: linear interpolation between neighbours, the ends
    held. Neighbours come from the index on the coarse grid, so no range join is needed."""
    p = C.panel(spark, d)
    fine = spectrum(p, 12)
    coarse = spectrum(p.where("t < 90"), 12)
    step_f, step_c = 1 / (C.STEPS * TR), 1 / (90 * TR)
    pos = F.least(F.col("f") * step_f / step_c, F.lit(11.0))
    want = fine.select("participant", "node", "f", "p", F.floor(pos + 1e-9).cast("int").alias("g"), (pos - F.floor(pos + 1e-9)).alias("w"))
    a = coarse.select("participant", "node", F.col("f").alias("g"), F.col("p").alias("p0"))
    b = coarse.select("participant", "node", (F.col("f") - 1).alias("g"), F.col("p").alias("p1"))
    x = want.join(a, ["participant", "node", "g"]).join(b, ["participant", "node", "g"], "left")
    return x.select("participant", "node", "f", r((F.col("p") + F.col("p0") + F.col("w") * (F.coalesce("p1", "p0") - F.col("p0"))) / 2, 3).alias("p"))


mk_avg_spec = jn_asof_freq


def jn_bin_freq(spark, d):
    """Fine frequencies onto the coarsest grid: bin = first reference at or above, mean within the bin."""
    s = spectrum(C.panel(spark, d), 24)
    step_f, step_c = 1 / (C.STEPS * TR), 1 / (45 * TR)
    return s.select("participant", "node", F.ceil(F.col("f") * step_f / step_c - 1e-9).cast("int").alias("bin"), "p").groupBy("participant", "node", "bin").agg(F.count("*").alias("n"), r(F.avg("p"), 3).alias("p"))


mk_avg_csd = jn_bin_freq


def ag_runs_mean(spark, d):
    """Statistics of a participant averaged over runs (halves of the panel): connectivity, volumes, first repetition time."""
    p = C.panel(spark, d)
    runs = [connectivity(p.where(c)).withColumn("run", F.lit(k)) for k, c in enumerate(("t < 60", "t >= 60"))]
    return runs[0].union(runs[1]).groupBy("participant", "i", "j").agg(r(F.avg("fc")).alias("fc"), F.count("*").alias("n_runs"))


def _with_all(df: DataFrame, group: str) -> DataFrame:
    """Each row for its own group and for ``all``."""
    return df.withColumn(group, F.explode(F.array(F.col(group).cast("string"), F.lit("all"))))


def ag_group_mean(spark, d):
    """Group averages; repetition time by mode (least of several), volumes as whole mean."""
    w = C.wide(spark, d)
    g = w.select("participant", "grp").distinct()
    n = w.groupBy("participant").agg((F.max("t") + 1).alias("n"))
    fc = connectivity(w).join(g, "participant")
    tr = _with_all(g.withColumn("tr", 1.5 + F.col("participant") % 3), "grp").groupBy("grp", "tr").agg(F.count("*").alias("c")).groupBy("grp").agg(F.min_by("tr", F.struct(-F.col("c"), F.col("tr"))).alias("tr"))
    vol = _with_all(g.join(n, "participant"), "grp").groupBy("grp").agg(F.floor(F.avg("n")).cast("long").alias("n_volumes"))
    return _with_all(fc, "grp").groupBy("grp", "i", "j").agg(r(F.avg("fc"), 5).alias("fc")).join(tr, "grp").join(vol, "grp")


def ag_group_ec(spark, d):
    """Mean and population sd of each link per group and over all."""
    w = C.wide(spark, d)
    fc = connectivity(w).join(w.select("participant", "grp").distinct(), "participant")
    return _with_all(fc, "grp").groupBy("grp", "i", "j").agg(r(F.avg("fc"), 5).alias("mean"), r(F.stddev_pop("fc"), 5).alias("sd"), F.count("*").alias("n"))


def ag_parcel_mean(spark, d):
    """Mean per label and step; voxels with a value that is no number count as 0 but are counted."""
    e = table(spark, d, "events")
    label = (F.col("user_id") % 25).cast("int")
    x = e.select(label.alias("label"), C.day(F.col("ts")).cast("int").alias("t"), F.when(F.col("value").isNull() | F.isnan("value") | (F.col("value") > 1e300), 0.0).otherwise(F.col("value")).alias("v"))
    m = x.groupBy("label", "t").agg((F.sum("v") / F.count("*")).alias("m"), F.count("*").alias("n"))
    return C.labels(spark, d).select(F.col("pos").alias("label")).join(m, "label", "left").select("label", "t", r("m", 8).alias("m"), F.coalesce("n", F.lit(0)).alias("n"))


def src_map_volume(spark, d):
    """Mean and median of the non-zero values per parcel."""
    s = table(spark, d, "supplier").where("s_acctbal <> 0 AND NOT isnan(s_acctbal)")
    m = s.groupBy(F.col("s_nationkey").alias("pos")).agg(r(F.avg("s_acctbal"), 4).alias("mean"), r(F.percentile("s_acctbal", F.lit(0.5)), 4).alias("median"))
    return C.labels(spark, d).select("pos").join(m, "pos", "left")


def src_map_surface(spark, d):
    """Mean over the vertices of a label, vertices without a value left out."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("label"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v"))
    return c.groupBy("label").agg(r(F.avg("v"), 4).alias("mean"), F.count("v").alias("n"))


def jn_voxel_label(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 40).cast("int").alias("voxel"), "value")
    lab = C.labels(spark, d).where("label_id > 3").select(F.col("pos").alias("voxel"), "label_id")
    return e.join(lab, "voxel").groupBy("label_id").agg(F.count("*").alias("n"), r(F.sum("value"), 3).alias("s"))


def jn_confounds(spark, d):
    """Confound rows to volumes by run and index, volumes flagged as unsteady left out."""
    v = table(spark, d, "confound_volumes").select("tag", "t", "trans_x", "non_steady_state_outlier").distinct()
    b = table(spark, d, "bold_runs").select("tag", "tr").distinct()
    return v.where("non_steady_state_outlier = 0").join(b, "tag").groupBy("tag").agg(F.count("*").alias("n"), F.max("t").alias("last"), F.max("tr").alias("tr"))


QUERIES = {
    f.__name__: f
    for f in (
        ag_fc, jn_pairwise, ag_lagcorr, ag_lagcorr_multi, jn_lag, ag_lagcov, ag_toeplitz, mk_psd, mk_csd, mk_psd_all, mk_csd_all, wn_smooth_all, mk_avg_csd_all, wn_smooth, sl_peakfreq, jn_windows, wn_fcd, wn_kuramoto, wn_ks, wn_detrend, wn_demean, wn_standardize, wn_lag,
        wn_circshift, wn_halves, flt_band, jn_asof_freq, jn_bin_freq, ag_runs_mean, ag_group_mean, ag_group_ec, ag_parcel_mean, src_map_volume, src_map_surface, jn_voxel_label, jn_confounds,
    )
} | {"mk_avg_spec": mk_avg_spec, "mk_avg_csd": mk_avg_csd}

_PI2 = repr(2 * math.pi)


def _r(x: str, k: int = 6) -> str:
    return f"round({x}, {k}) + 0.0"


_CEN = f"{C.PANEL}, cen AS (SELECT participant, node, t, x - avg(x) OVER (PARTITION BY participant, node) AS x FROM panel), sq AS (SELECT participant, node, sum(x * x) AS q, count(*) AS n FROM cen GROUP BY 1, 2)"


def _fc(cen: str, out: str) -> str:
    return f"{out} AS (SELECT a.participant, a.node AS i, b.node AS j, CASE WHEN a.node = b.node THEN 1.0 ELSE coalesce(sum(a.x * b.x) / nullif(sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 0), 0) END AS fc FROM {cen} a JOIN {cen} b ON a.participant = b.participant AND a.t = b.t GROUP BY 1, 2, 3)"


def _lagged(lags: str) -> str:
    return f"lc AS (SELECT a.participant, lag, a.node AS i, b.node AS j, coalesce(sum(a.x * b.x) / (max(p.n) - abs(lag)) / nullif(sqrt(max(p.q) / max(p.n) * max(q.q) / max(q.n)), 0), 0) AS v FROM (SELECT *, unnest({lags}) AS lag FROM cen) a JOIN cen b ON a.participant = b.participant AND a.t - abs(lag) = b.t JOIN sq p ON p.participant = a.participant AND p.node = a.node JOIN sq q ON q.participant = b.participant AND q.node = b.node GROUP BY 1, 2, 3, 4), lagged AS (SELECT participant, lag, CASE WHEN lag < 0 THEN j ELSE i END AS i, CASE WHEN lag < 0 THEN i ELSE j END AS j, v FROM lc)"


def _dft(src: str, n: int, out: str = "ft") -> str:
    return f"{out} AS (SELECT participant, node, f, steps, sum(x * cos({_PI2} * f * t / steps)) AS re, sum(-x * sin({_PI2} * f * t / steps)) AS im FROM (SELECT *, max(t) OVER (PARTITION BY participant) + 1 AS steps, unnest(range({n})) AS f FROM {src}) GROUP BY 1, 2, 3, 4)"


def _spec(n: int, src: str = "cen", out: str = "spec") -> str:
    return f"{_dft(src, n, out + 'ft')}, {out} AS (SELECT participant, node, f, f / (steps * {TR}) AS freq, (re * re + im * im) * {TR} / steps AS p FROM {out}ft)"


def _smooth(sigma: float, src: str = "spec") -> str:
    rad = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-rad, rad + 1)]
    vals = ", ".join(f"({k}, {v / sum(w)!r})" for k, v in zip(range(-rad, rad + 1), w))
    return f"kern(k, w) AS (VALUES {vals}), sm AS (SELECT s.participant, s.node, s.f, s.freq, sum(w * z.p) AS p FROM (SELECT *, max(f) OVER (PARTITION BY participant, node) AS last FROM {src}) s CROSS JOIN kern JOIN {src} z ON z.participant = s.participant AND z.node = s.node AND z.f = least(greatest(s.f + k, 0), s.last) GROUP BY 1, 2, 3, 4)"


_WIN = "win AS (SELECT p.participant, p.node, p.t, p.x, w FROM panel p JOIN (SELECT CAST(unnest(range(31)) AS INT) AS w) ON p.t >= 3 * w AND p.t < 3 * w + 30)"
_WFC = "wfc AS (SELECT a.participant, a.w, a.node AS i, b.node AS j, coalesce(covar_pop(a.x, b.x) / nullif(sqrt(var_pop(a.x) * var_pop(b.x)), 0), 0) AS c FROM win a JOIN win b ON a.participant = b.participant AND a.w = b.w AND a.t = b.t AND a.node < b.node GROUP BY 1, 2, 3, 4)"
_WCEN = f"{C.WIDE_SQL}, wcen AS (SELECT participant, grp, t, node, x - avg(x) OVER (PARTITION BY participant, node) AS x FROM wide), {_fc('wcen', 'wf')}, wfg AS (SELECT wf.*, g.grp FROM wf JOIN (SELECT DISTINCT participant, grp FROM wide) g ON wf.participant = g.participant), wfa AS (SELECT participant, i, j, fc, unnest([CAST(grp AS VARCHAR), 'all']) AS grp FROM wfg)"
_ASOF = f"WITH {_CEN}, {_spec(12)}, short AS (SELECT participant, node, t, x - avg(x) OVER (PARTITION BY participant, node) AS x FROM panel WHERE t < 90), {_spec(12, 'short', 'sp2')}, want AS (SELECT *, least(f * {1 / (C.STEPS * TR)!r} / {1 / (90 * TR)!r}, 11.0) AS pos FROM spec), w2 AS (SELECT *, CAST(floor(pos + 1e-9) AS INT) AS g, pos - floor(pos + 1e-9) AS w FROM want) SELECT w2.participant, w2.node, w2.f, {_r('(w2.p + a.p + w * (coalesce(b.p, a.p) - a.p)) / 2', 3)} AS p FROM w2 JOIN sp2 a ON a.participant = w2.participant AND a.node = w2.node AND a.f = g LEFT JOIN sp2 b ON b.participant = w2.participant AND b.node = w2.node AND b.f = g + 1"
_BIN = f"WITH {_CEN}, {_spec(24)} SELECT participant, node, CAST(ceil(f * {1 / (C.STEPS * TR)!r} / {1 / (45 * TR)!r} - 1e-9) AS INT) AS bin, count(*) AS n, {_r('avg(p)', 3)} AS p FROM spec GROUP BY 1, 2, 3"
SQL = {
    "ag_fc": f"WITH {_CEN}, {_fc('cen', 'fc')} SELECT participant, i, j, {_r('fc')} AS fc FROM fc",
    "jn_pairwise": f"WITH {C.PANEL} SELECT a.participant, a.node AS i, b.node AS j, count(*) AS n, {_r('sum(a.x * b.x)', 4)} AS s FROM panel a JOIN panel b ON a.participant = b.participant AND a.t = b.t GROUP BY 1, 2, 3",
    "ag_lagcorr": f"WITH {_CEN}, {_lagged('[1]')} SELECT participant, i, j, {_r('v')} AS v FROM lagged",
    "ag_lagcorr_multi": f"WITH {_CEN}, {_lagged('[1, 2, 5, -1]')} SELECT participant, lag, i, j, {_r('v')} AS v FROM lagged",
    "jn_lag": f"WITH {C.PANEL} SELECT a.participant, a.node AS i, b.node AS j, count(*) AS n, {_r('sum(a.x * b.x)', 4)} AS s FROM panel a JOIN panel b ON a.participant = b.participant AND a.t - 2 = b.t GROUP BY 1, 2, 3",
    "ag_lagcov": f"WITH {C.PANEL}, emb AS (SELECT participant, t + p AS t, CAST(node * 3 + p AS INT) AS a, x FROM (SELECT *, unnest(range(3)) AS p FROM panel) WHERE t + p BETWEEN 2 AND 119) SELECT u.participant, u.a, v.a AS b, {_r('covar_samp(u.x, v.x)', 4)} AS cov FROM emb u JOIN emb v ON u.participant = v.participant AND u.t = v.t GROUP BY 1, 2, 3",
    "ag_toeplitz": f"WITH {_CEN}, {_lagged('[0, 1, 2]')}, pq AS (SELECT p, unnest(range(3)) AS q FROM (SELECT unnest(range(3)) AS p)), s AS (SELECT participant, CASE WHEN q >= p THEN i * 3 + p ELSE j * 3 + p END AS a, CASE WHEN q >= p THEN j * 3 + q ELSE i * 3 + q END AS b, v FROM pq JOIN lagged ON lag = abs(q - p)) SELECT participant, a, b, {_r('sum(v)', 5)} AS v FROM (SELECT participant, a, b, 0.5 * v AS v FROM s UNION ALL SELECT participant, b, a, 0.5 * v FROM s) GROUP BY 1, 2, 3",
    "mk_psd": f"WITH {_CEN}, {_spec(20)} SELECT participant, node, f, {_r('freq', 9)} AS freq, {_r('p', 3)} AS p FROM spec",
    "mk_csd": f"WITH {_CEN}, {_dft('cen', 6)} SELECT a.participant, a.f, a.node AS i, b.node AS j, {_r(f'(a.re * b.re + a.im * b.im) * {TR} / a.steps', 3)} AS re, {_r(f'(a.im * b.re - a.re * b.im) * {TR} / a.steps', 3)} AS im FROM ft a JOIN ft b ON a.participant = b.participant AND a.f = b.f",
    "wn_smooth": f"WITH {_CEN}, {_spec(20)}, {_smooth(1.5)} SELECT participant, node, f, {_r('p', 3)} AS p FROM sm",
    "sl_peakfreq": f"WITH {_CEN}, {_spec(40)}, {_smooth(1.5)} SELECT participant, node, {_r('freq', 9)} AS f_peak FROM sm WHERE freq BETWEEN 0.02 AND 0.1 QUALIFY row_number() OVER (PARTITION BY participant, node ORDER BY round(p, 9) DESC, freq) = 1",
    "jn_windows": f"WITH {C.PANEL}, {_WIN} SELECT participant, node, w, count(*) AS n, {_r('avg(x)', 5)} AS m FROM win GROUP BY 1, 2, 3",
    "wn_fcd": f"WITH {C.PANEL}, {_WIN}, {_WFC} SELECT a.participant, a.w AS w1, b.w AS w2, {_r('coalesce(covar_pop(a.c, b.c) / nullif(sqrt(var_pop(a.c) * var_pop(b.c)), 0), 0)', 4)} AS fcd FROM wfc a JOIN wfc b ON a.participant = b.participant AND a.i = b.i AND a.j = b.j AND a.w < b.w GROUP BY 1, 2, 3",
    "wn_kuramoto": f"WITH {_CEN}, k AS (SELECT participant, t, sqrt(pow(avg(cos(x)), 2) + pow(avg(sin(x)), 2)) AS R FROM cen GROUP BY 1, 2) SELECT participant, {_r('avg(R)', 5)} AS synchrony, {_r('stddev_pop(R)', 5)} AS metastability FROM k GROUP BY 1",
    "wn_ks": f"WITH e AS (SELECT event_type = 'view' AS g, value AS v FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL), s AS (SELECT sum(CASE WHEN NOT g THEN 1 ELSE 0 END) OVER w / (SELECT count(*) FROM e WHERE NOT g) AS fa, sum(CASE WHEN g THEN 1 ELSE 0 END) OVER w / (SELECT count(*) FROM e WHERE g) AS fb FROM e WINDOW w AS (ORDER BY v RANGE UNBOUNDED PRECEDING)) SELECT {_r('max(abs(fa - fb))')} AS ks FROM s",
    "wn_detrend": f"WITH {C.PANEL} SELECT participant, node, t, {_r('x - avg(x) OVER w - coalesce(covar_pop(t, x) OVER w / nullif(var_pop(t) OVER w, 0), 0) * (t - avg(t) OVER w)', 4)} AS x FROM panel WINDOW w AS (PARTITION BY participant, node)",
    "wn_demean": f"WITH {_CEN} SELECT participant, node, t, {_r('x', 5)} AS x FROM cen",
    "wn_standardize": f"WITH {C.PANEL}, z AS (SELECT participant, node, t, unnest(['zscore', 'zscore_sample', 'psc']) AS how, unnest([(x - avg(x) OVER w) / coalesce(nullif(stddev_pop(x) OVER w, 0), 1), (x - avg(x) OVER w) / coalesce(nullif(stddev_samp(x) OVER w, 0), 1), 100 * (x - avg(x) OVER w) / coalesce(nullif(avg(abs(x)) OVER w, 0), 1)]) AS x FROM panel WINDOW w AS (PARTITION BY participant, node)) SELECT participant, node, t, how, {_r('x', 5)} AS x FROM z",
    "wn_lag": f"WITH {C.PANEL} SELECT participant, node, t, {_r('lag(x, 1) OVER w')} AS before, {_r('lead(x, 2) OVER w')} AS after FROM panel WINDOW w AS (PARTITION BY participant, node ORDER BY t)",
    "wn_circshift": f"WITH {C.PANEL} SELECT participant, node, CAST(((t - (6 + (node * 37 + participant * 11) % 108)) % 120 + 120) % 120 AS INT) AS t, {_r('x')} AS x FROM panel",
    "wn_halves": f"WITH {C.PANEL} SELECT participant, node, CAST(t >= 60 AS INT) AS half, count(*) AS n, {_r('sum(x)', 5)} AS s FROM panel GROUP BY 1, 2, 3",
    "flt_band": f"WITH {_CEN}, {_spec(40)} SELECT participant, node, f, {_r('freq', 9)} AS freq FROM spec WHERE freq BETWEEN {0.02 + 0.1 * (0.1 - 0.02)!r} AND {0.1 - 0.1 * (0.1 - 0.02)!r}",
    "jn_asof_freq": _ASOF, "mk_avg_spec": _ASOF, "jn_bin_freq": _BIN, "mk_avg_csd": _BIN,
    "ag_runs_mean": f"WITH {C.PANEL}, c1 AS (SELECT participant, node, t, x - avg(x) OVER (PARTITION BY participant, node) AS x FROM panel WHERE t < 60), c2 AS (SELECT participant, node, t, x - avg(x) OVER (PARTITION BY participant, node) AS x FROM panel WHERE t >= 60), {_fc('c1', 'f1')}, {_fc('c2', 'f2')} SELECT participant, i, j, {_r('avg(fc)')} AS fc, count(*) AS n_runs FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY 1, 2, 3",
    "ag_group_mean": f"WITH {_WCEN}, g AS (SELECT participant, unnest([CAST(grp AS VARCHAR), 'all']) AS grp, 1.5 + participant % 3 AS tr, n FROM (SELECT participant, grp, max(t) + 1 AS n FROM wide GROUP BY 1, 2)), tr AS (SELECT grp, CAST(tr AS DOUBLE) AS tr FROM (SELECT grp, tr, count(*) AS c FROM g GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY c DESC, tr) = 1), vol AS (SELECT grp, CAST(floor(avg(n)) AS BIGINT) AS n_volumes FROM g GROUP BY 1) SELECT a.grp, i, j, {_r('avg(fc)', 5)} AS fc, max(tr) AS tr, max(n_volumes) AS n_volumes FROM wfa a JOIN tr ON a.grp = tr.grp JOIN vol ON a.grp = vol.grp GROUP BY 1, 2, 3",
    "ag_group_ec": f"WITH {_WCEN} SELECT grp, i, j, {_r('avg(fc)', 5)} AS mean, {_r('stddev_pop(fc)', 5)} AS sd, count(*) AS n FROM wfa GROUP BY 1, 2, 3",
    "ag_parcel_mean": f"WITH {C.LABELS}, m AS (SELECT CAST(user_id % 25 AS INT) AS label, CAST(floor((epoch_us(ts) - {C.ORIGIN_US}) / 86400000000.0) AS INT) AS t, sum(coalesce(value, 0)) / count(*) AS m, count(*) AS n FROM events GROUP BY 1, 2) SELECT pos AS label, t, {_r('m', 8)} AS m, coalesce(n, 0) AS n FROM labels LEFT JOIN m ON pos = label",
    "src_map_volume": f"WITH {C.LABELS} SELECT pos, {_r('avg(s_acctbal)', 4)} AS mean, {_r('median(s_acctbal)', 4)} AS median FROM labels LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal <> 0) ON pos = s_nationkey GROUP BY 1",
    "src_map_surface": f"SELECT c_nationkey AS label, {_r('avg(c_acctbal) FILTER (c_acctbal > 0)', 4)} AS mean, count(*) FILTER (c_acctbal > 0) AS n FROM customer GROUP BY 1",
    "jn_voxel_label": f"WITH {C.LABELS} SELECT label_id, count(*) AS n, {_r('sum(value)', 3)} AS s FROM events JOIN labels ON user_id % 40 = pos WHERE label_id > 3 GROUP BY 1",
    "jn_confounds": "SELECT v.tag, count(*) AS n, max(t) AS last, max(tr) AS tr FROM (SELECT DISTINCT tag, t, trans_x, non_steady_state_outlier FROM confound_volumes WHERE non_steady_state_outlier = 0) v JOIN (SELECT DISTINCT tag, tr FROM bold_runs) b ON v.tag = b.tag GROUP BY 1",
}
