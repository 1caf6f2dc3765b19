"""The whole fit of a project: node set, moments of every run, search for the coupling, group fits as priors, participant
fits shrunk towards them, group comparison. Participants are rows; only N x N averages of groups come to the driver."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.kernels import filters, fits, hopf, special
from loomspan.operators import matrices
from loomspan.plans import search as P
from loomspan.session import cut

MOMENTS = "participant string, run string, n_volumes int, fc array<double>, cov array<double>, omega array<double>, halves array<array<double>>, series array<double>, error string"
FITS = "participant string, grp string, method string, lambda double, fit_rmse double, fc_corr double, n_iter int, ec array<double>, error string"


#: Methods of the participants' fits; only the first takes several lags, and the last two no shrinkage.
METHODS = ("gradient", "whittle", "gec", "surrogate")


@dataclass
class Project:
    tr: float
    band: tuple[float, float] | None = (0.008, 0.08)
    lags: tuple[int, ...] = (1,)  # volumes
    beta: float = 0.02
    a: float = -0.02
    G: float | None = None
    G_values: tuple[float, ...] = tuple(np.round(np.arange(0, 3.01, 0.1), 10))
    a_values: tuple[float, ...] | None = None
    method: str = "gradient"
    fit_omega: bool = True
    fit_a: str = "none"  # or global, or node
    w_fc: float = 1.0
    w_tau: float = 1.0
    subcritical: bool = True  # the search takes no point with a node at or above 0
    profile: np.ndarray | None = None  # heterogeneity over all nodes of the atlas: a_j = -0.1 + axis value * profile_j
    n_sim: int = 4  # seeds of the simulations of a surrogate fit
    n_vol: int = 200  # their volumes
    max_iter: int = 500
    min_volumes: int = 50
    min_coverage: float = 1.0
    exclude: tuple[int, ...] = ()
    lambdas: tuple[float, ...] = (0.0, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0)
    extensions: int = 2
    q: float = 0.05
    search: P.Options = field(default_factory=P.Options)

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}; known are {', '.join(METHODS)}")
        if self.fit_a not in ("none", "global", "node"):
            raise ValueError(f"fit_a is none, global or node, not {self.fit_a!r}")
        if not self.lags or min(self.lags) < 1:
            raise ValueError("lags are whole volumes of 1 at least")
        if self.method != "gradient" and len(self.lags) > 1:
            raise ValueError(f"{self.method} fits take one lag, not {self.lags}")
        if self.method == "whittle" and self.band is None:
            raise ValueError("a whittle fit needs a band")

    @property
    def shrinks(self) -> bool:
        return self.method in ("gradient", "whittle")


@dataclass
class Result:
    nodes: DataFrame  # node, coverage, kept
    moments: DataFrame  # of each participant, with errors
    search: P.Found | None
    lambda_table: DataFrame | None
    lam: float
    fits: DataFrame  # participants and groups; an error is a row
    edges: DataFrame  # participant, grp, i, j, ec
    groups: DataFrame  # grp, i, j, mean, sd, n
    comparison: DataFrame  # grp_a, grp_b, i, j, t, p, reject


def node_set(panel: DataFrame, p: Project) -> DataFrame:
    """node, coverage, kept: share of participants in all of whose runs a node has numbers that differ."""
    v = panel.select("participant", "run", F.posexplode("x").alias("node", "v"))
    number = F.col("v").isNotNull() & ~F.isnan(F.coalesce("v", F.lit(0.0)))
    run = v.groupBy("participant", "run", "node").agg((F.bool_and(number) & (F.coalesce(F.max("v") - F.min("v"), F.lit(0.0)) > 0)).alias("ok"))
    c = run.groupBy("participant", "node").agg(F.bool_and("ok").alias("ok")).groupBy("node").agg(F.avg(F.col("ok").cast("int")).alias("coverage"))
    return c.select("node", "coverage", ((F.col("coverage") >= p.min_coverage) & ~F.col("node").isin(*p.exclude, -1)).alias("kept"))


def moments_at(y: np.ndarray, lags: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Correlation, and lagged correlations for each lag (lags x N x N)."""
    each = [P.run_moments(y, lag) for lag in lags]
    return each[0][0], np.stack([cov for _, cov in each])


def run_moments(panel: DataFrame, nodes: list[int], p: Project) -> DataFrame:
    """Moments of every run (a run is a task); a run that cannot be used is a row with its error."""

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        none = [None] * 5
        try:
            x = np.array([[np.nan if v is None else v for v in r] for r in pdf.sort_values("t")["x"]], float)[:, nodes]
            if len(x) < max(p.min_volumes, max(p.lags) + 3):
                raise ValueError(f"{len(x)} volumes are too few")
            if not np.isfinite(x).all() or (x.std(0) == 0).any():
                raise ValueError("a node without values or without scatter")
            y = filters.bandpass(x, p.tr, p.band)
            fc, cov = moments_at(y, p.lags)
            f, s = fits.periodograms(y, p.tr)
            inside = np.flatnonzero((f >= (p.band[0] if p.band else 0)) & (f <= (p.band[1] if p.band else f[-1])) & (f > 0))
            peak = f[inside][np.einsum("fii->fi", s).real[inside].argmax(0)] if len(inside) else np.full(len(nodes), 0.05)
            halves = [np.concatenate([m.ravel() for m in moments_at(h, p.lags)]).tolist() for h in (y[: len(y) // 2], y[len(y) // 2 :])]
            row = [len(x), fc.ravel().tolist(), cov.ravel().tolist(), (2 * np.pi * peak).tolist(), halves, y.ravel().tolist() if p.method == "whittle" else None, None]
        except ValueError as e:
            row = [len(pdf), *none, str(e)]
        return pd.DataFrame([[*key, *row]], columns=["participant", "run", "n_volumes", "fc", "cov", "omega", "halves", "series", "error"])

    return panel.groupBy("participant", "run").applyInPandas(work, MOMENTS)


def participant_moments(runs: DataFrame) -> DataFrame:
    """Averages over the usable runs of a participant; without one, the first error."""
    ok = runs.where("error IS NULL")
    mean = lambda c: F.expr(f"transform(sequence(0, size({c}[0]) - 1), k -> aggregate({c}, 0D, (s, r) -> s + r[k]) / size({c}))")
    g = ok.groupBy("participant").agg(F.sum("n_volumes").alias("n_volumes"), F.count("*").alias("n_runs"), *[F.collect_list(c).alias(c) for c in ("fc", "cov", "omega")], F.collect_list(F.col("halves")[0]).alias("h0"), F.collect_list(F.col("halves")[1]).alias("h1"), F.collect_list("series").alias("series"))  # a row per run of a participant
    g = g.select("participant", "n_volumes", "n_runs", *[mean(c).alias(c) for c in ("fc", "cov", "omega", "h0", "h1")], "series")
    bad = runs.groupBy("participant").agg(F.min("error").alias("error"))
    return bad.join(g, "participant", "left").select("participant", "n_volumes", "n_runs", "fc", "cov", "omega", "h0", "h1", "series", F.when(F.col("fc").isNull(), F.col("error")).alias("error"))


def group_moments(people: DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """Average moments of each group and of ``all``: one N x N average each."""
    each = people.where("fc IS NOT NULL").withColumn("grp", F.explode(F.array("grp", F.lit("all")))).where("grp IS NOT NULL")
    rows = each.select("grp", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in ("fc", "cov", "omega")])).alias("m")).select("grp", "m.c", F.posexplode("m.v").alias("k", "v")).groupBy("grp", "c", "k").agg(F.avg("v").alias("v"))
    out: dict[str, dict[str, np.ndarray]] = {}
    for (grp, c), part in itertools.groupby(rows.orderBy("grp", "c", "k").collect(), key=lambda r: (r["grp"], r["c"])):
        v = np.array([r["v"] for r in part])
        out.setdefault(grp, {})[c] = v
    for m in out.values():
        n = len(m["omega"])
        m["fc"], m["cov"] = m["fc"].reshape(n, n), m["cov"].reshape(-1, n, n)
    return out


def fit_one(p: Project, fc: np.ndarray, cov: np.ndarray, omega: np.ndarray, start: np.ndarray, mask: np.ndarray, a, prior: np.ndarray | None = None, lam: float = 0.0, max_iter: int | None = None, series: list[np.ndarray] | None = None) -> fits.Fit:
    """One fit by the project's method; ``cov``: lags x N x N. A whittle fit needs the filtered runs (T x N each)."""
    steps = max_iter or p.max_iter
    weight = lam * len(fc) ** 2 / max(float(np.sum(prior**2)), 1e-12) if prior is not None and lam > 0 else 0.0
    if p.method == "gradient":
        return fits.fit_moments(fc, list(cov), start, mask, omega, p.tr, p.lags, a, p.beta, p.band, p.w_fc, p.w_tau, weight, prior, fit_a=p.fit_a, fit_omega=p.fit_omega, max_iter=steps)
    if p.method == "whittle":
        if not series:
            raise ValueError("a whittle fit needs the runs")
        f = fits.fit_whittle(series, p.tr, start, mask, omega, p.band, a, p.fit_a, p.fit_omega, shrink=weight, prior=prior, lag=p.lags[0], max_iter=steps)
        f.metrics |= fits.fit_error(fc, f.fc, cov[0], f.cov)
        return f
    if p.method == "gec":
        model = lambda c: hopf.analytic(c, 1.0, a, omega, p.tr, p.lags[0], p.beta, p.band)
        return fits.fit_iterated(fc, cov[0], start, model, mask, max_iter=steps, top=float(start.max()) or None)
    sim = P.Problem(start, omega, fc, cov[0], p.tr, p.band, p.lags[0], p.beta, "nonlinear", n_vol=p.n_vol, seeds=tuple(range(p.n_sim)))
    return fits.fit_surrogate(fc, cov[0], start, lambda c: P.simulated(sim, c, 1.0, a)[:2], mask, 1.0, a, omega, p.tr, p.lags[0], p.beta, p.band, max_iter=steps, top=float(start.max()) or None)


def of_moments(p: Project) -> Project:
    """The project's method where only average moments are known: a likelihood needs runs, so the gradient stands in."""
    return replace(p, method="gradient") if p.method == "whittle" else p


def fit_participants(people: DataFrame, p: Project, priors: dict[str, np.ndarray], mask: np.ndarray, a: np.ndarray, lam: float) -> DataFrame:
    """A fit for each participant, started from and shrunk towards its group's (else the pooled) connectivity."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                head = (r.participant, r.grp, p.method, lam)
                try:
                    if r.fc is None:
                        raise ValueError(r.error or "no usable run")
                    n, prior = len(r.omega), priors.get(r.grp, priors["all"])
                    f = fit_one(p, np.reshape(r.fc, (n, n)), np.reshape(r.cov, (-1, n, n)), np.asarray(r.omega), prior, mask, a, prior, lam, series=[np.reshape(y, (-1, n)) for y in r.series if y is not None])
                    out.append((*head, f.metrics["fit_rmse"], f.metrics["fc_corr"], f.n_iter, f.C.ravel().tolist(), None))
                except (ValueError, FloatingPointError, np.linalg.LinAlgError) as e:
                    out.append((*head, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FITS.split(", ")])

    n = 4 * people.sparkSession.sparkContext.defaultParallelism  # fits are long and rows few
    return people.select("participant", "grp", "fc", "cov", "omega", "series", "error").repartition(n, "participant").mapInPandas(work, FITS)


def held_out(people: DataFrame, p: Project, priors: dict[str, np.ndarray], mask: np.ndarray, a: np.ndarray, lams: list[float]) -> DataFrame:
    """lambda, mean held-out error over the halves of every participant, both ways; a participant and weight is a row.

    A whittle project's halves are those of its runs, fitted by likelihood and held against the other halves' moments."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                n, prior = len(r.omega), priors.get(r.grp, priors["all"])
                h = [np.reshape(x, (-1, n, n)) for x in (r.h0, r.h1)]
                runs = [np.reshape(y, (-1, n)) for y in r.series if y is not None]
                try:
                    e = []
                    for train, test in ((0, 1), (1, 0)):
                        part = [y[: len(y) // 2] if train == 0 else y[len(y) // 2 :] for y in runs]
                        f = fit_one(p, h[train][0], h[train][1:], np.asarray(r.omega), prior, mask, a, prior, r.lam, min(p.max_iter, 200), part)
                        e.append(fits.fit_error(h[test][0], f.fc, h[test][1], f.cov)["fit_rmse"])
                    out.append((r.lam, float(np.mean(e))))
                except (ValueError, FloatingPointError, np.linalg.LinAlgError):
                    continue
            yield pd.DataFrame(out, columns=["lambda", "e"])

    rows = people.where("fc IS NOT NULL").withColumn("lam", F.explode(F.array(*[F.lit(float(x)) for x in lams]))).repartition(4 * people.sparkSession.sparkContext.defaultParallelism, "participant", "lam")
    return rows.select("participant", "grp", "omega", "h0", "h1", "series", "lam").mapInPandas(work, "lambda double, e double").groupBy("lambda").agg(F.avg("e").alias("cv_fit_rmse"), F.count("*").alias("n"))


def compare(edges: DataFrame, groups: list[str], q: float) -> DataFrame:
    """Welch's t of every link for every two groups, its p, and rejections by Benjamini-Hochberg for each pair."""
    spark, out = edges.sparkSession, None

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["p"] = [special.student_p(t, df) if pd.notna(t) and pd.notna(df) else float("nan") for t, df in zip(b["t"], b["df"])]
            yield b[["i", "j", "t", "p"]]

    for a, b in itertools.combinations(groups, 2):
        v = edges.where(F.col("grp").isin(a, b) & (F.col("i") != F.col("j"))).select("i", "j", F.col("ec").alias("v"), (F.col("grp") == b).cast("int").alias("grp"))
        w = matrices.fdr(matrices.welch(v, ["i", "j"]).mapInPandas(tails, "i int, j int, t double, p double"), q)
        one = w.select(F.lit(a).alias("grp_a"), F.lit(b).alias("grp_b"), "i", "j", "t", "p", "reject")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "grp_a string, grp_b string, i int, j int, t double, p double, reject boolean")


def fit_project(spark: SparkSession, panel: DataFrame, participants: DataFrame, structure: np.ndarray, p: Project, pairs: tuple[tuple[int, int], ...] = ()) -> Result:
    """panel (participant, run, t, x array), participants (participant, grp), structure N x N over all nodes; links i, j of
    the result are nodes of the full atlas. Raises ValueError with fewer than two kept nodes or without any usable run."""
    nodes = cut(node_set(panel, p))
    kept = sorted(r["node"] for r in nodes.where("kept").select("node").collect())  # a row per node of the atlas
    if len(kept) < 2:
        raise ValueError(f"{len(kept)} nodes are kept; two are needed")
    people = cut(participant_moments(cut(run_moments(panel, kept, p))).join(participants.select("participant", "grp"), "participant"))
    avg = group_moments(people)
    if "all" not in avg:
        raise ValueError("no participant has a usable run")
    sc = np.maximum(structure[np.ix_(kept, kept)], 0.0) * (1 - np.eye(len(kept)))
    sc = 0.2 * sc / max(sc.max(), 1e-300)
    mask = sc > 0
    at = {n: k for k, n in enumerate(kept)}
    for i, j in pairs:
        if i in at and j in at:
            mask[at[i], at[j]] = mask[at[j], at[i]] = True
    profile = None if p.profile is None else np.asarray(p.profile, float)[kept]
    problem = P.Problem(sc, avg["all"]["omega"], avg["all"]["fc"], avg["all"]["cov"][0], p.tr, p.band, p.lags[0], p.beta, subcritical=p.subcritical, profile=profile)
    found = P.adaptive(spark, problem, p.G_values, p.a_values, p.search, p.a) if p.G is None else None
    g, a = (found.G, found.a) if found else (p.G, p.a)
    a = problem.a_of(a)  # of each node
    start = g * np.where(mask & (sc == 0), 0.02, sc)
    shared = of_moments(p)
    group_fits = {k: fit_one(shared, m["fc"], m["cov"], m["omega"], start, mask, a) for k, m in avg.items()}
    priors = {k: f.C for k, f in group_fits.items()}
    lam, table = 0.0, None
    if p.shrinks and p.lambdas:
        table, tried = None, list(p.lambdas)
        for _ in range(p.extensions + 1):
            now = cut(held_out(people, p, priors, mask, a, tried))
            table = now if table is None else table.union(now)
            seen = {r["lambda"]: r["cv_fit_rmse"] for r in table.collect()}  # a row per weight
            lam = min(seen, key=seen.get) if seen else 0.0
            if not seen or lam < max(seen) or lam <= 0:
                break
            tried = [3 * lam, 10 * lam]
    done = cut(fit_participants(people, p, priors, mask, a, lam))
    of_groups = spark.createDataFrame([("all participants" if k == "all" else f"group {k}", k, shared.method, 0.0, float(f.metrics["fit_rmse"]), float(f.metrics["fc_corr"]), f.n_iter, f.C.ravel().tolist(), None) for k, f in group_fits.items()], FITS)
    full = F.array(*[F.lit(k) for k in kept])
    k = F.col("k")
    edges = done.where("ec IS NOT NULL").select("participant", "grp", F.posexplode("ec").alias("k", "ec")).select("participant", "grp", full[F.floor(k / len(kept)).cast("int")].alias("i"), full[k % len(kept)].alias("j"), "ec")
    means = edges.withColumn("grp", F.explode(F.array("grp", F.lit("all")))).groupBy("grp", "i", "j").agg(F.avg("ec").alias("mean"), F.stddev_pop("ec").alias("sd"), F.count("*").alias("n"))
    sizes = {r["grp"]: r["n"] for r in done.where("ec IS NOT NULL").groupBy("grp").agg(F.count("*").alias("n")).collect() if r["grp"] is not None}  # a row per group
    return Result(nodes, people, found, table, lam, done.unionByName(of_groups), edges, means, compare(edges, sorted(s for s, n in sizes.items() if n >= 2), p.q))
