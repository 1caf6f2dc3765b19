"""Queries of the numerical kernels: a task holds one run (fewer than RUN + LEAST volumes), one grid point or one seed.

A label's volumes are numbered over the whole table; a remainder below LEAST belongs to the run before it. A run that is
too short for a kernel, and one whose kernel fails, gives one row with its error."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.kernels import filters, fits, flow, hopf, optimise, special
from loomspan.operators import matrices as M
from loomspan.plans import search as P
from loomspan.session import cut, table

RUN = 512  # volumes of a run; a longer series is cut into runs
SHORT, LEAST = 20, 40  # volumes that a run needs, and that it needs for a simulation
STRETCH = 16 * RUN  # ids that are numbered in one task
N_SURROGATES, NDTE_LAGS = 100, 10
SWARM, SWARM_ROUNDS = 20, 30  # particles and rounds of mk_pso
TR, BAND, BETA = 2.0, (0.02, 0.2), 0.02


def runs(spark: SparkSession, d: str) -> DataFrame:
    """participant, run, t, x: embeddings of a label in id order as runs, all values of an embedding as nodes."""
    return runs_of(table(spark, d, "embeddings"))


def runs_of(e: DataFrame) -> DataFrame:
    e = e.withColumn("part", F.floor(F.col("vec_id") / STRETCH))  # the numbering within a stretch is no window over a whole label
    counts = e.groupBy("label", "part").agg(F.count("*").alias("k"))  # a row for each stretch
    w = Window.partitionBy("label")
    before = F.coalesce(F.sum("k").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("label").alias("label_"), F.col("part").alias("part_"), before.alias("before"), F.sum("k").over(w).alias("n"))
    t = F.row_number().over(Window.partitionBy("label", "part").orderBy("vec_id")) - 1
    x = e.withColumn("t", t).join(counts, F.col("label").eqNullSafe(F.col("label_")) & (F.col("part") == F.col("part_"))).withColumn("t", F.col("before") + F.col("t"))
    run = F.least(F.floor(F.col("t") / RUN), F.greatest(F.lit(0), F.floor((F.col("n") - LEAST) / RUN)))
    x = x.withColumn("run", run)
    return x.select(F.col("label").alias("participant"), "run", (F.col("t") - F.col("run") * RUN).alias("t"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _worked(key: tuple, pdf: pd.DataFrame, f: Callable[[np.ndarray], list[tuple]], names: list[str], least: int) -> pd.DataFrame:
    """Rows that f makes of a run, or one row with its error; ``error`` is the last of the names."""
    try:
        if len(pdf) < least:
            raise ValueError(f"too few volumes: {len(pdf)}")
        rows = [(*key, *r) for r in f(np.stack(pdf.sort_values("t")["x"].to_numpy()))]
        rows = [r if len(r) == len(names) else (*r, None) for r in rows]
    except (ValueError, FloatingPointError, np.linalg.LinAlgError) as e:
        rows = [(*key, *[None] * (len(names) - len(key) - 1), str(e))]
    return pd.DataFrame(rows, columns=names)


def _with_error(columns: str) -> str:
    return columns if columns.endswith(", error string") else columns + ", error string"


def per_run(spark: SparkSession, d: str, f: Callable[[np.ndarray], list[tuple]], columns: str) -> DataFrame:
    """Rows that f makes of each run's T x N array; a run shorter than SHORT volumes gives one with its error."""
    columns = _with_error(columns)
    names = ["participant", "run", *[c.split()[0] for c in columns.split(", ")]]
    return runs(spark, d).groupBy("participant", "run").applyInPandas(lambda key, pdf: _worked(key, pdf, f, names, SHORT), "participant int, run bigint, " + columns)


def _grid(m: np.ndarray, k: int = 9) -> list[tuple]:
    return [(int(i), int(j), round(float(v), k)) for (i, j), v in np.ndenumerate(m)]


def _problem(x: np.ndarray, **more) -> P.Problem:
    """Structure (positive correlations, greatest 0.2), frequencies and filtered moments of a run."""
    y = filters.bandpass(x, TR, BAND)
    fc, cov = P.run_moments(y, 1)
    sc = np.maximum(np.corrcoef(x.T), 0.0) + 0.05
    np.fill_diagonal(sc, 0.0)
    return P.Problem(0.2 * sc / sc.max(), 2 * np.pi * _peaks(y), fc, cov, TR, BAND, n_vol=len(x), beta=BETA, **more)


def _peaks(x: np.ndarray) -> np.ndarray:
    f, p = fits.periodograms(x, TR)
    return f[np.maximum(1, np.einsum("fii->fi", p).real.argmax(0))]


def wn_bandpass(spark, d):
    return per_run(spark, d, lambda x: [(t, n, round(float(v), 6)) for (t, n), v in np.ndenumerate(filters.bandpass(x, TR, BAND))], "t int, node int, x double")


def wn_hilbert(spark, d):
    return per_run(spark, d, lambda x: [(t, n, round(float(v), 6)) for (t, n), v in np.ndenumerate(filters.analytic_phase(x))], "t int, node int, phase double")


def _by_tr(spark, d, f: Callable[[float], list[tuple]], columns: str) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(t, *r) for t in b["tr"] for r in f(float(t))], columns=["tr", *[c.split()[0] for c in columns.split(", ")]])

    tr = table(spark, d, "bold_runs").where("tr BETWEEN 0.2 AND 10").select("tr").distinct()
    return tr.mapInPandas(work, "tr double, " + columns)


def wn_h2(spark, d):
    return _by_tr(spark, d, lambda t: [(m, float(v)) for m, v in enumerate(filters.autocorrelation(t, (0.008, 0.08)))], "lag int, h2 double")


def mk_gain(spark, d):
    return _by_tr(spark, d, lambda t: [(float(f), float(g)) for f, g in zip(np.arange(1, 40) * 0.005, filters.gain(np.arange(1, 40) * 0.005, t, (0.008, 0.08)))], "freq double, gain double")


def mk_ols_clean(spark, d):
    return per_run(spark, d, lambda x: [(t, n, round(float(v), 6)) for (t, n), v in np.ndenumerate(filters.clean(x[:, :-2], x[:, -2:], None, TR, BAND))], "t int, node int, x double")


def mk_extract_run(spark, d):
    """Signals of each bold run after the unsteady volumes, cleaned of motion and of spike columns; a run that cannot be
    cleaned gives one row with its error."""
    v = table(spark, d, "confound_volumes").select("tag", "t", "trans_x", "trans_y", "trans_z", "rot_x", "white_matter", "global_signal", "framewise_displacement", "non_steady_state_outlier").distinct()
    v = v.withColumn("block", F.floor(F.col("t") / RUN))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.drop_duplicates("t").sort_values("t")
        g = g[g["non_steady_state_outlier"] != 1]
        try:
            if len(g) < 20:
                raise ValueError("too few volumes")
            y = g[["white_matter", "global_signal"]].astype(float).interpolate(limit_direction="both").to_numpy()
            if not np.isfinite(y).all():
                raise ValueError("a signal without values")
            conf = g[["trans_x", "trans_y", "trans_z", "rot_x"]].astype(float).fillna(0.0).to_numpy()
            hot = np.flatnonzero(g["framewise_displacement"].astype(float).fillna(0).to_numpy() > 0.5)
            spikes = np.zeros((len(g), len(hot)))
            spikes[hot, np.arange(len(hot))] = 1.0
            z = filters.clean(y, conf, spikes if len(hot) < len(g) // 2 else None, TR, (0.008, 0.2))
            return pd.DataFrame({"tag": key[0], "t": g["t"].to_numpy(), "white_matter": z[:, 0], "global_signal": z[:, 1], "error": None})
        except ValueError as e:
            return pd.DataFrame({"tag": [key[0]], "t": [None], "white_matter": [None], "global_signal": [None], "error": [str(e)]})

    return v.groupBy("tag", "block").applyInPandas(work, "tag string, t int, white_matter double, global_signal double, error string")


def mk_ssim(spark, d):
    return per_run(spark, d, lambda x: [(filters.ssim(*P.run_moments(x, 1)),)], "ssim double")


def mk_empirical(spark, d):
    """Everything a model is fitted to, of each run."""

    def f(x: np.ndarray) -> list[tuple]:
        p = _problem(x)
        y = filters.bandpass(x, TR, BAND)
        return [(len(x), p.fc.ravel().tolist(), p.cov.ravel().tolist(), (p.omega / 2 / np.pi).tolist(), float(filters.order_parameter(y).std()), P.window_correlations(y).tolist())]

    return per_run(spark, d, f, "n_volumes int, fc array<double>, cov array<double>, f_peak array<double>, metastability double, fcd array<double>")


def _model(f: Callable[[P.Problem, np.ndarray], list[tuple]], columns: str):
    def query(spark, d):
        return per_run(spark, d, lambda x: f(_problem(x), x), columns)

    return query


def _jac(p: P.Problem) -> np.ndarray:
    return hopf.jacobian(p.sc, 1.0, -0.02, p.omega)


mk_lyapunov = _model(lambda p, x: _grid(hopf.stationary(_jac(p), p.beta)), "i int, j int, v double")
mk_moments = _model(lambda p, x: [(i, j, v, w) for (i, j, v), (_, _, w) in zip(*map(_grid, hopf.analytic(p.sc, 1.0, -0.02, p.omega, TR, 1, p.beta, BAND)))], "i int, j int, fc double, cov double")
mk_psd_model = _model(lambda p, x: [(float(f), n, float(v)) for f, row in zip(np.arange(1, 20) * 0.01, hopf.power(p.sc, 1.0, -0.02, p.omega, np.arange(1, 20) * 0.01, p.beta)) for n, v in enumerate(row)], "freq double, node int, p double")
mk_stability = _model(lambda p, x: [(m := hopf.max_real(_jac(p)), m < 0)], "max_real double, stable boolean")
mk_validity = _model(lambda p, x: [(a, not (why := P.flaw(p, 1.0, a)), why) for a in (-0.1, -0.02, 0.01)], "a double, valid boolean, reason string")


def _recursion(p: P.Problem, lags: list[int]) -> hopf.Moments:
    return hopf.moments(_jac(p), p.beta, TR, lags, filters.autocorrelation(TR, BAND, tol=1e-6))


mk_fwd = _model(lambda p, x: [(lag, *c) for lag, s in zip((0, 1), _recursion(p, [0, 1]).at) for c in _grid(s[: x.shape[1], : x.shape[1]])], "lag int, i int, j int, v double")
mk_fwd_multi = _model(lambda p, x: [(lag, *c) for lag, s in zip((0, 1, 3), _recursion(p, [0, 1, 3]).at) for c in _grid(s[: x.shape[1], : x.shape[1]])], "lag int, i int, j int, v double")


def _loss(p: P.Problem, lags: list[int]):
    m = _recursion(p, [0, *lags])
    return m, hopf.moment_loss(m, len(p.omega), p.fc, [p.cov] * len(lags))


mk_loss = _model(lambda p, x: [(_loss(p, [1])[1][0],)], "loss double")
mk_loss_multi = _model(lambda p, x: [(n, _loss(p, list(range(1, n + 1)))[1][0]) for n in (2, 3)], "n_lags int, loss double")
mk_bwd = _model(lambda p, x: _grid((lambda ml: ml[0].gradient(ml[1][1]))(_loss(p, [1]))), "i int, j int, v double")
mk_bwd_multi = _model(lambda p, x: _grid((lambda ml: ml[0].gradient(ml[1][1]))(_loss(p, [1, 2]))), "i int, j int, v double")


def _parameter_rows(p: P.Problem) -> list[tuple]:
    m, (_, g, _, _) = _loss(p, [1])
    dc, da, dw = hopf.parameter_gradients(m.gradient(g), len(p.omega))
    return [("C", i, j, v) for i, j, v in _grid(dc)] + [("a", i, i, float(v)) for i, v in enumerate(da)] + [("omega", i, i, float(v)) for i, v in enumerate(dw)]


mk_grad_params = _model(lambda p, x: _parameter_rows(p), "parameter string, i int, j int, v double")

FIT = "method string, i int, j int, ec double, fit_rmse double, fc_corr double, n_iter int, converged boolean, error string"


def fit_rows(method: str, p: P.Problem, x: np.ndarray, max_iter: int = 60) -> list[tuple]:
    """Rows of one fit; a fit that cannot be made is a row with its error."""
    mask = p.sc > 0
    model = lambda c: hopf.analytic(c, 1.0, -0.02, p.omega, TR, 1, p.beta, BAND)
    try:
        if method == "gradient":
            f = fits.fit_moments(p.fc, p.cov, p.sc, mask, p.omega, TR, (1,), -0.02, p.beta, BAND, fit_omega=True, max_iter=max_iter)
        elif method == "whittle":
            f = fits.fit_whittle([filters.bandpass(x, TR, BAND)], TR, p.sc, mask, p.omega, BAND, a=-0.1, max_iter=max_iter)
            f.metrics |= fits.fit_error(p.fc, f.fc, p.cov, f.cov)
        elif method == "gec":
            f = fits.fit_iterated(p.fc, p.cov, p.sc, model, mask, 5e-3, 5e-3, max_iter)
        else:
            sim = P.Problem(p.sc, p.omega, p.fc, p.cov, TR, BAND, n_vol=120, seeds=(0,), beta=p.beta)
            f = fits.fit_surrogate(p.fc, p.cov, p.sc, lambda c: P.simulated(sim, c, 1.0, -0.02)[:2], mask, 1.0, -0.02, p.omega, TR, 1, p.beta, BAND, max_iter=max_iter)
        return [(method, i, j, v, f.metrics["fit_rmse"], f.metrics["fc_corr"], f.n_iter, bool(f.converged), None) for i, j, v in _grid(f.C)]
    except (ValueError, FloatingPointError, np.linalg.LinAlgError) as e:
        return [(method, None, None, None, None, None, None, None, str(e))]


mk_fit_gradient = _model(lambda p, x: fit_rows("gradient", p, x), FIT)
mk_fit_whittle = _model(lambda p, x: fit_rows("whittle", p, x, 40), FIT)
mk_fit_gec = _model(lambda p, x: fit_rows("gec", p, x), FIT)
mk_fit_surrogate = _model(lambda p, x: fit_rows("surrogate", p, x, 200), FIT)
mk_fit_one = _model(lambda p, x: [r for m in ("gradient", "gec") for r in fit_rows(m, p, x, 20)], FIT)


def _job(p: P.Problem, x: np.ndarray) -> list[tuple]:
    """The fit of a run and those of its halves, each held against the other half."""
    rows = [("whole", *r) for r in fit_rows("gradient", p, x, 20)]
    held, seen = _cross(p, x, 0.1)
    return [(*r[:-1], held, seen, r[-1]) for r in rows]


mk_fit_job = _model(_job, "part string, " + FIT.replace(", error string", ", cv_fit_rmse double, cv_train_fit_rmse double, error string"))


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[: len(x) // 2], x[len(x) // 2 :]


def _cross(p: P.Problem, x: np.ndarray, lam: float) -> tuple[float, float]:
    """Held-out and training error of a fit with shrinkage, over both directions of the halves."""
    out, seen = [], []
    parts = [P.run_moments(filters.bandpass(h, TR, BAND), 1) for h in _halves(x)]
    for a, b in ((0, 1), (1, 0)):
        f = fits.fit_moments(*parts[a], p.sc, p.sc > 0, p.omega, TR, (1,), -0.02, p.beta, BAND, shrink=lam * len(p.omega) ** 2 / max(float((p.sc**2).sum()), 1e-12), max_iter=15)
        out.append(fits.fit_error(parts[b][0], f.fc, parts[b][1], f.cov)["fit_rmse"])
        seen.append(f.metrics["fit_rmse"])
    return float(np.mean(out)), float(np.mean(seen))


mk_cv_halves = _model(lambda p, x: [_cross(p, x, 0.1)], "cv_fit_rmse double, cv_train_fit_rmse double")


def ag_cv_lambda(spark, d):
    """Mean held-out error of each shrinkage weight; the grid grows upwards while its top is best (twice at most)."""
    lams, done = [0.0, 0.1, 1.0], None
    for _ in range(3):
        now = cut(per_run(spark, d, lambda x, ls=tuple(lams): [(lam, *_cross(_problem(x), x, lam)) for lam in ls], "lambda double, cv_fit_rmse double, cv_train_fit_rmse double").where("error IS NULL").groupBy("lambda").agg(F.avg("cv_fit_rmse").alias("cv_fit_rmse"), F.avg("cv_train_fit_rmse").alias("cv_train_fit_rmse"), F.count("*").alias("n_runs")))
        done = now if done is None else done.union(now)
        seen = {r["lambda"]: r["cv_fit_rmse"] for r in done.collect()}  # a row for each weight tried
        if not seen or min(seen, key=seen.get) < max(seen):
            break
        lams = [max(seen) * k for k in (3.0, 10.0)]
    return done


def _seeds(spark, d, f: Callable[[P.Problem, np.ndarray, int], list[tuple]], columns: str, n: int = 4) -> DataFrame:
    """A task for each run and seed: rows of (participant, run) are repeated for the seeds, which are a column."""
    columns = _with_error(columns)
    names = ["participant", "run", "seed", *[c.split()[0] for c in columns.split(", ")]]
    work = lambda key, pdf: _worked(key, pdf, lambda x: f(_problem(x), x, int(key[2])), names, LEAST)
    return runs(spark, d).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).groupBy("participant", "run", "seed").applyInPandas(work, "participant int, run bigint, seed int, " + columns)


def _simulated(p: P.Problem, seed: int, volumes: int = 60):
    return P.simulated(P.Problem(p.sc, p.omega, p.fc, p.cov, TR, BAND, n_vol=volumes, seeds=(seed,), beta=p.beta), p.sc, 1.0, -0.02)


def mk_simulate(spark, d):
    return _seeds(spark, d, lambda p, x, s: [(t, n, float(v)) for (t, n), v in np.ndenumerate(hopf.simulate(p.sc, 1.0, -0.02, p.omega, TR, 30, [s], beta=p.beta, transient=20.0)[0])], "t int, node int, x double", 2)


def mk_sim_moments(spark, d):
    m = _seeds(spark, d, lambda p, x, s: [(i, j, v, w) for (i, j, v), (_, _, w) in zip(*map(_grid, _simulated(p, s)[:2]))], "i int, j int, fc double, cov double", 2)
    return m.groupBy("participant", "run", "i", "j").agg(F.avg("fc").alias("fc"), F.avg("cov").alias("cov"), F.count("fc").alias("n_seeds"), F.max("error").alias("error"))


def ag_noise_floor(spark, d):
    e = _seeds(spark, d, lambda p, x, s: [(fits.fit_error(p.fc, (m := _simulated(p, s))[0], p.cov, m[1])["fit_rmse"],)], "fit_rmse double", 3)
    return e.groupBy("participant", "run").agg(F.avg("fit_rmse").alias("mean"), F.stddev_pop("fit_rmse").alias("sd"), F.count("fit_rmse").alias("n"), F.max("error").alias("error"))


mk_ndte = _model(lambda p, x: _grid(flow.ndte(x, NDTE_LAGS)), "i int, k int, ndte double")


def mk_linear_ndte(spark, d):
    def f(p: P.Problem, x: np.ndarray) -> list[tuple]:
        m = _recursion(p, list(range(NDTE_LAGS)))
        return _grid(flow.transfer(flow.toeplitz_covariance([s[: x.shape[1], : x.shape[1]] for s in m.at]), x.shape[1], NDTE_LAGS))

    return per_run(spark, d, lambda x: f(_problem(x), x), "i int, k int, ndte double")


def mk_surrogates(spark, d):
    """Significance of each link against circularly shifted surrogates of its run. A run makes its own surrogates, so its
    volumes are not repeated for each of them."""

    def f(x: np.ndarray) -> list[tuple]:
        seen = flow.ndte(x, NDTE_LAGS)
        made = np.stack([flow.ndte(flow.shifted(x, seed), NDTE_LAGS) for seed in range(N_SURROGATES)])
        sd = made.std(0)
        z = np.where(sd > 0, (seen - made.mean(0)) / np.where(sd > 0, sd, 1.0), 0.0)
        p = (1 + (made >= seen).sum(0)) / (1 + len(made))
        return [(i, k, v, float(z[i, k]), float(p[i, k]), float(special.normal_sf(z[i, k])), special.reflected_kde_p(made[:, i, k], v)) for i, k, v in _grid(seen) if i != k]

    return per_run(spark, d, f, "i int, k int, ndte double, z double, p_emp double, p_gauss double, p_kde double")


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([special.student_p(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df)], dtype=float)


def ag_welch_p(spark, d):
    w = M.welch(M._groups(spark, d), ["i", "j"])
    return w.select("i", "j", F.round("t", 4).alias("t"), student_p("t", "df").alias("p"))


def permuted(values: DataFrame, n_perm: int) -> DataFrame:
    """participant, grp, i, j, v -> i, j, p_perm, p_fwe: labels are dealt anew to the participants by their place in the
    order of a hash for each seed, so both groups keep their sizes; means fold before they are shuffled."""
    people = values.select("participant", "grp").distinct()
    size = people.agg(F.sum((F.col("grp") == 0).cast("int")).alias("n0")).withColumn("k", F.lit(1))
    dealt = people.select("participant", F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("seed"), F.lit(1).alias("k")).join(F.broadcast(size), "k")  # one row
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.xxhash64("seed", "participant"), "participant"))
    dealt = dealt.select("participant", "seed", (place > F.col("n0")).cast("int").alias("label"))
    gap = lambda c: F.abs(F.avg(F.when(F.col(c) == 0, F.col("v"))) - F.avg(F.when(F.col(c) == 1, F.col("v"))))
    seen = values.groupBy("i", "j").agg(gap("grp").alias("seen"))
    null = values.join(dealt, "participant").groupBy("seed", "i", "j").agg(gap("label").alias("d"))
    top = null.groupBy("seed").agg(F.max("d").alias("top"))
    x = null.join(top, "seed").join(seen, ["i", "j"]).groupBy("i", "j").agg(F.count("*").alias("n"), F.sum((F.col("d") >= F.col("seen")).cast("int")).alias("ge"), F.sum((F.col("top") >= F.col("seen")).cast("int")).alias("gm"))
    return x.select("i", "j", ((F.col("ge") + 1) / (F.col("n") + 1)).alias("p_perm"), ((F.col("gm") + 1) / (F.col("n") + 1)).alias("p_fwe"))


def ag_perm(spark, d):
    return permuted(M._groups(spark, d), 200)


def _group(spark, d, **more) -> P.Problem:
    """The problem of the average over all runs: N x N means come to the driver, nothing that grows with the runs; an error without any run."""
    e = per_run(spark, d, lambda x: (lambda p: [(k, v, w, z) for k, (v, w, z) in enumerate(zip(p.fc.ravel().tolist(), p.cov.ravel().tolist(), np.repeat(p.omega, len(p.omega)).tolist()))])(_problem(x)), "k int, fc double, cov double, omega double")
    r = e.where("error IS NULL").groupBy("k").agg(F.avg("fc").alias("fc"), F.avg("cov").alias("cov"), F.avg("omega").alias("omega")).orderBy("k").collect()
    if not r:
        raise ValueError("no run has enough volumes")
    n = round(len(r) ** 0.5)
    fc, cov, omega = (np.array([x[c] for x in r]).reshape(n, n) for c in ("fc", "cov", "omega"))
    sc = np.maximum(fc, 0.0) + 0.05
    np.fill_diagonal(sc, 0.0)
    return P.Problem(0.2 * sc / sc.max(), omega[:, 0], fc, cov, TR, BAND, beta=BETA, **more)


G_GRID, A_GRID = (0.0, 0.5, 1.0, 1.5), (-0.1, -0.05, -0.02, 0.01)


def mk_eval_point(spark, d):
    return spark.createDataFrame(P.evaluate(spark, _group(spark, d), [(0.5, -0.05)], "point"), P.SCHEMA)


def mk_eval_grid(spark, d):
    """Every run's grid: the points of a run are rows of its task."""
    return per_run(spark, d, lambda x: [(p["G"], p["a"], p["valid"], p["reason"], p["fit_rmse"], p["fc_corr"]) for p in P.evaluate(None, _problem(x), [(g, a) for g in G_GRID for a in A_GRID], "coarse").to_dict("records")], "G double, a double, valid boolean, reason string, fit_rmse double, fc_corr double")


def _found(spark, f: P.Found) -> DataFrame:
    return spark.createDataFrame([(f.G, f.a, f.source, float(f.best["fit_rmse"]), len(f.table), int((~f.table["valid"].astype(bool)).sum()), "; ".join(f.warnings))], "G double, a double, source string, fit_rmse double, n_evaluated long, n_invalid long, warnings string")


def mk_adaptive(spark, d):
    return _found(spark, P.adaptive(spark, _group(spark, d), G_GRID, A_GRID))


def mk_continuous(spark, d):
    return _found(spark, P.adaptive(spark, _group(spark, d), G_GRID, A_GRID, P.Options(continuous="gradient")))


def mk_run_search(spark, d):
    """Search with a heterogeneous profile of a over the nodes."""
    p = _group(spark, d)
    return _found(spark, P.adaptive(spark, replace(p, profile=np.linspace(-1, 1, len(p.omega))), G_GRID, (-0.08, -0.04, 0.0, 0.04)))


def mk_pso(spark, d):
    """A swarm over G and a: each round's particles are Spark rows."""
    p = _group(spark, d)
    (at, value, _) = P.continuous(spark, p, P.Options(continuous="pso", G_range=(0.1, 3.0), a_range=(-0.5, -0.01), budget=SWARM * SWARM_ROUNDS), 1.0, -0.05, True)
    return spark.createDataFrame([(at["G"], at["a"], float(value), SWARM * (SWARM_ROUNDS + 1))], "G double, a double, fit_rmse double, n_fev int")


def sl_best_init(spark, d):
    """The better of two starts (structure, uniform) of each run's iteration."""

    def f(p: P.Problem, x: np.ndarray) -> list[tuple]:
        model = lambda c: hopf.analytic(c, 1.0, -0.02, p.omega, TR, 1, p.beta, BAND)
        got = [(n, fits.fit_iterated(p.fc, p.cov, c, model, p.sc > 0, 5e-3, 5e-3, 15).metrics["fit_rmse"]) for n, c in (("sc", p.sc), ("uniform", 0.1 * (p.sc > 0)))]
        return [min(got, key=lambda r: r[1] if np.isfinite(r[1]) else np.inf)]

    return per_run(spark, d, lambda x: f(_problem(x), x), "init string, fit_rmse double")


QUERIES = {
    "wn_bandpass": wn_bandpass, "wn_hilbert": wn_hilbert, "wn_h2": wn_h2, "mk_gain": mk_gain, "mk_ols_clean": mk_ols_clean, "mk_extract_run": mk_extract_run, "mk_ssim": mk_ssim, "mk_empirical": mk_empirical,
    "mk_lyapunov": mk_lyapunov, "mk_moments": mk_moments, "mk_psd_model": mk_psd_model, "mk_stability": mk_stability, "mk_validity": mk_validity, "mk_fwd": mk_fwd, "mk_fwd_multi": mk_fwd_multi, "mk_loss": mk_loss,
    "mk_bwd": mk_bwd, "mk_grad_params": mk_grad_params, "mk_fit_gradient": mk_fit_gradient, "mk_fit_whittle": mk_fit_whittle, "mk_fit_gec": mk_fit_gec, "mk_fit_surrogate": mk_fit_surrogate, "mk_fit_one": mk_fit_one,
    "mk_fit_job": mk_fit_job, "mk_cv_halves": mk_cv_halves, "ag_cv_lambda": ag_cv_lambda, "mk_simulate": mk_simulate, "mk_sim_moments": mk_sim_moments, "ag_noise_floor": ag_noise_floor, "mk_ndte": mk_ndte,
    "mk_linear_ndte": mk_linear_ndte, "mk_surrogates": mk_surrogates, "ag_welch_p": ag_welch_p, "ag_perm": ag_perm, "mk_eval_point": mk_eval_point, "mk_eval_grid": mk_eval_grid, "mk_adaptive": mk_adaptive,
    "mk_continuous": mk_continuous, "mk_run_search": mk_run_search, "mk_pso": mk_pso, "sl_best_init": sl_best_init,
}
SQL: dict[str, str] = {}
