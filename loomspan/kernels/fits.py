"""Fits of effective connectivity: moments by gradient, Whittle likelihood, heuristic iteration, surrogate gradient."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from loomspan.kernels import filters, hopf
from loomspan.kernels.optimise import bounded_bfgs

UNSTABLE = 10.0  # times the first loss: value of a point without stationary covariance
A_BOUNDS, OMEGA_LEAST = (-2.0, -1e-3), 1e-4
SHORTEST_STEP, LONGEST_STEP = 1e-4, 0.25  # of a surrogate fit, shares of the greatest weight


@dataclass
class Fit:
    C: np.ndarray
    a: np.ndarray
    omega: np.ndarray
    loss: float
    n_iter: int
    converged: bool
    fc: np.ndarray
    cov: np.ndarray
    metrics: dict[str, float] = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)
    extra: dict = field(default_factory=dict)


def fit_error(fc: np.ndarray, fc_model: np.ndarray, cov: np.ndarray, cov_model: np.ndarray) -> dict[str, float]:
    n = len(fc)
    off, up = ~np.eye(n, dtype=bool), np.triu_indices(n, 1)
    corr = lambda x, y: float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 and y.std() > 0 else float("nan")
    e1, e2 = np.sqrt(np.mean((fc - fc_model)[off] ** 2)), np.sqrt(np.mean((cov - cov_model) ** 2))
    return {"fc_rmse": float(e1), "tau_rmse": float(e2), "fit_rmse": float(np.sqrt((e1**2 + e2**2) / 2)), "fc_corr": corr(fc[up], fc_model[up]), "tau_corr": corr(cov.ravel(), cov_model.ravel())}


def project(c: np.ndarray, mask: np.ndarray, top: float | None) -> np.ndarray:
    c = np.where(mask & ~np.eye(len(c), dtype=bool), np.maximum(c, 0.0), 0.0)
    return c * (top / c.max()) if top and c.max() > 0 else c


class Vector:
    """Parameters in one vector: named blocks with bounds, each ``shape`` long (0: held at a value)."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, int, float, float]] = []
        self.start: list[np.ndarray] = []

    def add(self, name: str, start: np.ndarray, lo: float, hi: float) -> None:
        self.blocks.append((name, len(start), lo, hi))
        self.start.append(np.asarray(start, float))

    def split(self, x: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, n, _, _ in self.blocks:
            out[name] = x[at : at + n]
            at += n
        return out

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.full(n, lo) for _, n, lo, _ in self.blocks]), np.concatenate([np.full(n, hi) for _, n, _, hi in self.blocks])

    def join(self, parts: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([np.atleast_1d(parts[name]) for name, *_ in self.blocks])


def _share(mode: str, full: np.ndarray) -> np.ndarray:
    """Start values of a parameter: one for each node, one for all, or none."""
    return full if mode == "node" else full[:1] if mode == "global" else full[:0]


def _hits(v: Vector, x: np.ndarray) -> dict[str, int]:
    out = {}
    for (name, _, lo, hi), part in zip(v.blocks, v.split(x).values()):
        out[f"n_{name}_at_lower"] = int(np.sum(part <= lo + 1e-9))
        if np.isfinite(hi):
            out[f"n_{name}_at_upper"] = int(np.sum(part >= hi - 1e-9))
    return out


def fit_moments(fc: np.ndarray, cov, c0: np.ndarray, mask: np.ndarray, omega: np.ndarray, tr: float, lags=(1,), a=-0.02, beta: float = 0.02, band=None, w_fc: float = 1.0, w_tau: float = 1.0, shrink: float = 0.0, prior: np.ndarray | None = None, l1: float = 0.0, fit_a: str = "none", fit_omega: bool = False, c_max: float = np.inf, max_iter: int = 500) -> Fit:
    """C >= 0 on the mask (and a, omega where asked for) whose filter-consistent moments are nearest to the empirical ones.

    Raises ValueError where the start is unstable; unstable points on the way cost UNSTABLE times the first loss."""
    n, cov = len(c0), [cov] if isinstance(cov, np.ndarray) and cov.ndim == 2 else list(cov)
    if len(cov) != len(lags):
        raise ValueError("as many lagged matrices as lags are needed")
    mask = np.asarray(mask, bool) & ~np.eye(n, dtype=bool)
    at = np.nonzero(mask)
    prior = c0 if prior is None else prior
    h2 = filters.autocorrelation(tr, band, tol=1e-6)
    a0, w0 = np.broadcast_to(np.asarray(a, float), (n,)).copy(), np.asarray(omega, float)
    v = Vector()
    v.add("C", c0[at], 0.0, c_max)
    v.add("a", _share(fit_a, np.full(n, a0.mean()) if fit_a == "global" else a0), *A_BOUNDS)
    v.add("omega", w0 if fit_omega else w0[:0], OMEGA_LEAST, np.inf)
    state = {"first": None, "unstable": 0}
    history: list[dict] = []

    def whole(x: np.ndarray):
        p = v.split(x)
        c = np.zeros((n, n))
        c[at] = p["C"]
        return c, (a0 if fit_a == "none" else np.broadcast_to(p["a"], (n,)) if fit_a == "global" else p["a"]), (p["omega"] if fit_omega else w0)

    def value(x: np.ndarray):
        c, av, w = whole(x)
        jac = hopf.jacobian(c, 1.0, av, w)
        if not np.isfinite(jac).all() or hopf.max_real(jac) >= 0:
            state["unstable"] += 1
            return UNSTABLE * (state["first"] or 1.0), np.zeros_like(x)
        m = hopf.moments(jac, beta, tr, [0, *lags], h2)
        loss, grads, r, lagged = hopf.moment_loss(m, n, fc, cov, w_fc, w_tau)
        if state["first"] is None:
            state["first"] = loss
        gc, ga, gw = hopf.parameter_gradients(m.gradient(grads), n)
        d = (c - prior) * mask
        state["last"] = (r, lagged)
        return loss + 0.5 * shrink * np.sum(d**2) + l1 * c[at].sum(), v.join({"C": (gc + shrink * d)[at] + l1, "a": ga if fit_a == "node" else [ga.sum()] if fit_a == "global" else [], "omega": gw if fit_omega else []})

    x0 = np.concatenate(v.start)
    top = hopf.max_real(hopf.jacobian(*[(q := whole(x0))[0], 1.0, q[1], q[2]]))
    if not np.isfinite(top) or top >= 0:
        raise ValueError(f"the linearisation is unstable at the start (greatest real part {top:.3g})")
    res = bounded_bfgs(value, x0, *v.bounds(), max_iter=max_iter, each=lambda x, f: history.append({"loss": f, **fit_error(fc, state["last"][0], cov[0], state["last"][1][0])}))
    c, av, w = whole(res.x)
    m = hopf.moments(hopf.jacobian(c, 1.0, av, w), beta, tr, [0, *lags], h2)
    _, _, r, lagged = hopf.moment_loss(m, n, fc, cov)
    metrics = fit_error(fc, r, cov[0], lagged[0]) | {"n_unstable_evaluations": state["unstable"], "tau_rmse_all_lags": float(np.mean([np.sqrt(np.mean((x - y) ** 2)) for x, y in zip(cov, lagged)]))}
    return Fit(c, np.array(av), np.array(w), res.fun, res.n_iter, res.converged, r, lagged[0], metrics | _hits(v, res.x), history)


def whittle(c: np.ndarray, a, omega: np.ndarray, q: np.ndarray, freqs: np.ndarray, spectra: np.ndarray, gain=None, tr: float | None = None, aliases: int = 0, noise: np.ndarray | None = None):
    """(negative log likelihood, gradients for C, a, omega, q, noise, model spectra); all frequencies at once."""
    n, nf = len(c), len(freqs)
    jac, q2 = hopf.jacobian(c, 1.0, a, omega), np.concatenate([q, q])
    gain = np.ones(nf) if gain is None else gain
    shifts = [k / tr for k in range(-aliases, aliases + 1)] if tr and aliases else [0.0]
    hs = [np.linalg.inv(2j * np.pi * (np.asarray(freqs) + s)[:, None, None] * np.eye(2 * n) - jac) for s in shifts]
    full = sum((h * q2) @ h.conj().transpose(0, 2, 1) for h in hs)
    s = gain[:, None, None] * full[:, :n, :n]
    s = 0.5 * (s + s.conj().transpose(0, 2, 1)) + (np.diag(noise) if noise is not None else 0.0)
    try:
        low = np.linalg.cholesky(s)
    except np.linalg.LinAlgError:
        s = s + 1e-12 * np.trace(s, axis1=1, axis2=2).real[:, None, None] / n * np.eye(n)
        low = np.linalg.cholesky(s)
    inv = np.linalg.inv(s)
    fit = inv @ spectra
    loss = 2 * np.log(np.einsum("fii->fi", low).real).sum() + np.einsum("fii->", fit).real
    gs = inv - fit @ inv
    p = np.zeros((nf, 2 * n, 2 * n), complex)
    p[:, :n, :n] = gain[:, None, None] * gs
    ga, gq = np.zeros((2 * n, 2 * n)), np.zeros(n)
    for h in hs:
        hp = h.conj().transpose(0, 2, 1) @ p
        ga += 2 * np.real(((h * q2) @ hp @ h).sum(0)).T
        own = np.einsum("fij,fji->i", hp, h).real
        gq += own[:n] + own[n:]
    return float(loss), *hopf.parameter_gradients(ga, n), gq, np.einsum("fii->i", gs).real, s


def periodograms(x: np.ndarray, tr: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and cross-periodograms X X^H tr / T of the centred series."""
    f = np.fft.rfft(x - x.mean(0), axis=0)
    return np.fft.rfftfreq(len(x), tr), f[:, :, None] * f[:, None, :].conj() * tr / len(x)


def in_band(freqs: np.ndarray, band, shrink: float = 0.1) -> np.ndarray:
    """Frequencies above 0 within the middle of the band, ``shrink`` of its width left out on either side."""
    edges = np.array([band[0] or 0.0, freqs[-1] if band[1] is None else band[1]])
    off_middle = np.abs(freqs - edges.mean())
    return np.flatnonzero((off_middle <= (0.5 - shrink) * np.ptp(edges) * (1 + 1e-12)) & (freqs > 0))


def fit_whittle(runs: list[np.ndarray], tr: float, c0: np.ndarray, mask: np.ndarray, omega: np.ndarray, band, a=-0.02, fit_a: str = "none", fit_omega: bool = True, fit_noise: str = "global", fit_observed: str = "global", shrink: float = 0.0, prior: np.ndarray | None = None, aliases: int = 1, lag: int = 1, max_iter: int = 500) -> Fit:
    """Greatest Whittle likelihood over C, omega, noise and observation noise (both as logarithms)."""
    n = len(c0)
    parts = [periodograms(x, tr) for x in runs]
    ref = min((f for f, _ in parts), key=len)
    sums, counts = np.zeros((len(ref), n, n), complex), np.zeros(len(ref))
    for f, i in parts:
        to = np.searchsorted(ref, f - 1e-12)
        for k in np.flatnonzero(to < len(ref)):
            sums[to[k]] += i[k]
            counts[to[k]] += 1
    spectra = sums / np.maximum(counts, 1)[:, None, None]
    sel = in_band(ref, band)
    if len(sel) < 3:
        raise ValueError("fewer than three frequencies in the band")
    freqs, spectra = ref[sel], spectra[sel]
    gain = filters.gain(freqs, tr, band)
    mask = np.asarray(mask, bool) & ~np.eye(n, dtype=bool)
    at, prior = np.nonzero(mask), (c0 if prior is None else prior)
    a0, w0 = np.broadcast_to(np.asarray(a, float), (n,)).copy(), np.asarray(omega, float)
    unit = np.einsum("fii->fi", whittle(c0, a0, w0, np.ones(n), freqs, spectra, gain, tr, aliases)[-1]).real.mean(0)
    seen = np.einsum("fii->fi", spectra).real.mean(0)
    q0 = np.log(np.clip(seen / np.maximum(unit, 1e-300), 1e-8, 1e2))
    if fit_noise != "node":
        q0 = np.full(n, q0.mean())
    r0 = np.full(n, np.log(0.01 * seen.mean() + 1e-12))
    v = Vector()
    v.add("C", c0[at], 0.0, np.inf)
    v.add("a", _share(fit_a, np.full(n, a0.mean()) if fit_a == "global" else a0), *A_BOUNDS)
    v.add("omega", w0 if fit_omega else w0[:0], OMEGA_LEAST, np.inf)
    v.add("q", _share(fit_noise, q0), np.log(1e-8), np.log(1e2))
    v.add("r", _share(fit_observed, r0), np.log(1e-12), np.log(1e3))
    spread = lambda part, held: np.broadcast_to(part, (n,)) if len(part) else held
    fold = lambda part, g: g if len(part) == n and n > 1 else [g.sum()] if len(part) else []

    def whole(x: np.ndarray):
        p = v.split(x)
        c = np.zeros((n, n))
        c[at] = p["C"]
        return c, spread(p["a"], a0), spread(p["omega"], w0), np.exp(spread(p["q"], q0)), np.exp(spread(p["r"], r0)) if len(p["r"]) else None

    def value(x: np.ndarray):
        p = v.split(x)
        c, av, w, q, r = whole(x)
        if hopf.max_real(hopf.jacobian(c, 1.0, av, w)) >= 0:
            return 1e12, np.zeros_like(x)
        loss, gc, ga, gw, gq, gr, _ = whittle(c, av, w, q, freqs, spectra, gain, tr, aliases, r)
        d = (c - prior) * mask
        return loss + 0.5 * shrink * np.sum(d**2), v.join({"C": (gc + shrink * d)[at], "a": fold(p["a"], ga), "omega": gw if fit_omega else [], "q": fold(p["q"], gq * q), "r": fold(p["r"], gr * r) if r is not None else []})

    history: list[dict] = []
    res = bounded_bfgs(value, np.concatenate(v.start), *v.bounds(), max_iter=max_iter, ftol=1e-12, gtol=1e-8, each=lambda x, f: history.append({"loss": f}))
    c, av, w, q, r = whole(res.x)
    fc, cov = hopf.analytic(c, 1.0, av, w, tr, lag, float(np.sqrt(q.mean())), band)
    return Fit(c, np.array(av), np.array(w), res.fun, res.n_iter, res.converged, fc, cov, {"whittle_loss": res.fun, "n_frequencies": len(sel), **_hits(v, res.x)}, history, {"noise": np.sqrt(q), "observed": r})


def fit_iterated(fc: np.ndarray, cov: np.ndarray, c0: np.ndarray, model: Callable, mask: np.ndarray, e_fc: float = 1e-3, e_tau: float = 1e-3, max_iter: int = 1000, min_iter: int = 20, patience: int = 50, top: float | None = 0.2, improving_only: bool = False, each: Callable | None = None) -> Fit:
    """C <- project(C + e_fc (FC - model) + e_tau (COV - model)), the best kept; with ``improving_only`` a step that does
    not lower the error is halved instead, until it is a thousandth."""
    c = project(c0, mask, top)
    best, stall, rejected, history, size = None, 0, 0, [], 1.0
    m_fc, m_cov = model(c)
    converged = False
    for it in range(max_iter):
        if not (np.isfinite(m_fc).all() and np.isfinite(m_cov).all()):
            break
        e = fit_error(fc, m_fc, cov, m_cov)
        history.append({"iter": it, **e})
        if each is not None:
            each(it, e)
        if best is None or e["fit_rmse"] < best[0] - 1e-12:
            best, stall = (e["fit_rmse"], c.copy(), it, m_fc, m_cov), 0
        else:
            stall += 1
            if stall >= patience and it >= min_iter:
                converged = True
                break
        new = project(c + size * (e_fc * (fc - m_fc) + e_tau * (cov - m_cov)), mask, top)
        n_fc, n_cov = model(new)
        if improving_only and not fit_error(fc, n_fc, cov, n_cov)["fit_rmse"] < e["fit_rmse"]:
            rejected, size = rejected + 1, size / 2
            if size < 1e-3:
                converged = True
                break
            continue
        c, m_fc, m_cov = new, n_fc, n_cov
    if best is None:
        raise FloatingPointError("the model has no finite moments at the start")
    err, c, at, m_fc, m_cov = best
    metrics = fit_error(fc, m_fc, cov, m_cov) | {"best_iter": at, "n_rejected": rejected, "initial_fit_rmse": history[0]["fit_rmse"]}
    return Fit(c, np.zeros(0), np.zeros(0), err, len(history), converged, m_fc, m_cov, metrics, history)


def fit_surrogate(fc: np.ndarray, cov: np.ndarray, c0: np.ndarray, model: Callable, mask: np.ndarray, g: float, a, omega: np.ndarray, tr: float, lag: int = 1, beta: float = 0.02, band=None, max_iter: int = 200, patience: int = 15, step: float = 0.05, top: float | None = 0.2, rel: float = 1e-4) -> Fit:
    """Residuals of the non-linear model sent through the linear model's adjoint: a descent by line searches.

    Along the negative gradient a step (a share of the greatest weight) is halved until the model's error falls, then the
    next search starts from 1.3 times the step that did, at most LONGEST_STEP. At most ``max_iter`` models are run; the
    fit has converged when no step above SHORTEST_STEP helps or ``patience`` models lowered the error by less than ``rel``."""
    h2 = filters.autocorrelation(tr, band, tol=1e-6)
    c = project(c0, mask, top)
    fc_now, cov_now = model(c)
    error = fit_error(fc, fc_now, cov, cov_now)
    first = error["fit_rmse"]
    history, reached = [{"iter": 0, **error, "step": step}], [first]  # error after each model run
    best_at, converged = 0, False
    while len(reached) <= max_iter and not converged:
        linear = hopf.moments(hopf.jacobian(g * c, 1.0, a, omega), beta, tr, [0, lag], h2)
        _, grads, _, _ = hopf.moment_loss(linear, len(c), fc, [cov], residuals=(fc_now - fc, [cov_now - cov]))
        down = np.where(mask, -g * hopf.parameter_gradients(linear.gradient(grads), len(c))[0], 0.0)
        size = np.abs(down).max()
        if not np.isfinite(size) or size == 0:
            break
        down *= max(c.max(), 1e-9) / size
        lower = False
        while not lower and not converged and len(reached) <= max_iter:
            trial = project(c + step * down, mask, top)
            fc_trial, cov_trial = model(trial)
            error = fit_error(fc, fc_trial, cov, cov_trial)
            lower = np.isfinite(error["fit_rmse"]) and error["fit_rmse"] < reached[-1]
            if lower:
                c, fc_now, cov_now, best_at, step = trial, fc_trial, cov_trial, len(reached), min(1.3 * step, LONGEST_STEP)
            else:
                step /= 2
            reached.append(error["fit_rmse"] if lower else reached[-1])
            history.append({"iter": len(reached) - 1, "error": reached[-1], "step": step})
            converged = step < SHORTEST_STEP or (len(reached) > patience and reached[-1 - patience] - reached[-1] < rel * reached[-1])
    metrics = fit_error(fc, fc_now, cov, cov_now) | {"initial_fit_rmse": first, "n_rejected": int(np.count_nonzero(np.diff(reached) == 0)), "best_iter": best_at}
    return Fit(c, np.zeros(0), np.zeros(0), reached[-1], len(reached) - 1, converged, fc_now, cov_now, metrics, history)
