"""The Hopf oscillator network: linearised moments, their gradients, spectra and simulation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from loomspan.kernels import filters, linalg


def jacobian(c: np.ndarray, g: float, a, omega: np.ndarray) -> np.ndarray:
    """2N x 2N real Jacobian at the origin of dz = (a + i w - |z|^2) z + G sum C (z_k - z_j)."""
    w = g * np.asarray(c, float)
    w = w - np.diag(np.diag(w))
    n = len(w)
    block = w + np.diag(np.broadcast_to(np.asarray(a, float), (n,)) - w.sum(1))
    spin = np.diag(np.asarray(omega, float))
    return np.block([[block, -spin], [spin, block]])


def max_real(a: np.ndarray) -> float:
    return float(np.linalg.eigvals(a).real.max())


def stationary(a: np.ndarray, beta) -> np.ndarray:
    """Covariance of dX = A X dt + beta dW."""
    s = linalg.lyapunov(a, np.diag(np.broadcast_to(np.square(np.asarray(beta, float)), (len(a),))))
    return 0.5 * (s + s.T)


def correlations(s0: np.ndarray, st: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation and lagged correlation of the covariances of the observed half."""
    sd = np.sqrt(np.clip(np.diag(s0), 1e-300, None))
    fc = np.clip(s0 / np.outer(sd, sd), -1, 1)
    np.fill_diagonal(fc, 1.0)
    return fc, st / np.outer(sd, sd)


def _weights(h2: np.ndarray, tau: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of c(k) and of c(k)' (k > 0) in the filtered covariance at lag tau."""
    at = lambda m: np.where(np.abs(m) < len(h2), h2[np.minimum(np.abs(m), len(h2) - 1)], 0.0)
    return at(tau - k), np.where(k > 0, at(tau + k), 0.0)


@dataclass
class Moments:
    """Covariances at the lags asked for, and what their gradient needs."""

    a: np.ndarray
    tr: float
    h2: np.ndarray
    lags: list[int]
    s: np.ndarray
    p: np.ndarray
    c: list[np.ndarray]
    at: list[np.ndarray]

    def gradient(self, grads: list[np.ndarray]) -> np.ndarray:
        """dL/dA from dL/dS(lag): the recursion c(k) = P c(k-1) backwards, then exp and Lyapunov adjoints."""
        k = np.arange(len(self.c))
        w = [_weights(self.h2, lag, k) for lag in self.lags]
        own = lambda i: sum(wp[i] * g + wm[i] * g.T for (wp, wm), g in zip(w, grads))
        lam = own(len(self.c) - 1)
        gp = np.zeros_like(self.a)
        for i in range(len(self.c) - 1, 0, -1):
            gp += lam @ self.c[i - 1].T
            lam = own(i - 1) + self.p.T @ lam
        out = self.tr * linalg.expm_derivative(self.a.T * self.tr, gp) if len(self.c) > 1 else np.zeros_like(self.a)
        z = linalg.lyapunov(self.a.T, 0.5 * (lam + lam.T))
        return out + 2 * z @ self.s


def moments(a: np.ndarray, beta: float, tr: float, lags: list[int], h2: np.ndarray) -> Moments:
    """Filter-consistent covariances S(lag) = sum_m h2(|m|) c(lag - m) by recursion."""
    s = stationary(a, beta)
    p = linalg.expm(a * tr)
    last = len(h2) - 1 + max(lags)
    c = [s]
    for _ in range(last):
        c.append(p @ c[-1])
    k = np.arange(last + 1)
    at = []
    for lag in lags:
        wp, wm = _weights(h2, lag, k)
        at.append(sum(x * m for x, m in zip(wp, c) if x != 0) + sum(x * m.T for x, m in zip(wm, c) if x != 0))
    return Moments(a, tr, h2, list(lags), s, p, c, at)


def analytic(c: np.ndarray, g: float, a, omega: np.ndarray, tr: float, lag: int = 1, beta: float = 0.02, band=None) -> tuple[np.ndarray, np.ndarray]:
    """Model correlation and lagged correlation, by eigenvectors; an unstable system falls back to unfiltered moments."""
    n, jac = len(c), jacobian(c, g, a, omega)
    s = stationary(jac, beta)
    lam, v = np.linalg.eig(jac)
    if band is None or (lam.real >= 0).any():
        return correlations(s[:n, :n], (linalg.expm(jac * lag * tr) @ s)[:n, :n])
    h2 = filters.autocorrelation(tr, band)
    k = np.arange(len(h2) + lag)
    powers = np.exp(np.outer(lam, k * tr))
    w = np.linalg.inv(v)

    def at(tau: int) -> np.ndarray:
        wp, wm = _weights(h2, tau, k)
        ahead = np.real((v * (powers @ wp)) @ w) @ s
        back = np.real((v * (powers @ wm)) @ w) @ s
        return ahead + back.T

    s0 = at(0)
    return correlations(0.5 * (s0 + s0.T)[:n, :n], at(lag)[:n, :n])


def power(c: np.ndarray, g: float, a, omega: np.ndarray, freqs: np.ndarray, beta: float = 0.02) -> np.ndarray:
    """Power spectrum of every node, F x N."""
    n, jac = len(c), jacobian(c, g, a, omega)
    h = np.linalg.inv(2j * np.pi * np.asarray(freqs)[:, None, None] * np.eye(2 * n) - jac)
    return beta**2 * (np.abs(h[:, :n]) ** 2).sum(2)


def moment_loss(m: Moments, n: int, fc: np.ndarray, cov: list[np.ndarray], w_fc: float = 1.0, w_tau: float = 1.0, residuals=None):
    """(loss, gradients for S(0) and each S(lag), model correlation, model lagged correlations). The first lag is 0;
    ``residuals`` (of correlation and of each lag) replace those of the linear model."""
    s0 = m.at[0][:n, :n]
    sd = np.sqrt(np.clip(np.diag(s0), 1e-300, None))
    d = np.outer(sd, sd)
    r = s0 / d
    lagged = [x[:n, :n] / d for x in m.at[1:]]
    off = 1 - np.eye(n)
    e_fc, e_lag = (r - fc, [x - y for x, y in zip(lagged, cov)]) if residuals is None else residuals
    e_fc, k = e_fc * off, w_tau / max(len(lagged), 1)
    loss = 0.5 * w_fc * np.sum(e_fc**2) + 0.5 * k * sum(np.sum(e**2) for e in e_lag)
    e_fc, e_lag = w_fc * e_fc, [k * e for e in e_lag]
    pull = e_fc * r + sum((e * x for e, x in zip(e_lag, lagged)), np.zeros((n, n)))
    g0 = e_fc / d - np.diag((pull.sum(0) + pull.sum(1)) / (2 * np.clip(np.diag(s0), 1e-300, None)))

    def widen(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(m.a)
        out[:n, :n] = x
        return out

    return float(loss), [widen(g0)] + [widen(e / d) for e in e_lag], r, lagged


def parameter_gradients(ga: np.ndarray, n: int, g: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """dL/dC, dL/da, dL/domega from dL/dA."""
    block = ga[:n, :n] + ga[n:, n:]
    own = np.diag(block)
    dc = g * (block - own[:, None])
    np.fill_diagonal(dc, 0.0)
    return dc, own.copy(), np.diag(ga[n:, :n]) - np.diag(ga[:n, n:])


def simulate(c: np.ndarray, g: float, a, omega: np.ndarray, tr: float, n_vol: int, seeds: list[int], dt: float = 0.1, beta: float = 0.02, transient: float = 100.0, linear: bool = False, start=None) -> np.ndarray:
    """Euler-Maruyama runs of several seeds at once, x at the end of every TR: seeds x volumes x nodes.

    A TR is whole steps of at most ``dt``, halved until a step is short against the fastest row of the Jacobian; the
    transient is whole TRs. Each seed has its own stream of draws (initial x, initial y, then the noise of each TR). A
    state that is not finite raises FloatingPointError."""
    n, jac = len(c), hopf_rows(c, g, a, omega)
    inward = jac["own"]
    steps = int(np.ceil(round(tr / dt, 9)))
    while tr / steps * jac["fastest"] > 0.25:
        steps *= 2
    h, warm = tr / steps, int(np.ceil(round(transient / tr, 9)))
    streams = [np.random.default_rng(seed) for seed in seeds]
    if start is None:
        z = 0.1 * np.stack([q.standard_normal((2, n)) for q in streams], axis=1)
    else:
        z = np.repeat(np.asarray(start, float)[:, None, :], len(seeds), axis=1)
    x, y = z
    into, spin, kick = jac["coupling"].T, np.asarray(omega, float), beta * h**0.5
    out = np.empty((len(seeds), n_vol, n))
    with np.errstate(all="ignore"):
        for volume in range(-warm, n_vol):
            noise = kick * np.stack([q.standard_normal((steps, 2, n)) for q in streams], axis=2)
            for to_x, to_y in noise:
                hold = inward if linear else inward - x * x - y * y
                x, y = x + h * (hold * x - spin * y + x @ into) + to_x, y + h * (hold * y + spin * x + y @ into) + to_y
            if not np.isfinite(x).all():
                raise FloatingPointError("the simulation diverged; reduce dt or G")
            if volume >= 0:
                out[:, volume] = x
    return out


def hopf_rows(c: np.ndarray, g: float, a, omega: np.ndarray) -> dict:
    """Coupling without the diagonal, each node's own rate a - sum C, and a bound of the fastest rate (Gershgorin)."""
    jac = jacobian(c, g, a, omega)
    n = len(c)
    own = np.diag(jac)[:n].copy()
    return {"coupling": jac[:n, :n] - np.diag(own), "own": own, "fastest": float(np.abs(jac).sum(1).max())}
