"""Normalised directed transfer entropy from lagged covariances (row = target, column = source)."""

from __future__ import annotations

import numpy as np

from loomspan.kernels import special

LEAST = 1e-15


def lagged_covariance(x: np.ndarray, lags: int) -> np.ndarray:
    """Sample covariance of [x_n(t - p)], index n * lags + p."""
    x = np.asarray(x, float)
    if len(x) <= lags + 5:
        raise ValueError("the series is too short for so many lags")
    e = np.stack([x[lags - 1 - p : len(x) - p] for p in range(lags)], axis=2).reshape(len(x) - lags + 1, -1)
    return np.cov(e, rowvar=False, ddof=1)


def toeplitz_covariance(c: list[np.ndarray]) -> np.ndarray:
    """The same from model covariances c[k] = cov(x(t + k), x(t))."""
    n, m = len(c[0]), len(c)
    s = np.empty((n, m, n, m))
    for p in range(m):
        for q in range(m):
            s[:, p, :, q] = c[q - p] if q >= p else c[p - q].T
    s = s.reshape(n * m, n * m)
    return 0.5 * (s + s.T)


def transfer(s: np.ndarray, n: int, lags: int) -> np.ndarray:
    """All pairs at once: residual variances of the present given the own past, and given the own and the source's past,
    are Schur complements."""
    s4 = s.reshape(n, lags, n, lags)
    v = s4[np.arange(n), 0, np.arange(n), 0]
    past = s4[:, 1:, :, 1:]
    out = np.zeros((n, n))
    for i in range(n):
        own, to_own = past[i, :, i], s4[i, 0, i, 1:]
        alone = v[i] - to_own @ np.linalg.solve(own, to_own)
        others = np.array([k for k in range(n) if k != i])
        m = lags - 1
        both = np.empty((n - 1, 2 * m, 2 * m))
        both[:, :m, :m] = own
        both[:, :m, m:] = past[i][:, others].transpose(1, 0, 2)
        both[:, m:, :m] = both[:, :m, m:].transpose(0, 2, 1)
        both[:, m:, m:] = past[others, :, others]
        rhs = np.concatenate([np.tile(to_own, (n - 1, 1)), s4[i, 0, others, 1:]], axis=1)
        joint = np.clip(v[i] - np.einsum("kp,kp->k", rhs, np.linalg.solve(both, rhs[:, :, None])[:, :, 0]), 1e-300, None)
        gain, info = np.log(max(alone, 1e-300)) - np.log(joint), np.log(max(v[i], 1e-300)) - np.log(joint)
        out[i, others] = np.where(info > 0, gain / np.where(info > 0, info, 1.0), 0.0)
        out[i, others] = np.where(out[i, others] <= 0, LEAST, out[i, others])
    return out


def ndte(x: np.ndarray, lags: int = 10) -> np.ndarray:
    return transfer(lagged_covariance(x, lags), x.shape[1], lags)


def shifted(x: np.ndarray, seed: int) -> np.ndarray:
    """Every column shifted circularly by its own offset within 5 and 95 % of the length."""
    rng, n = np.random.default_rng(seed), len(x)
    lo, hi = int(np.ceil(0.05 * n)), int(np.ceil(0.95 * n))
    return np.column_stack([np.roll(x[:, k], -int(rng.integers(lo, hi + 1))) for k in range(x.shape[1])])


def significance(value: np.ndarray, surrogates: np.ndarray, q: float = 0.05, source: str = "kde") -> dict[str, np.ndarray]:
    """z and p of every link against its surrogates (S x N x N), rejections, flows of the significant links."""
    n = len(value)
    off = ~np.eye(n, dtype=bool)
    mu, sd = surrogates.mean(0), surrogates.std(0)
    z = np.where(off & (sd > 0), (value - mu) / np.where(sd > 0, sd, 1.0), 0.0)
    emp = np.where(off, (1 + (surrogates >= value).sum(0)) / (1 + len(surrogates)), 1.0)
    gauss = np.where(off, special.normal_sf(z), 1.0)
    kde = np.ones((n, n))
    for i, k in zip(*np.nonzero(off)):
        kde[i, k] = special.reflected_kde_p(surrogates[:, i, k], value[i, k])
    reject = np.zeros((n, n), bool)
    reject[off] = special.fdr_reject({"kde": kde, "gauss": gauss, "empirical": emp}[source][off], q)
    kept = np.where(reject, value, 0.0)
    return {"mean": mu, "sd": sd, "z": z, "p_emp": emp, "p_gauss": gauss, "p_kde": kde, "reject": reject, "in_flow": kept.sum(1), "out_flow": kept.sum(0)}
