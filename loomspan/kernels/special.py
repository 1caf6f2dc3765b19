"""Tail probabilities."""

from __future__ import annotations

import math

import numpy as np


def normal_sf(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(np.asarray(z, float) / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            step = c * d
            f *= step
        if abs(step - 1) < 1e-15:
            break
    return front * f


def student_p(t: float, df: float) -> float:
    """Two-sided p of a t statistic; NaN for what is no number."""
    if not (math.isfinite(t) and df > 0):
        return float("nan")
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def reflected_kde_p(sample: np.ndarray, value: float) -> float:
    """Upper tail at ``value`` of a Gaussian kernel estimate of a positive sample, reflected in 0 (Scott's bandwidth)."""
    s = np.concatenate([sample, -sample])
    sd = s.std(ddof=1)
    if sample.std() <= 0 or sd <= 0:
        return float(value <= sample.mean())
    h = sd * len(s) ** (-0.2)
    below = (normal_sf((s - value) / h) - normal_sf(s / h)).mean()
    return float(np.clip(1 - 2 * below, 0, 1))


def fdr_reject(p: np.ndarray, q: float) -> np.ndarray:
    """Benjamini-Hochberg rejections; values that are no numbers are never rejected."""
    p = np.asarray(p, float)
    n = int(np.isfinite(p).sum())
    order = np.argsort(np.where(np.isfinite(p), p, np.inf), kind="stable")
    ok = np.flatnonzero(p[order][:n] <= q * np.arange(1, n + 1) / max(n, 1))
    out = np.zeros(len(p), bool)
    if len(ok):
        out[order[: ok[-1] + 1]] = True
    return out
