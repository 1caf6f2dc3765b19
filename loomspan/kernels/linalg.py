"""Dense linear algebra that NumPy lacks."""

from __future__ import annotations

import numpy as np

#: Coefficients of the [13/13] Pade approximant of exp (fixed values).
PADE13 = (64764752532480000, 32382376266240000, 7771770303897600, 1187353796428800, 129060195264000, 10559470521600, 670442572800, 33522128640, 1323241920, 40840800, 960960, 16380, 182, 1)


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential: the argument is halved until it is small, its approximant squared as often."""
    norm = np.abs(a).sum(0).max() if a.size else 0.0
    halvings = max(0, int(np.ceil(np.log2(norm / 5.371920351148152)))) if norm > 0 else 0
    x = a / 2.0**halvings
    even, odd = np.zeros_like(x), np.zeros_like(x)
    power, x2 = np.eye(len(x)), x @ x
    for k in range(0, 14, 2):
        even += PADE13[k] * power
        odd += PADE13[k + 1] * power
        power = power @ x2
    odd = x @ odd
    r = np.linalg.solve(even - odd, even + odd)
    for _ in range(halvings):
        r = r @ r
    return r


def expm_derivative(a: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Derivative of the exponential at ``a`` in direction ``e``, from the upper right block of a doubled matrix."""
    n = len(a)
    return expm(np.block([[a, e], [np.zeros_like(a), a]]))[:n, n:]


def lyapunov(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """X with a X + X a' + q = 0: by the eigenvectors of a, by a Kronecker system where these do not span the space."""
    lam, v = np.linalg.eig(a)
    if np.linalg.cond(v) < 1e10:
        w = np.linalg.inv(v)
        x = np.real(v @ (-(w @ q @ w.conj().T) / (lam[:, None] + lam.conj()[None, :])) @ v.conj().T)
        rest = a @ x + x @ a.T + q
        if np.abs(rest).max() <= 1e-8 * max(1.0, np.abs(q).max()):
            return x
    n = len(a)
    big = np.kron(a, np.eye(n)) + np.kron(np.eye(n), a)
    return np.linalg.solve(big, -q.reshape(-1)).reshape(n, n)
