import math

import numpy as np
import pytest

from loomspan.kernels import filters, fits, flow, hopf, linalg, optimise, special

TR, BAND = 2.0, (0.008, 0.08)


@pytest.fixture(scope="module")
def system():
    rng = np.random.default_rng(0)
    n = 8
    c = rng.random((n, n)) * 0.2 * (rng.random((n, n)) < 0.5)
    np.fill_diagonal(c, 0)
    return c, 2 * np.pi * rng.uniform(0.04, 0.07, n)


def test_exponential_and_its_derivative():
    rng = np.random.default_rng(1)
    a, e = rng.standard_normal((5, 5)), rng.standard_normal((5, 5))
    lam, v = np.linalg.eig(a)
    assert np.allclose(linalg.expm(a), np.real(v @ np.diag(np.exp(lam)) @ np.linalg.inv(v)))
    assert np.allclose(linalg.expm(40 * a), linalg.expm(20 * a) @ linalg.expm(20 * a), rtol=1e-8)
    h = 1e-6
    assert np.allclose(linalg.expm_derivative(a, e), (linalg.expm(a + h * e) - linalg.expm(a - h * e)) / (2 * h), atol=1e-5)


def test_lyapunov_also_for_defective_matrices():
    for a in (np.array([[-1.0, 1.0], [0.0, -1.0]]), np.diag([-1.0, -2.0]) + 0.1):
        q = np.array([[2.0, 0.3], [0.3, 1.0]])
        x = linalg.lyapunov(a, q)
        assert np.allclose(a @ x + x @ a.T + q, 0, atol=1e-10)


def test_butterworth_response():
    for band, inside, outside in (((0.008, 0.08), [0.03], [0.0, 0.001, 0.24]), ((None, 0.08), [0.0, 0.01], [0.24]), ((0.02, None), [0.2], [0.0, 0.002])):
        g = filters.gain(np.array(inside + outside), TR, band)
        assert (g[: len(inside)] > 0.9).all() and (g[len(inside) :] < 0.05).all()
        assert (np.abs(np.roots(filters.butterworth(TR, band)[1])) < 1).all()
    b, a = filters.butterworth(1.0, (None, 0.25))  # half the Nyquist frequency: known coefficients
    assert np.allclose(b, [0.29289322, 0.58578644, 0.29289322]) and np.allclose(a, [1, 0, 0.17157288])
    assert filters.butterworth(TR, None) is None and filters.butterworth(TR, (0, 0.5)) is None


def test_zero_phase_keeps_the_phase_and_the_band():
    t = np.arange(600)
    slow, fast = np.sin(2 * np.pi * 0.03 * t * TR), np.sin(2 * np.pi * 0.2 * t * TR)
    y = filters.bandpass(np.column_stack([slow + fast, slow]), TR, BAND)
    assert np.corrcoef(y[50:-50, 0], slow[50:-50])[0, 1] > 0.99
    assert filters.bandpass(np.ones((5, 2)), TR, None).max() == 0


def test_filter_autocorrelation_is_the_response_to_an_impulse():
    h2 = filters.autocorrelation(TR, BAND)
    x = np.zeros((4001, 1))
    x[2000] = 1
    y = filters.zero_phase(*filters.butterworth(TR, BAND), x)[2000:, 0]
    assert np.allclose(h2[:200], y[:200], atol=1e-9)


def test_phase_of_a_wave():
    t = np.arange(400)
    ph = filters.analytic_phase(np.cos(2 * np.pi * t / 40)[:, None])[:, 0]
    assert np.allclose(np.cos(ph), np.cos(2 * np.pi * t / 40), atol=1e-6)
    assert np.allclose(filters.order_parameter(np.column_stack([np.sin(t / 5), np.sin(t / 5)])), 1)


def test_cleaning_removes_the_confounds():
    rng = np.random.default_rng(2)
    conf, noise = rng.standard_normal((300, 2)), rng.standard_normal((300, 3))
    x = noise + conf @ rng.standard_normal((2, 3)) * 5 + np.arange(300)[:, None]
    y = filters.clean(x, conf, None, TR, None)
    assert np.abs(np.corrcoef(y.T, conf.T)[:3, 3:]).max() < 0.02 and np.allclose(y.std(0), 1)
    assert np.isfinite(filters.clean(x, np.ones((300, 1)), np.eye(300)[:, :2], TR, BAND, "psc")).all()


def test_recursion_and_eigenvectors_agree(system):
    c, w = system
    n = len(c)
    m = hopf.moments(hopf.jacobian(c, 1.0, -0.02, w), 0.02, TR, [0, 1, 3], filters.autocorrelation(TR, BAND))
    for lag, s in zip((1, 3), m.at[1:]):
        fc, cov = hopf.correlations(m.at[0][:n, :n], s[:n, :n])
        fc2, cov2 = hopf.analytic(c, 1.0, -0.02, w, TR, lag, 0.02, BAND)
        assert np.allclose(fc, fc2, atol=1e-8) and np.allclose(cov, cov2, atol=1e-8)


def test_moments_against_a_long_simulation(system):
    c, w = system
    x = hopf.simulate(c, 1.0, -0.02, w, TR, 4000, [0, 1, 2], linear=True, transient=50)
    fc, cov = hopf.analytic(c, 1.0, -0.02, w, TR)
    up = np.triu_indices(8, 1)
    assert np.corrcoef(np.mean([np.corrcoef(r.T) for r in x], axis=0)[up], fc[up])[0, 1] > 0.95


def test_simulation_streams(system):
    c, w = system
    both = hopf.simulate(c, 1.0, -0.02, w, TR, 20, [4, 9], transient=10)
    assert np.allclose(both[1], hopf.simulate(c, 1.0, -0.02, w, TR, 20, [9], transient=10)[0])
    with pytest.raises(FloatingPointError):
        hopf.simulate(c, 1.0, 3.0, w, TR, 400, [1], linear=True)


@pytest.mark.parametrize("lags", [(1,), (1, 3)])
def test_gradients_of_the_moment_loss(system, lags):
    c, w = system
    n, rng = 8, np.random.default_rng(3)
    fc, cov, h2 = rng.random((n, n)), [rng.random((n, n)) for _ in lags], filters.autocorrelation(TR, BAND, tol=1e-6)

    def loss(c, a, w):
        return hopf.moment_loss(hopf.moments(hopf.jacobian(c, 1.0, a, w), 0.02, TR, [0, *lags], h2), n, fc, cov, 1.0, 0.7)[0]

    a = np.full(n, -0.02)
    m = hopf.moments(hopf.jacobian(c, 1.0, a, w), 0.02, TR, [0, *lags], h2)
    dc, da, dw = hopf.parameter_gradients(m.gradient(hopf.moment_loss(m, n, fc, cov, 1.0, 0.7)[1]), n)
    h = 1e-6
    for i, j in ((0, 1), (5, 2)):
        e = np.zeros((n, n))
        e[i, j] = h
        assert math.isclose((loss(c + e, a, w) - loss(c - e, a, w)) / (2 * h), dc[i, j], rel_tol=1e-4, abs_tol=1e-6)
    e = np.eye(n)[2] * h
    assert math.isclose((loss(c, a + e, w) - loss(c, a - e, w)) / (2 * h), da[2], rel_tol=1e-4)
    assert math.isclose((loss(c, a, w + e) - loss(c, a, w - e)) / (2 * h), dw[2], rel_tol=1e-4)


def test_gradients_of_the_likelihood(system):
    c, w = system
    n, rng = 8, np.random.default_rng(4)
    x = rng.standard_normal((3, n, 20)) + 1j * rng.standard_normal((3, n, 20))
    given = (np.array([0.02, 0.04, 0.06]), x @ x.conj().transpose(0, 2, 1) / 20, np.array([1, 0.9, 0.8]), TR, 1)
    at = {"c": c, "a": np.full(n, -0.02), "w": w, "q": np.full(n, 0.5), "r": np.full(n, 0.1)}
    value = lambda p: fits.whittle(p["c"], p["a"], p["w"], p["q"], *given, p["r"])
    grads = dict(zip("cawqr", value(at)[1:6]))
    for k, i in (("c", (0, 1)), ("a", 2), ("w", 2), ("q", 3), ("r", 4)):
        up, down = at[k].copy(), at[k].copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert math.isclose((value(at | {k: up})[0] - value(at | {k: down})[0]) / 2e-6, grads[k][i], rel_tol=1e-4, abs_tol=1e-5)


def test_fit_recovers_the_coupling_without_noise(system):
    c, w = system
    fc, cov = hopf.analytic(c, 1.0, -0.02, w, TR, 1, 0.02, BAND)
    mask = c > 0
    f = fits.fit_moments(fc, cov, 0.05 * mask, mask, w, TR, (1,), -0.02, 0.02, BAND)
    assert np.corrcoef(f.C[mask], c[mask])[0, 1] > 0.99 and f.metrics["fit_rmse"] < 1e-4
    g = fits.fit_iterated(fc, cov, 0.05 * mask, lambda x: hopf.analytic(x, 1.0, -0.02, w, TR, 1, 0.02, BAND), mask, 5e-3, 5e-3, 150)
    assert g.metrics["fit_rmse"] < 0.3 * g.metrics["initial_fit_rmse"] and abs(g.C.max() - 0.2) < 1e-12
    s = fits.fit_surrogate(fc, cov, 0.05 * mask, lambda x: hopf.analytic(x, 1.0, -0.02, w, TR, 1, 0.02, BAND), mask, 1.0, -0.02, w, TR, 1, 0.02, BAND, 30)
    assert s.metrics["fit_rmse"] < 0.5 * s.metrics["initial_fit_rmse"]


def test_fit_guards(system):
    c, w = system
    fc, cov = hopf.analytic(c, 1.0, -0.02, w, TR)
    with pytest.raises(ValueError, match="unstable"):
        fits.fit_moments(fc, cov, 0 * c, c > 0, w, TR, a=0.5)
    with pytest.raises(ValueError, match="lags"):
        fits.fit_moments(fc, [cov], c, c > 0, w, TR, lags=(1, 2))
    f = fits.fit_moments(fc, cov, np.minimum(c, 0.05), c > 0, w, TR, c_max=0.05, max_iter=30)
    assert f.C.max() <= 0.05 + 1e-12 and f.metrics["n_C_at_upper"] > 0
    with pytest.raises(ValueError, match="frequencies"):
        fits.fit_whittle([np.random.default_rng(0).standard_normal((12, 8))], TR, c, c > 0, w, (0.01, 0.02))


def test_likelihood_fit_finds_the_coupling():
    rng = np.random.default_rng(7)
    n = 6
    c = rng.random((n, n)) * 0.3 * (rng.random((n, n)) < 0.5)
    np.fill_diagonal(c, 0)
    w = 2 * np.pi * rng.uniform(0.04, 0.07, n)
    runs = list(hopf.simulate(c, 1.0, -0.05, w, TR, 1000, list(range(6)), linear=True))
    f = fits.fit_whittle(runs, TR, 0.1 * (c > 0), c > 0, w, None or (0.0, 0.24), a=-0.05, aliases=2, fit_omega=False, max_iter=200)
    assert np.corrcoef(f.C[c > 0], c[c > 0])[0, 1] > 0.5


def naive_transfer(x, i, k, lags):
    past = lambda n: np.column_stack([x[lags - 1 - p : len(x) - p, n] for p in range(1, lags)])
    now = x[lags - 1 :, i]
    det = lambda *parts: np.linalg.slogdet(np.atleast_2d(np.cov(np.column_stack(parts), rowvar=False)))[1]
    alone = det(now, past(i)) - det(past(i))
    joint = det(now, past(i), past(k)) - det(past(i), past(k))
    return (alone - joint) / (det(now) - joint)


def test_transfer_entropy():
    rng = np.random.default_rng(0)
    a = np.zeros((5, 5))
    a[1, 0], a[2, 3], a[4, 0] = 0.5, 0.5, 0.4
    x = np.zeros((600, 5))
    for t in range(1, 600):
        x[t] = 0.3 * x[t - 1] + a @ x[t - 1] + rng.standard_normal(5)
    d = flow.ndte(x, 5)
    assert {(int(i), int(k)) for i, k in zip(*np.unravel_index(np.argsort(d, axis=None)[-3:], d.shape))} == {(1, 0), (2, 3), (4, 0)}
    assert all(abs(d[i, k] - max(naive_transfer(x, i, k, 5), 1e-15)) < 1e-10 for i in range(5) for k in range(5) if i != k)
    s = flow.significance(d, np.stack([flow.ndte(flow.shifted(x, k), 5) for k in range(40)]), source="gauss")
    assert s["reject"][1, 0] and s["reject"][2, 3] and s["reject"].sum() <= 8
    assert s["p_emp"][1, 0] == 1 / 41 and s["p_kde"][1, 0] < 0.1 < np.median(s["p_kde"])
    assert np.allclose(s["in_flow"].sum(), s["out_flow"].sum())
    with pytest.raises(ValueError):
        flow.ndte(x[:10], 5)


def test_toeplitz_covariance():
    rng = np.random.default_rng(5)
    c = [rng.random((2, 2)) for _ in range(3)]
    s = flow.toeplitz_covariance(c)
    assert np.allclose(s, s.T) and s[0 * 3 + 0, 1 * 3 + 2] == pytest.approx(0.5 * (c[2][0, 1] + c[2][0, 1]))


def test_tails():
    assert special.student_p(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and special.student_p(0.0, 3) == pytest.approx(1.0)
    assert math.isnan(special.student_p(float("nan"), 3)) and special.normal_sf(np.array([1.959964]))[0] == pytest.approx(0.025, abs=1e-7)
    s = np.abs(np.random.default_rng(6).standard_normal(400))
    assert special.reflected_kde_p(s, 0.0) == pytest.approx(1.0) and special.reflected_kde_p(s, 1.96) == pytest.approx(0.07, abs=0.04)
    assert special.fdr_reject(np.array([0.01, np.nan, 0.02, 0.9, 0.04]), 0.05).tolist() == [True, False, True, False, False]
    assert special.fdr_reject(np.array([np.nan]), 0.05).tolist() == [False]


def test_minimisers():
    bowl = lambda x: (float(np.sum((x - [3.0, -1.0]) ** 2)), 2 * (x - [3.0, -1.0]))
    r = optimise.bounded_bfgs(bowl, np.zeros(2), np.zeros(2), np.full(2, 10.0))
    assert np.allclose(r.x, [3, 0]) and r.converged
    rosen = lambda x: (float((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2), np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)]))
    assert np.allclose(optimise.bounded_bfgs(rosen, np.array([-1.2, 1.0]), np.full(2, -5.0), np.full(2, 5.0), ftol=1e-15).x, 1, atol=1e-4)
    assert np.allclose(optimise.directions(lambda x: (x[0] - 1) ** 2 + (x[1] - 2) ** 2, np.array([3.0, 3.0]), np.zeros(2), np.full(2, 5.0), 200).x, [1, 2], atol=0.02)
    s = optimise.swarm(lambda p: ((p - [1, 2]) ** 2).sum(1), [0, 0], [5, 5], seed=1)
    assert np.allclose(s.x, [1, 2], atol=0.1) and s.n_fev == 20 * len(s.history)


def test_similarity():
    m = np.random.default_rng(8).random((12, 12))
    assert filters.ssim(m, m) == pytest.approx(1.0) and filters.ssim(m, m.T) < 0.9 and filters.ssim(np.ones((3, 3)), np.ones((3, 3))) == 1.0
