import numpy as np

from loomspan.operators import signals as S


def panel(spark, x):
    return spark.createDataFrame([(p, n, t, float(v)) for (p, n, t), v in np.ndenumerate(x)], "participant int, node int, t int, x double")


def fft(x):
    return np.fft.rfft(x - x.mean(-1, keepdims=True))


def matrices(x):
    f = fft(x)
    return np.einsum("pif,pjf->pfij", f, f.conj()) * S.TR / x.shape[-1]


def test_all_frequencies(spark):
    x = np.random.default_rng(0).normal(size=(2, 3, 41))
    got = {(r.participant, r.node, r.f): r.p for r in S.spectrum(panel(spark, x)).collect()}
    want = np.abs(fft(x)) ** 2 * S.TR / 41
    assert len(got) == 2 * 3 * 21 and all(np.isclose(v, want[k]) for k, v in got.items())
    cross = {(r.participant, r.f, r.i, r.j): complex(r.re, r.im) for r in S.cross_periodograms(panel(spark, x)).collect()}
    assert len(cross) == 2 * 21 * 9 and all(np.isclose(v, matrices(x)[k]) for k, v in cross.items())


def test_average_of_runs(spark):
    g = np.random.default_rng(1)
    runs = [g.normal(size=(2, 3, 30)), g.normal(size=(2, 3, 50))]
    grids = [np.arange(x.shape[-1] // 2 + 1) / x.shape[-1] for x in runs]
    acc = matrices(runs[0]).sum(0)
    at = np.clip(np.searchsorted(grids[0], grids[1] - 1e-12), 0, 15)
    for m in matrices(runs[1]):
        acc = acc + np.stack([m[at == k].mean(0) for k in range(16)])
    rows = S.average_periodograms([panel(spark, x) for x in runs]).collect()
    assert len(rows) == 16 * 9 and {r.n_items for r in rows} == {4}
    assert all(np.isclose(complex(r.re, r.im), (acc / 4)[r.f, r.i, r.j]) for r in rows)
