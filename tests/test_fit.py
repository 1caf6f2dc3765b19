import json

import numpy as np
import pytest

from loomspan import cli
from loomspan.kernels import hopf
from loomspan.plans import fit as W

TR = 2.0


@pytest.fixture(scope="module")
def project(spark):
    rng = np.random.default_rng(5)
    n = 6
    sc = rng.random((n, n))
    sc = 0.2 * np.triu(sc, 1) / sc.max()
    sc = sc + sc.T
    w = 2 * np.pi * rng.uniform(0.04, 0.07, n)
    rows = []
    for k in range(6):
        c = sc.copy()
        if k >= 3:
            c[0, 1] *= 4
        x = hopf.simulate(c, 2.0, -0.05, w, TR, 200, [k], linear=True, transient=50)[0]
        rows += [(f"sub-{k}", "1", t, [float(v) for v in x[t]]) for t in range(200)]
    rows += [("sub-7", "1", t, [0.1 * t] * n) for t in range(20)]  # too short
    panel = spark.createDataFrame(rows, "participant string, run string, t int, x array<double>")
    people = spark.createDataFrame([(f"sub-{k}", "A" if k < 3 else "B") for k in range(6)] + [("sub-7", "A")], "participant string, grp string")
    return panel, people, sc, w


def test_a_whole_project(spark, project):
    panel, people, sc, _ = project
    p = W.Project(TR, G_values=(0.5, 1.0, 2.0, 3.0), a=-0.05, max_iter=40, lambdas=(0.0, 0.1), extensions=1)
    r = W.fit_project(spark, panel, people, sc, p, pairs=((0, 3),))
    assert r.search.G > 0 and r.nodes.where("kept").count() == 6
    fits = {x.participant: x for x in r.fits.collect()}
    assert {"sub-0", "sub-5", "sub-7", "all participants", "group A", "group B"} <= set(fits)
    assert fits["sub-7"].ec is None and "too few" in fits["sub-7"].error
    assert all(fits[f"sub-{k}"].fc_corr > 0.5 for k in range(6))
    assert r.edges.count() == 6 * 36 and r.groups.where("grp = 'all'").count() == 36
    c = r.comparison.collect()
    assert len(c) == 30 and {(x.grp_a, x.grp_b) for x in c} == {("A", "B")} and all(0 <= x.p <= 1 for x in c if x.p == x.p)
    assert {x["lambda"] for x in r.lambda_table.collect()} >= {0.0, 0.1}


def test_a_bad_node_is_dropped_and_links_keep_their_numbers(spark, project):
    from pyspark.sql import functions as F

    panel, people, sc, _ = project
    bad = panel.where("participant <> 'sub-7'").withColumn("x", F.transform("x", lambda v, i: F.when(i == 2, F.lit(None).cast("double")).otherwise(v)))
    p = W.Project(TR, G=1.0, a=-0.05, max_iter=15, lambdas=(), method="gec")
    r = W.fit_project(spark, bad, people, sc, p)
    assert {x.node for x in r.nodes.where("NOT kept").collect()} == {2}
    assert {x.i for x in r.edges.select("i").distinct().collect()} == {0, 1, 3, 4, 5}
    with pytest.raises(ValueError, match="two are needed"):
        W.fit_project(spark, bad, people, sc, W.Project(TR, exclude=(0, 1, 3, 4)))


def moments_of(project, spark):
    panel, people, sc, w = project
    p = W.Project(TR)
    runs = W.run_moments(panel.where("participant = 'sub-1'"), list(range(6)), W.Project(TR, method="whittle", lags=(1,))).collect()[0]
    return np.reshape(runs.fc, (6, 6)), np.reshape(runs.cov, (-1, 6, 6)), np.array(runs.omega), [np.reshape(runs.series, (-1, 6))], 2.0 * sc, p


def test_each_method_is_its_kernel(spark, project):
    from loomspan.kernels import fits

    fc, cov, w, series, start, p = moments_of(project, spark)
    mask, a = start > 0, np.full(6, -0.05)
    got = {m: W.fit_one(W.Project(TR, method=m, n_vol=60, n_sim=1), fc, cov, w, start, mask, a, start, 0.1, 8, series).C for m in W.METHODS}
    weight = 0.1 * 36 / np.sum(start**2)
    assert np.array_equal(got["gradient"], fits.fit_moments(fc, cov[0], start, mask, w, TR, (1,), a, p.beta, p.band, shrink=weight, prior=start, fit_omega=True, max_iter=8).C)
    assert np.array_equal(got["whittle"], fits.fit_whittle(series, TR, start, mask, w, p.band, a, shrink=weight, prior=start, max_iter=8).C)
    assert np.array_equal(got["gec"], fits.fit_iterated(fc, cov[0], start, lambda c: hopf.analytic(c, 1.0, a, w, TR, 1, p.beta, p.band), mask, max_iter=8, top=float(start.max())).C)
    for x, y in __import__("itertools").combinations(W.METHODS, 2):
        assert not np.allclose(got[x], got[y]), (x, y)


def test_settings_that_cannot_be_met_are_errors():
    for bad in ({"method": "nonsense"}, {"fit_a": "some"}, {"lags": (0,)}, {"lags": ()}, {"lags": (1, 2), "method": "gec"}, {"method": "whittle", "band": None}):
        with pytest.raises(ValueError):
            W.Project(TR, **bad)


def test_several_lags_weights_and_a_profile(spark, project):
    panel, people, sc, _ = project
    few = panel.where("participant IN ('sub-0', 'sub-4')")
    base = dict(G=1.0, a=-0.05, max_iter=8, lambdas=())
    ec = lambda **more: np.array([r.ec for r in W.fit_project(spark, few, people, sc, W.Project(TR, **(base | more))).edges.orderBy("participant", "i", "j").collect()])
    one = ec()
    for more in ({"lags": (1, 2)}, {"w_fc": 0.1}, {"fit_a": "node"}, {"profile": np.linspace(0.2, 1, 6), "a": 0.05}, {"method": "whittle"}, {"method": "surrogate", "n_vol": 60, "n_sim": 1}):
        assert not np.allclose(ec(**more), one), more


def test_command_line(spark, project, tmp_path):
    panel, people, sc, _ = project
    panel.write.parquet(str(tmp_path / "panel"))
    (tmp_path / "p.tsv").write_text("participant_id\tgroup\n" + "".join(f"{r.participant}\t{r.grp}\n" for r in people.collect()))
    np.savetxt(tmp_path / "sc.tsv", sc, delimiter="\t")
    args = ["--output-dir", str(tmp_path / "out"), "--set", "model.search.G=[1.0, 2.0]", "--set", "model.linear.max_iter=10", "--set", "model.linear.lambda_group=0.1", "--set", "model.a=-0.05", "project", "--panel", str(tmp_path / "panel"), "--participants", str(tmp_path / "p.tsv"), "--structure", str(tmp_path / "sc.tsv"), "--tr", "2.0"]
    assert cli.main(args) == 0
    assert spark.read.parquet(str(tmp_path / "out/edges")).count() == 6 * 36 and json.load(open(tmp_path / "out/summary.json"))["G"] > 0
