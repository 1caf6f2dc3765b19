import math

import numpy as np

from loomspan.llm import mixing as X


def docs(spark, rows):
    return spark.createDataFrame([(i, s, t, 9, "c") for i, s, t in rows], "doc_id long, source string, text string, n int, rate string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, weight double, max_repeats int")


def test_shares_and_repeats(spark):
    rows = [(n, "big", "word " * (3 + n % 17)) for n in range(900)] + [(1000 + n, "small", "text and more " * (2 + n % 5)) for n in range(40)] + [(2000, "other", "x"), (2001, None, "y"), (2002, "small", ""), (2003, "small", None)]
    t = targets(spark, [("big", 0.6, 1), ("small", 0.3, 3), ("gone", 0.1, 5)])
    m = X.mix(docs(spark, rows + rows[:30]), t)
    got = {r.doc_id: r for r in m.collect()}
    assert len(got) == m.count() == 944
    assert all(got[k].copies == 0 for k in (2000, 2001, 2002, 2003))
    assert all(r.copies <= {"big": 1, "small": 3}.get(r.source, 0) and abs(r.copies - r.rate) < 1 for r in got.values())
    s = {r.source: r for r in X.shares(m, t).collect()}
    assert abs(s["big"].share - 2 / 3) < 0.01 and abs(s["small"].share - 1 / 3) < 0.01 and s["gone"].share == 0 and s["gone"].target == 0
    assert abs(sum(r.share for r in s.values()) - 1) < 1e-9


def dual_by_search(rows, goal, most, u):
    """Multipliers of one source by plain descent on the dual, in NumPy."""
    n, tok = np.array([r[1] for r in rows], float), np.array([r[0] for r in rows], float)
    lam, mu = np.log(goal / (n * tok).sum()), 0.0
    for _ in range(200_000):
        r = np.minimum(most, np.exp(lam + mu * u))
        g0, g1 = (n * tok * r).sum() / goal - 1, (n * tok * r * u).sum() / goal + X.RIDGE * mu
        lam, mu = lam - 0.1 * g0, mu - 0.1 * g1
        if abs(g0) + abs(g1) < 1e-12:
            break
    return lam, mu


def test_newton_meets_the_constraints(spark):
    rows = {"a": [(10, 50), (3, 70), (400, 4)], "b": [(100, 20), (7, 90), (900, 2)], "c": [(5, 10)]}
    h = spark.createDataFrame([(s, t, n) for s, r in rows.items() for t, n in r], "source string, n_tokens long, n long")
    t = targets(spark, [("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.1, 40)])
    found, total = X.sources_of(h, t, 4500.0)
    length = X.lengths_of(h)
    X.balance(h, found, length)
    assert total == 4500
    for s, r in rows.items():
        x = found[s]
        u = (np.log([k for k, _ in r]) - length[0]) / length[1]
        rate = np.minimum(x.most, np.exp(x.lam + x.mu * u))
        assert math.isclose(sum(k * n * q for (k, n), q in zip(r, rate)), x.goal, rel_tol=1e-8)
        if not x.full:
            assert np.allclose((x.lam, x.mu), dual_by_search(r, x.goal, x.most, u), atol=1e-5)
    assert found["a"].steps > 1 and max(np.ptp(np.exp(found[s].mu * np.log([1, 100]))) for s in "ab") > 0.05  # a tilt over documents
    a = np.exp(found["a"].lam + found["a"].mu * (np.log([10, 3, 400]) - length[0]) / length[1])
    assert (a > 1).any()  # a limit of repeats binds


def test_a_named_total_reports_the_gap(spark):
    rows = [(n, "big", "word " * (3 + n % 17)) for n in range(300)] + [(1000, "tiny", "one two three four")]
    t = targets(spark, [("big", 0.5, 2), ("tiny", 0.5, 3)])
    s = {r.source: r for r in X.shares(X.mix(docs(spark, rows), t, 3000.0), t, 3000.0).collect()}
    assert s["tiny"].n_copies == 3 and s["tiny"].gap == 1500 - 3 * s["tiny"].n_tokens
    assert abs(s["big"].gap) < 25 and s["big"].most_copies <= 2 and s["big"].rated_tokens > 1499


def test_equal_documents_are_split_into_groups(spark, monkeypatch):
    monkeypatch.setattr(X, "GROUP", 16)
    rows = [(n, "a", "same text") for n in range(300)] + [(500 + n, "b", "same text") for n in range(30)]
    m = X.mix(docs(spark, rows), targets(spark, [("a", 0.5, 1), ("b", 0.5, 2)])).groupBy("source").sum("copies").collect()
    assert {r[0]: r[1] for r in m} == {"a": 60, "b": 60}


def test_nothing_usable(spark):
    t = targets(spark, [("a", 0.5, 1)])
    assert [r.copies for r in X.mix(docs(spark, [(1, "z", "x")]), t).collect()] == [0]
    assert X.mix(docs(spark, []), t).count() == 0
    assert X.shares(X.mix(docs(spark, []), t), t).collect()[0].share == 0
