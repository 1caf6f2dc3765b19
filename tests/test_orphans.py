from datetime import datetime as D

from loomspan.operators import orphans as O

REFS = "tbl string, rec_id long, field string, ns string, key string, ts timestamp_ntz, rng string, pos int, month string"
PARENTS = "ns string, key string, start timestamp_ntz, stop timestamp_ntz"


def refs(spark, rows):
    # columns whose names the operator uses itself must not disturb it
    return spark.createDataFrame([(*r, "x", 7, "m") for r in rows], REFS)


def brute(rs, ps):
    return {
        (t, i, f) for t, i, f, ns, k, ts in rs
        if k is not None and not any(n == ns and q == k and a is not None and ts is not None and a <= ts and (b is None or b > ts) for n, q, a, b in ps)
    }


def found(df):
    return {(r.tbl, r.rec_id, r.field) for r in df.collect()}


def test_intervals_and_ties(spark):
    ps = [("s", "a", D(2020, 1, 15), D(2020, 6, 1)), ("s", "a", D(2021, 1, 1), None), ("s", "b", D(2020, 2, 1), D(2020, 2, 20)), ("s", "c", None, None), ("g", "a", D(2000, 1, 1), None), ("s", None, D(2000, 1, 1), None)]
    times = [D(2020, 1, 14), D(2020, 1, 15), D(2020, 3, 3), D(2020, 5, 31, 23), D(2020, 6, 1), D(2020, 12, 31), D(2021, 1, 1), D(2030, 7, 7), None]
    rs = [("t", n, "f", "s", k, ts) for n, (k, ts) in enumerate((k, ts) for k in ("a", "b", "c", "zz", "", None) for ts in times)]
    out = O.orphan_references(refs(spark, rs + rs), spark.createDataFrame(ps + ps, PARENTS))
    got = [(r.tbl, r.rec_id, r.field) for r in out.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rs, ps)


def test_no_parents_and_no_references(spark):
    rs = [("t", 1, "f", "s", "a", D(2020, 1, 1)), ("t", 2, "f", "s", None, D(2020, 1, 1))]
    assert found(O.orphan_references(refs(spark, rs), spark.createDataFrame([], PARENTS))) == {("t", 1, "f")}
    assert O.orphan_references(refs(spark, []), spark.createDataFrame([("s", "a", D(2020, 1, 1), None)], PARENTS)).count() == 0


def test_one_key_holds_most_rows(spark):
    rs = [("t", n, "f", "s", "hot" if n % 3 else f"k{n}", D(2020, 1 + n % 12, 5)) for n in range(600)]
    ps = [("s", "hot", D(2020, 4, 2), D(2020, 9, 9))] + [("s", f"k{n}", D(2019, 1, 1), None) for n in range(0, 600, 6)]
    assert found(O.orphan_references(refs(spark, rs), spark.createDataFrame(ps, PARENTS))) == brute(rs, ps)


def test_keys(spark):
    df = spark.createDataFrame([(" sub-1\t",), ("1",), ("SUB-1",), (None,)], "s string")
    assert [r[0] for r in df.select(O.subject_key(df.s)).collect()] == ["sub-1", "sub-1", "sub-SUB-1", None]
    df = spark.createDataFrame([(" a ",), ("N/A",), ("",), ("NaN ",), ("none",), (None,)], "s string")
    assert [r[0] for r in df.select(O.group_key(df.s)).collect()] == ["a", None, None, None, None, None]


def test_bitmaps_hold_more_than_one_range(spark, monkeypatch):
    monkeypatch.setattr(O, "BITS", 8)
    monkeypatch.setattr(O, "RANGE_KEYS", 1000)
    keys = spark.createDataFrame([("s", f"k{n}") for n in range(50)], "ns string, key string")
    codes = O.dictionary(keys).collect()
    assert len({(r.rng, r.pos) for r in codes}) == 50 and max(r.pos for r in codes) < 8


def test_containers():
    import numpy as np

    for n in (0, 1, 1000, 1024, 1025, 30000):
        bits = np.zeros(O.BITS, np.uint8)
        bits[np.random.default_rng(n).choice(O.BITS, n, replace=False)] = 1
        raw = np.packbits(bits, bitorder="little").tobytes()
        assert O._unpack(O._pack(raw)).tobytes() == raw
    assert O._pack(None) is None
