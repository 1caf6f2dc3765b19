import re

from pyspark.sql import functions as F

from loomspan.operators import profile as P

GOOD = "/r/sub-A1/ses-2/func/sub-A1_ses-2_task-rest_run-1_feature-f_atlas-T1_timeseries.tsv"
BAD = [
    GOOD.replace("/sub-A1/", "/sub-A2/"), GOOD.replace("_ses-2", "_ses-3"), GOOD.replace("_ses-2", ""), GOOD.replace("/ses-2", ""), GOOD + ".1", GOOD.replace("/", "\\"), GOOD.replace("func", "anat"), GOOD.replace("_run-1", ""),
    GOOD.replace("feature-f", "feature-f+"), "", "x", GOOD + "\n", GOOD.replace("_timeseries", "-timeseries"), GOOD.replace("run-1", "run-"), "sub-A1" + GOOD[9:],
]


def test_path_masks_settle_the_form(spark):
    ok = [GOOD, GOOD + ".gz", GOOD.replace("/ses-2", "").replace("_ses-2", ""), "a b/" + GOOD[1:], "/sub-zz/x" + GOOD]
    df = spark.createDataFrame([(p, True) for p in ok] + [(p, False) for p in BAD] + [(None, None)], "p string, ok boolean")
    for r in df.select("p", "ok", F.col("p").rlike(P.PATH_FORM).alias("form"), P.path_mask(F.col("p")).rlike(P.PATH_MASK_FORM).alias("mask")).collect():
        if r.ok:
            assert r.form and r.mask, r.p
        elif r.ok is False:
            assert not r.mask, r.p
        else:
            assert r.form is None and r["mask"] is None


def test_number_masks(spark):
    df = spark.createDataFrame([(v,) for v in (2.0, 0.72, 0.8, -3.0, 0.0, 9999.0, 1e-5, float("nan"), float("inf"), None)], "v double")
    assert [r[0] for r in df.select(P.number_mask(F.col("v"))).collect()] == ["+2e0", "+7e-1", "+8e-1", "-3e0", "0", "+9e3", "+1e-5", "NaN", "+inf", None]


def cells(spark, rows):
    return spark.createDataFrame(rows, "tbl string, col string, load_id int, mask string")


def test_loads_with_many_nulls_and_shifts(spark):
    rows = []
    for load in range(1, 7):
        rows += [("t", "c", load, "a" if k % 3 else "b") for k in range(60)]
        rows += [("t", "c", load, None)] * (40 if load == 4 else 2)
    rows += [("t", "c", 9, "z")] * 50
    c = P.mask_counts(cells(spark, rows))
    assert [r.load_id for r in P.null_loads(c).collect()] == [4]
    assert [r.load_id for r in P.shifted_loads(c).collect()] == [9]


def test_one_load_and_none(spark):
    one = P.mask_counts(cells(spark, [("t", "c", 1, None)] * 5 + [("t", "c", 1, "a")]))
    assert P.null_loads(one).count() == 0 and P.shifted_loads(one).count() == 0
    none = P.mask_counts(cells(spark, []))
    assert P.null_loads(none).count() == 0 and P.shifted_loads(none).count() == 0 and P.rare_masks(none).count() == 0


def test_profile_of_any_columns(spark):
    df = spark.createDataFrame([(1, "a1", 2.0, None), (1, "", float("nan"), None), (2, None, -1.0, None)], "load_id int, n_rows string, mask double, c int")
    got = {(r.col, r.load_id): r for r in P.column_profile(df, "t").collect()}
    assert got["n_rows", 1].n_rows == 2 and got["n_rows", 2].n_nulls == 1 and got["mask", 2].least == -1.0 and got["c", 1].n_nulls == 2
    assert P.column_profile(df.where("false"), "t").count() == 0


def test_values_against_brute_force(spark, tiny):
    got = {(r.tbl, r.col, r.rec_id) for r in P.p3_found(spark, tiny).where("issue = 'value'").collect()}
    form = re.compile(r".*/sub-([A-Za-z0-9]+)/(?:ses-([A-Za-z0-9]+)/)?func/sub-\1(?:_ses-([A-Za-z0-9]+))?_task-[A-Za-z0-9]+_run-[A-Za-z0-9]+_feature-[A-Za-z0-9]+_atlas-[A-Za-z0-9]+_timeseries\.tsv(\.gz)?", re.S)
    want = set()
    for r in spark.read.parquet(f"{tiny}/timeseries_files.parquet").collect():
        m = form.fullmatch(r.path) if r.path is not None else None
        if r.path is not None and (not m or m[2] != m[3]):
            want.add(("timeseries_files", "path", r.file_id))
        if r.tr is not None and not 0.2 <= r.tr <= 10:
            want.add(("timeseries_files", "tr", r.file_id))
    for r in spark.read.parquet(f"{tiny}/node_sets.parquet").collect():
        if r.coverage is not None and not 0 <= r.coverage <= 1:
            want.add(("node_sets", "coverage", r.node_id))
    assert got == want


def test_every_column_by_load(spark, tiny):
    rows = [(k, load, None if load == 3 and k % 2 else f"s{k}.json", "01" if load != 4 else "ses-01", 1.5, k % 7) for load in range(1, 7) for k in range(load * 1000, load * 1000 + 200)]
    rows += [(99, 2, "s9.json", "01", float("nan"), 1)]
    df = spark.createDataFrame([(*r, w) for r in rows for w in (1, 2)], "rec long, load_id int, sidecar string, ses string, tr double, kept int, came int")
    cells = P.all_cells(df, "t", "came")
    got = {(r.col, r.issue, r.load_id, r.mask, r.n) for r in P.load_report(cells).collect()}
    assert got == {("sidecar", "nulls", 3, None, 200), ("ses", "shift", 4, None, 200), ("tr", "rare", 2, "NaN", 1)}
    for t in ("timeseries_files", "node_sets"):
        columns = set(spark.read.parquet(f"{tiny}/{t}.parquet").columns) - {"load_id"}
        assert {r.col for r in P.p3_masks(spark, tiny).where(F.col("tbl") == t).select("col").distinct().collect()} == columns
    assert P.load_report(cells.where("false")).count() == 0
