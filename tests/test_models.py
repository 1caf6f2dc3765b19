from pyspark.sql import functions as F

from loomspan.operators import models as N


def embeddings(spark, sizes, path, width=64):
    """A table of one row per id; sizes: rows of each label, or its ids."""
    rows = [(i, label) for label, ids in sizes.items() for i in (range(ids) if isinstance(ids, int) else ids)]
    e = spark.createDataFrame(rows, "vec_id long, label int")
    e.withColumn("embedding", F.transform(F.sequence(F.lit(1), F.lit(width)), lambda j: (F.xxhash64("vec_id", j) / 2.0**63).cast("float"))).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_all_columns_are_nodes(spark, tmp_path):
    d = embeddings(spark, {1: 60}, tmp_path)
    assert len(N.runs(spark, d).first().x) == 64
    r = N.mk_empirical(spark, d).first()
    assert len(r.fc) == 64 * 64 and len(r.f_peak) == 64
    assert N.mk_ndte(spark, d).count() == 64 * 64 and N.mk_fwd(spark, d).count() == 2 * 64 * 64


def test_no_volume_is_lost(spark, tmp_path):
    rare = [k * 8192 + 5 for k in range(45)]
    d = embeddings(spark, {1: 519, 2: 7, 3: rare, 4: range(8000, 9400)}, tmp_path, 3)
    got = {(r.participant, r.run): (r.n, r.top) for r in N.runs(spark, d).groupBy("participant", "run").agg(F.count("*").alias("n"), F.max("t").alias("top")).collect()}
    assert got == {(1, 0): (519, 518), (2, 0): (7, 6), (3, 0): (45, 44), (4, 0): (512, 511), (4, 1): (512, 511), (4, 2): (376, 375)}
    order = [r.t for r in N.runs(spark, d).where("participant = 3").orderBy(F.col("t")).collect()]
    assert order == list(range(45))


def test_short_run_is_a_row_with_an_error(spark, tmp_path):
    d = embeddings(spark, {1: 60, 2: 7}, tmp_path, 3)
    for f in (N.mk_empirical, N.mk_ndte, N.mk_fit_gec, N.ag_noise_floor, N.mk_surrogates):
        rows = f(spark, d).collect()
        assert [r.error for r in rows if r.participant == 2] == ["too few volumes: 7"], f
        assert any(r.participant == 1 and r.error is None for r in rows)
