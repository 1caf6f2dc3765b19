"""Every query runs over the smallest tables; those with SQL give what DuckDB gives."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

NAMES = sorted(k for m in entry.MODULES for k in __import__(m, fromlist=["x"]).QUERIES)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def duck(tiny):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tiny, duck, name):
    df = entry.queries()[name](spark, tiny)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(df.columns) == len(set(df.columns))
        return
    cur = duck.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted(str([plain(r[c]) for c in order]) for r in rows)
    want = sorted(str([plain(r[columns.index(c)]) for c in order]) for r in cur.fetchall())
    assert got == want


def test_entry(spark, tiny):
    assert entry.entry(spark).count() > 0


def test_there_is_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
