"""Every registered query against its DuckDB oracle on the smallest fixture (sf0.001)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

BASE = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="fixture tables not present")


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    return str(v)


def _rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{BASE}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["example_id", "prompt", "response"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, BASE)
    sql = E.oracle_sql().get(name)
    data = [tuple(r) for r in df.collect()]
    if sql is None:
        return
    rel = con.sql(sql)
    c1, r1 = _rows(df.columns, data)
    c2, r2 = _rows(rel.columns, rel.fetchall())
    assert c1 == c2
    assert r1 == r2


def test_round6_matches_duckdb_on_ties(spark, con):
    from pyspark.sql import functions as F

    from preftable.plans.oracle import round6

    xs = [-0.7237304999999999, 0.1234565, 2.675, -5e-07, 1.0000005, 12.3456785, -0.0, 3.14159265]
    got = [r.v for r in spark.createDataFrame([(x,) for x in xs], "x double").select(round6(F.col("x")).alias("v")).collect()]
    want = [con.sql(f"SELECT round({x!r}::DOUBLE, 6) + 0.0").fetchall()[0][0] for x in xs]
    assert got == want
