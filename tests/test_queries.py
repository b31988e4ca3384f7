"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math

import pytest

import __spark_entry__
from corpusforge.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(df):
    import pandas as pd

    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return ""
        if hasattr(v, "tolist"):
            v = v.tolist()
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(one(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = canonical(registry.QUERIES[name](spark, sf).toPandas())
    want = canonical(duck.sql(registry.ORACLE_SQL[name]).df())
    assert got == want


def test_every_query_has_sql_but_the_approximate_one():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"extras_approx_users"}


def test_approximate_users_are_near_the_exact_ones(spark, sf, duck):
    exact = dict(duck.sql("SELECT event_type, count(DISTINCT user_id) FROM events GROUP BY 1").fetchall())
    got = {r.event_type: r.users for r in registry.QUERIES["extras_approx_users"](spark, sf).collect()}
    assert got.keys() == exact.keys() and all(abs(got[k] - n) <= max(1, 0.04 * n) for k, n in exact.items())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
