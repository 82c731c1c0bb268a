"""Every query of the library against its SQL in DuckDB, or for shape where there is none."""

import math
import os

import duckdb
import pytest

from veriscope import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool) or not hasattr(v, "__float__"):
        return str(v)
    return repr(float(v) + 0.0)


def _rows(rows, names):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_cell(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    rows = df.collect()
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = duck.sql(sql)
    assert sorted(df.columns) == sorted(got.columns)
    assert _rows(rows, df.columns) == _rows(got.fetchall(), got.columns)


def test_oracles_belong_to_queries():
    assert set(plans.oracle_sql()) <= set(plans.queries())
