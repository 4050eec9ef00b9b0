"""Every registered query of the engine against its DuckDB twin on the smallest tables."""

import os

import duckdb
import pytest

from strictframe import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in (*Q.TABLES, "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    mine = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    oracle = Q.oracle_sql().get(name)
    if oracle is None:
        assert mine
        return
    r = duck.sql(oracle)
    at = [r.columns.index(c) for c in sorted(r.columns)]
    assert sorted(df.columns) == sorted(r.columns)
    assert mine == sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())


def test_filters_reach_the_files(spark):
    df = Q.run("sql12_filter_eq", spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linenumber), EqualTo(l_linenumber,1)]" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_linenumber:int>" in plan
