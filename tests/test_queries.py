"""Every registered query of the engine against its DuckDB counterpart on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from tidemark import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return bool(x)
    return round(float(x), 9) if isinstance(x, int | float) or hasattr(x, "__float__") and not isinstance(x, str) else str(x)


def rows(df):
    return sorted(repr(tuple(plain(x) for x in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(plans.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_runs(spark, name):
    out = plans.QUERIES[name](spark, FOLDER)
    assert out.columns and out.count() >= 0


def test_columns_reach_the_scan(spark):
    plan = plans.QUERIES["z20_population"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_shipdate:timestamp_ntz>" in plan
    plan = plans.QUERIES["range_reader"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "EqualTo(c_mktsegment,BUILDING)" in plan
