"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from millrace.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return "[" + ",".join(map(norm, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    r = duck.sql(ORACLES[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert sorted(tuple(norm(x[c]) for c in columns) for x in df.collect()) == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())


def test_lines_of_orders_are_dealt_out_before_they_are_sorted(spark):
    plan = QUERIES["node_merge"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION_BY_COL" in plan.split("partial_max_by", 1)[1].split("FileScan")[0]
