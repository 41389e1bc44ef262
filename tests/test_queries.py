"""Every query with SQL against DuckDB on the same tables; the others give rows."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__
from opinara.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def tidy(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return [tidy(v) for v in x] if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_agrees(spark, duck, name):
    df, result = registry.QUERIES[name](spark, SF), duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tidy(tuple(r))) for r in df.select(*(f"`{c}`" for c in columns)).collect()) == sorted(repr(tidy(r)) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_the_others_give_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan_and_few_columns_are_read(spark):
    plan = registry.QUERIES["agg1_product_analytics"](spark, SF)._jdf.queryExecution().toString()
    read = plan[plan.rindex("ReadSchema") :].split("\n")[0]
    assert "props" not in read and "value" in read
