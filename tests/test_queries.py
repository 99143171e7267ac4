"""Every query that has SQL gives the rows of the SQL in DuckDB; the others run. On the smallest tables."""

import datetime as dt
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from trussflow.plans import catalog, problems, rewrites

CORE = catalog.QUERIES | rewrites.QUERIES | problems.QUERIES
CORE_SQL = catalog.SQL | rewrites.SQL | problems.SQL


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE_SQL))
def test_same_rows_as_sql(spark, data, duck, name):
    df = CORE[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    rel = duck.sql(CORE_SQL[name])
    assert sorted(rel.columns) == cols
    assert got == sorted((tuple(norm(x) for x in r) for r in rel.select(", ".join(f'"{c}"' for c in cols)).fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(CORE) - set(CORE_SQL)))
def test_runs(spark, data, name):
    assert CORE[name](spark, data).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name, times", [("working_days", 1), ("sink_sql_expand", 6)])
def test_whole_table(spark, data, duck, name, times):
    assert CORE[name](spark, data).count() == times * duck.sql("SELECT count(*) FROM orders").fetchall()[0][0]


def test_working_days_brute_force(spark, data):
    orders = {r.o_orderkey: r.day for r in spark.read.parquet(f"{data}/orders.parquet").selectExpr("o_orderkey", "to_date(o_orderdate) AS day").collect()}
    want = {k: sum((day + dt.timedelta(i)).isoweekday() <= 5 for i in range(k % 40 + 1)) for k, day in orders.items()}
    assert {r.id: r.days for r in CORE["working_days"](spark, data).collect()} == want
