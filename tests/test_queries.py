"""Every registered query with SQL against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from barloom.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return value if isinstance(value, str | bool) else round(float(value), 5)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, engine, name):
    found = registry.QUERIES[name](spark, DATA)
    names = sorted(found.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in found.select(*names).collect()), key=str)
    asked = engine.sql(registry.ORACLES[name])
    assert sorted(asked.columns) == names
    theirs = sorted((tuple(plain(v) for v in r) for r in asked.project(", ".join(f'"{n}"' for n in names)).fetchall()), key=str)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == b or all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).columns
    if not name.startswith("signal_psar"):
        registry.QUERIES[name](spark, DATA).count()


@pytest.mark.parametrize("name", ["trade_fifo_pnl", "trade_measures"])
def test_odd_line_items_equal_sql(spark, tmp_path, name):
    """Dates and order keys that are null, negative suppliers, lots of nothing; no two at one place of the order."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * EXCLUDE n REPLACE (CASE WHEN n % 31 = 0 THEN NULL ELSE l_shipdate END AS l_shipdate, CASE WHEN n % 37 = 0 THEN NULL ELSE n END AS l_orderkey, n::INTEGER AS l_linenumber,
  CASE WHEN n % 5 = 0 THEN -l_suppkey ELSE l_suppkey END AS l_suppkey, CASE WHEN n % 41 = 0 THEN 0 ELSE l_quantity END AS l_quantity, CASE WHEN n % 43 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag)
  FROM (SELECT *, row_number() OVER () AS n FROM '{DATA}/lineitem.parquet')) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    asked = con.sql(registry.ORACLES[name])
    mine = sorted((tuple(plain(v) for v in r) for r in registry.QUERIES[name](spark, str(tmp_path)).select(*asked.columns).collect()), key=str)
    assert mine == sorted((tuple(plain(v) for v in r) for r in asked.fetchall()), key=str)
