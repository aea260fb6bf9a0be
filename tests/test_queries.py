"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__  # noqa: F401  (registers all queries with the catalog)
from pulsespark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(values):
    def cell(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        return repr(float(v)) if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect())
    want = rows(con.sql(f"select {', '.join(columns)} from ({catalog.ORACLE_SQL[name]})").fetchall())
    assert got and got == want


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count()
