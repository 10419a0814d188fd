"""Every query of the plans against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from marlstone import plans

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if hasattr(v, "asDict"):
        return str(v.asDict())
    return repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    wanted = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    order = sorted(df.columns)
    at = [wanted.columns.index(c) for c in order]
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0
