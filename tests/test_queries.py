"""Every registered query against its SQL in DuckDB, on the smallest fixture."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest
from conftest import TESTDATA

from quillspark.plans import ORACLES, QUERIES

SF = TESTDATA / "sf0.001"


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for file in sorted(SF.glob("*.parquet")):
        found.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return found


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (bool, str)):
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return float(f"{float(x):.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x.isoformat() if isinstance(x, datetime.date) else tuple(map(plain, x)) if isinstance(x, (list, tuple)) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    got, want = QUERIES[name](spark, str(SF)), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(map(plain, r)) for r in got.select(*want.columns).collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(map(plain, r))) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, str(SF)).count() > 0


def test_driver_contract(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
