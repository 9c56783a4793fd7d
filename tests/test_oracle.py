"""Every registered query against its SQL counterpart, and rules all physical plans keep."""

import datetime as dt
import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Operators that would not scale: pairs of all rows, or row-wise Python.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow")


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is not None, type(v).__name__, v if v is not None else 0) for v in row])


def same(a, b):
    """Equal, or apart by one unit of the last decimal: engines round exact halves differently."""
    if not (isinstance(a, float) and isinstance(b, float)) or a == b:
        return a == b
    unit = Decimal(10) ** min(Decimal(repr(x)).as_tuple().exponent for x in (a, b))
    return abs(Decimal(repr(a)) - Decimal(repr(b))) <= unit


def test_every_sql_counterpart_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.telemetry_queries()))
def test_query(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = ordered([tuple(plain(v) for v in row) for row in df.select(*columns).collect()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [operator for operator in FORBIDDEN if operator in plan]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = ordered([tuple(plain(row[i]) for i in order) for row in result.fetchall()])
    assert len(rows) == len(expected)
    different = [(r, e) for r, e in zip(rows, expected) if not all(map(same, r, e))]
    assert not different


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["day_of_week", "average_steps"]
    assert df.count() == 7
