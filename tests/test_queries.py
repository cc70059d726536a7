"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import marketloom.queries  # noqa: F401
from marketloom.registry import QUERIES, SQL

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}") + 0.0  # no negative zero
    return value if value is None or isinstance(value, (int, bool)) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        return
    relation = duck.sql(SQL[name])
    names = sorted(relation.columns)
    assert sorted(df.columns) == names
    here, there = [df.columns.index(n) for n in names], [relation.columns.index(n) for n in names]
    left = sorted((tuple(plain(r[i]) for i in here) for r in rows), key=repr)
    right = sorted((tuple(plain(r[i]) for i in there) for r in relation.fetchall()), key=repr)
    assert left == right


def test_every_query_has_sql_or_is_known():
    assert {n for n in QUERIES if n not in SQL} <= {"garch_forecast", "fpca_forecast", "yeo_johnson_walk", "surface_forecast", "arima_garch_forecast"}
