"""Queries against their own SQL on small tables that tell the two apart."""

from __future__ import annotations

import datetime as dt
import random

import duckdb
import pytest

import marketloom.queries  # noqa: F401
from marketloom.registry import QUERIES, SQL


def both(spark, folder, name, **tables):
    """Sorted rows of the query and of its SQL, columns by name."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    names = sorted(got.columns)
    want = con.sql(SQL[name]).select(*names).fetchall()
    return sorted((tuple(r) for r in got.select(*names).collect()), key=repr), sorted(want, key=repr)


EVENT = "event_id long, user_id long, ts timestamp_ntz"


@pytest.mark.parametrize("name", ["sliding_rate", "thin_marks_45h"])
def test_seconds_are_rounded_as_in_sql(spark, tmp_path, name):
    start, rng = dt.datetime(2024, 1, 1), random.Random(1)
    gap = {"sliding_rate": 86400, "thin_marks_45h": 162000}[name]
    # a user each for the two ways that rounding and cutting differ, then many users at random
    rows = [(0, 1, start + dt.timedelta(seconds=0.4)), (1, 1, start + dt.timedelta(seconds=gap - 0.4)), (2, 2, start + dt.timedelta(seconds=0.7)), (3, 2, start + dt.timedelta(seconds=gap + 1.2))]
    rows += [(k, 3 + k % 5, start + dt.timedelta(seconds=gap * rng.randrange(4) + rng.randrange(-2, 3) / 2 + 2)) for k in range(4, 100)]
    got, want = both(spark, tmp_path, name, events=(rows, EVENT))
    assert got == want


def test_titles_of_letters_beyond_ascii(spark, tmp_path):
    titles = ["больше новостей из города", "больше новостей из гораде", "больше новостей из городе", "ΑΓΟΡΑ ΤΩΝ ΜΕΤΟΧΩΝ ΣΗΜΕΡΑΣ", "αγορα των μετοχων σημερασ", "αγορα των μετοχων σημερασα"]
    titles += ["größere märkte im mai heute", "grössere märkte im mai heute", "İSTANBUL BORSASI YUKSELDI", "istanbul borsasi yukseldi", "日本市場の今日の動き", "日本市場の今日の動く"]
    rows = [(k, f"<title>{t}</title>") for k, t in enumerate(titles)]
    got, want = both(spark, tmp_path, "title_near_copies", pages=(rows, "page_id long, html string"))
    assert got == want


def test_positions_beyond_the_wanted_ones_are_left_out(spark, tmp_path):
    suppliers = ([(k, f"S{k}", 0, 1.0) for k in range(1005)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    nation, region = ([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"), ([(0, "R")], "r_regionkey int, r_name string")
    got, want = both(spark, tmp_path, "position_rejoin", supplier=suppliers, nation=nation, region=region)
    assert got == want == [(0, 0), (2, 2)]
