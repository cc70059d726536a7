"""Replays of many files that are not in order of time."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest

import marketloom.queries  # noqa: F401
from marketloom.registry import QUERIES

FILES = 20
BEGIN = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Events of 30 days, dealt at random over 20 files; late days lie in the oldest files."""
    d = str(tmp_path_factory.mktemp("replay"))
    rng = random.Random(5)
    rows = [(k, k % 7, "ab"[k % 2], BEGIN + dt.timedelta(minutes=rng.randrange(30 * 1440)), 1.0 + k % 50, '{"k": 2}') for k in range(1500)]
    rows += [(1500 + k, *rows[k][1:]) for k in range(0, 300, 3)]  # marks that come twice
    parts = [[] for _ in range(FILES)]
    for r in rows:
        parts[min(FILES - 1, max(0, FILES - 1 - (r[3] - BEGIN).days * FILES // 30 + rng.randrange(-3, 4)))].append(r)
    os.makedirs(f"{d}/events.parquet")
    for n, part in enumerate(parts):
        made = spark.createDataFrame(part, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double, props string").coalesce(1)
        made.write.parquet(f"{d}/part-{n}")
        (name,) = [x for x in os.listdir(f"{d}/part-{n}") if x.endswith(".parquet")]
        os.rename(f"{d}/part-{n}/{name}", f"{d}/events.parquet/{n:02d}.parquet")
        os.utime(f"{d}/events.parquet/{n:02d}.parquet", (1_700_000_000 + 100 * n,) * 2)
    return d, rows


def test_every_mark_comes_once(spark, events):
    d, rows = events
    got = {(r.user_id, r.ts): r.n for r in QUERIES["stream_marks_once"](spark, d).collect()}
    assert got == {(r[1], r[3]): 1 for r in rows}


def test_closed_bars_equal_the_batch(spark, events):
    d, rows = events
    closed = max(r[3] for r in rows) - dt.timedelta(days=2)
    batch = {tuple(r) for r in QUERIES["bars_batch_twin"](spark, d).collect() if r.bar_start + dt.timedelta(hours=1) <= closed}
    assert {tuple(r) for r in QUERIES["stream_hour_bars"](spark, d).collect()} == batch


def test_deltas_follow_source_time(spark, events):
    d, rows = events
    want, last = {}, {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        key, volume = (r[2], r[3].date()), float(r[0] * 7 % 1000)
        want[r[0]] = max(volume - last.get(key, volume), 0.0)
        last[key] = volume
    assert {r.event_id: r.delta for r in QUERIES["stream_volume_delta"](spark, d).collect()} == want


def test_state_of_past_days_goes(spark, tmp_path):
    from marketloom.streaming import ticks as tk

    rows = [(k, k % 3, BEGIN + dt.timedelta(hours=2 * k), float(k)) for k in range(240)]  # 20 days in order
    for n in range(10):
        part = spark.createDataFrame(rows[24 * n : 24 * n + 24], "event_id long, symbol long, ts timestamp_ntz, day_volume double").coalesce(1)
        part.write.parquet(f"{tmp_path}/in/{n}")
        for x in os.listdir(f"{tmp_path}/in/{n}"):
            os.utime(f"{tmp_path}/in/{n}/{x}", (1_700_000_000 + 100 * n,) * 2)
    stream = tk.tick_stream(spark, f"{tmp_path}/in/*", spark.read.parquet(f"{tmp_path}/in/0").schema, files_per_trigger=1)
    writer = tk.volume_deltas(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    want, last = {}, {}
    for event, symbol, ts, volume in rows:
        want[event] = max(volume - last.get((symbol, ts.date()), volume), 0.0)
        last[symbol, ts.date()] = volume
    assert {r.event_id: r.delta for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
    kept = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    assert kept <= 3 * 4 < len(last)  # the watermark's two days, the open day and one to spare
