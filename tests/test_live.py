"""Live bars of several widths, counters in a value state, and tables that batches are merged into."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketloom.streaming import live as lv
from marketloom.streaming import ticks as tk

BEGIN = dt.datetime(2024, 3, 4, 3, 0)
TICK = "event_id long, symbol string, ts timestamp_ntz, price double, volume double, market_hours int"


def arrive(spark, folder, batches, schema=TICK):
    """Each list of rows as one file, older files first."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k:03d}")
        place = path(f"{folder}/{k:03d}")
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(place):
            fs.setTimes(f.getPath(), 1_700_000_000_000 + 1000 * k, -1)
    first = spark.read.parquet(f"{folder}/000").schema
    return spark.readStream.schema(first).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*").withColumn("ts", F.col("ts").cast("timestamp"))


def ticks(n, seed, minutes):
    rng = random.Random(seed)
    rows = [(k, "ab"[k % 2], BEGIN + dt.timedelta(seconds=rng.randrange(60 * minutes)), 10.0 + rng.randrange(100), float(rng.randrange(5)), rng.choice([1, 1, 1, 0, None])) for k in range(n)]
    return sorted(rows, key=lambda r: r[2])


def plain_bars(rows, minutes, offset):
    out = {}
    for e, s, ts, price, volume, hours in sorted(rows, key=lambda r: (r[2], r[0])):
        if hours != 1:
            continue
        past = (ts - dt.datetime(2024, 1, 1)).total_seconds() // 60 - offset
        start = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=past // minutes * minutes + offset)
        bar = out.setdefault((s, minutes, start), [price, price, price, price, 0.0])
        bar[1], bar[2], bar[3], bar[4] = max(bar[1], price), min(bar[2], price), price, bar[4] + volume
    return out


def all_bars(rows):
    return {k: v for width, offset in lv.WIDTHS.items() for k, v in plain_bars(rows, int(width.split()[0]), int(offset.split()[0])).items()}


def as_dict(df):
    cast = F.col("bar_start").cast("timestamp_ntz").alias("at")
    return {(r.symbol, r.minutes, r.at): [r.open, r.high, r.low, r.close, r.volume] for r in df.select("symbol", "minutes", cast, "open", "high", "low", "close", "volume").collect()}


def test_live_bars_equal_the_batch_and_drop_late_rows(spark, tmp_path):
    rows = ticks(900, 1, 300)
    late = [(5000, "a", BEGIN, 999.0, 50.0, 1), (5001, "b", BEGIN + dt.timedelta(minutes=7), 999.0, 50.0, 1)]  # hours behind the watermark
    batches = [rows[:300], rows[300:600], rows[600:700] + late, rows[700:]]
    out = tk.run_available(lv.live_bars(arrive(spark, f"{tmp_path}/in", batches)), f"{tmp_path}/out", f"{tmp_path}/state")
    closed = max(r[2] for r in rows if r[5] == 1) - dt.timedelta(minutes=10)
    want = {k: v for k, v in all_bars(rows).items() if k[2] + dt.timedelta(minutes=k[1]) <= closed}
    got = as_dict(out)
    assert got == want and {k[1] for k in got} == {5, 15, 30, 60}
    starts = {k[2].time() for k in got if k[1] == 60} | {k[2].time() for k in got if k[1] == 30}
    assert dt.time(3, 45) in starts and dt.time(4, 15) in starts  # anchored at 09:15 in Kolkata
    batch = spark.createDataFrame(rows, TICK).withColumn("ts", F.col("ts").cast("timestamp"))
    assert as_dict(lv.live_bars(batch)) == all_bars(rows)
    assert lv.live_bars(batch.limit(0)).collect() == []


COUNTED = "event_id long, symbol string, ts timestamp_ntz, day_volume double"


def test_counters_late_ticks_and_eviction(spark, tmp_path):
    day = dt.datetime(2024, 3, 4)
    at = lambda d, h: day + dt.timedelta(days=d, hours=h)
    batches = [
        [(1, "a", at(0, 4), 100.0), (2, "a", at(0, 5), 130.0), (3, "b", at(0, 5), 7.0), (4, "a", at(0, 6), 120.0)],
        [(5, "a", at(0, 7), 150.0), (6, "a", at(0, 5), 500.0), (7, "b", at(0, 8), None), (8, "b", at(0, 9), 10.0)],  # 6 is older than what batch 1 saw
        [(9, "a", at(1, 1), 5.0), (10, "a", at(1, 2), 9.0)],
        [(11, "a", at(6, 1), 1.0), (12, "b", at(6, 2), 2.0)],
        [(14, "a", at(6, 3), 4.0)],
        [(13, "a", at(0, 10), 9000.0)],  # behind the watermark, and its day's state is gone
    ]
    stream = arrive(spark, f"{tmp_path}/in", batches, COUNTED)
    writer = tk.volume_deltas(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.event_id: r.delta for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: 0, 2: 30, 3: 0, 4: 0, 5: 30, 6: 0, 7: 0, 8: 0, 9: 0, 10: 4, 11: 0, 12: 0, 14: 3}
    state = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "counter").load()
    left = {(r.key.symbol, r.key.day): r.value.last for r in state.select("key", "value").collect()}
    assert left == {("a", dt.date(2024, 3, 10)): 4.0, ("b", dt.date(2024, 3, 10)): 2.0}  # the days before are gone


def test_replaying_a_batch_changes_nothing(spark, tmp_path):
    table = lv.UpsertTable(spark, f"{tmp_path}/t", ["k"], "k long, v string")
    rows = lambda *r: spark.createDataFrame(r, "k long, v string")
    read = lambda: {r.k: r.v for r in table.read().collect()}
    table.merge(rows((1, "a"), (2, "b"), (None, "n")), 0)
    table.merge(rows((2, "c"), (3, None)), 1)
    want = {1: "a", 2: "c", 3: None, None: "n"}
    assert read() == want
    table.merge(rows((1, "a"), (2, "b"), (None, "n")), 0)  # an old batch again
    table.merge(rows((2, "c"), (3, None)), 1)
    assert read() == want
    table.compact(1)
    assert read() == want
    table.merge(rows((1, "z")), 2)
    assert read() == want | {1: "z"}
    table.compact(2)
    assert read() == want | {1: "z"} and sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("batch")) == ["batch=2"]


def test_quotes_and_marks_survive_a_restart(spark, tmp_path):
    rows = ticks(400, 3, 200)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)  # out of order, but within the delay given below
    stream = arrive(spark, f"{tmp_path}/in", [shuffled[k : k + 100] for k in range(0, 400, 100)])
    quotes = lv.UpsertTable(spark, f"{tmp_path}/q", ["symbol"], "symbol string, ts timestamp, price double")
    for _ in range(2):  # the second run finds nothing new
        got = {r.symbol: r.price for r in lv.upsert_available(lv.latest(stream), quotes, f"{tmp_path}/qs").collect()}
        assert got == {s: max((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0]))[3] for s in "ab"}
    marks = lv.UpsertTable(spark, f"{tmp_path}/m", ["symbol", "bucket"], "symbol string, bucket timestamp, ts timestamp, price double")
    out = lv.upsert_available(lv.bucket_marks(stream, ["symbol"], "price", delay="1 day"), marks, f"{tmp_path}/ms")
    first = {}
    for e, s, ts, price, _, hours in sorted(rows, key=lambda r: (r[2], r[0])):
        if hours == 1:
            first.setdefault((s, ts.replace(minute=ts.minute // 15 * 15, second=0)), price)
    assert {(r.symbol, r.b): r.price for r in out.select("symbol", F.col("bucket").cast("timestamp_ntz").alias("b"), "price").collect()} == first


@pytest.mark.parametrize("parts", [1, 4])
def test_replay_keeps_the_order(spark, tmp_path, parts):
    df = spark.range(1000).selectExpr("id", "timestamp_seconds(1700000000 + (id * 7919) % 1000) AS ts")
    seen = []

    def note(batch, _):
        r = batch.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
        seen.append(tuple(r))

    query = tk.replay(df, f"{tmp_path}/in", parts).writeStream.foreachBatch(note).option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(seen) == parts and sum(n for _, _, n in seen) == 1000
    assert all(a[1] <= b[0] for a, b in zip(seen, seen[1:]))
