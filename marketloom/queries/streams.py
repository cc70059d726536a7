"""Streaming operators run over the events as they stand, against their batch twins in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.shared import new_folder
from ..sources.tables import nearest_second, table
from ..streaming import live as lv
from ..streaming import ticks as tk


def _ticks(df: DataFrame) -> DataFrame:
    volume = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    return df.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), volume.alias("volume"), "event_id", "user_id")


def stream(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return tk.valid_ticks(_ticks(tk.tick_stream(spark, f"{d}/events.parquet*", events.schema, files_per_trigger=None)))


TICKS_SQL = "t AS (SELECT event_type AS symbol, ts, value AS price, coalesce((props->>'$.k')::DOUBLE, 0.0) AS volume, event_id FROM events WHERE value > 0)"
BARS_SQL = f"""{TICKS_SQL}, b AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts - INTERVAL 45 MINUTE) + INTERVAL 45 MINUTE AS bar_start, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low,
 arg_max(price, (ts, event_id)) AS close, sum(volume) AS volume FROM t GROUP BY 1, 2)"""


@query("stream_hour_bars", f"WITH {BARS_SQL} SELECT symbol, bar_start, open, high, low, close, volume FROM b WHERE bar_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 DAY FROM t)")
def hour_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars of closed windows: those that the watermark has passed."""
    work = new_folder(spark, "stream")
    out = tk.run_available(tk.bars(stream(spark, d)), f"{work}/out", f"{work}/state")
    return out.drop("bar_end").withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))


@query("bars_batch_twin", f"WITH {BARS_SQL} SELECT symbol, bar_start, open, high, low, close, volume FROM b")
def batch_bars(spark: SparkSession, d: str) -> DataFrame:
    batch = tk.valid_ticks(_ticks(table(spark, d, "events")))
    return tk.bars(batch).drop("bar_end").withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))


@query("latest_quote", f"WITH {TICKS_SQL} SELECT symbol, max(ts) AS ts, arg_max(price, (ts, event_id)) AS price FROM t GROUP BY 1")
def latest_quote(spark: SparkSession, d: str) -> DataFrame:
    return tk.latest_quotes(tk.valid_ticks(_ticks(table(spark, d, "events")))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_marks_once", "SELECT user_id, ts, count(*) AS n FROM (SELECT DISTINCT user_id, ts FROM events WHERE value > 0) GROUP BY 1, 2")
def stream_marks(spark: SparkSession, d: str) -> DataFrame:
    work = new_folder(spark, "stream")
    once = tk.marks_once(stream(spark, d), ["user_id", "ts"]).select("user_id", "ts")
    out = tk.run_available(once, f"{work}/out", f"{work}/state")
    return out.groupBy("user_id", F.col("ts").cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).alias("n"))


#: Micro-batches of the replays below.
BATCHES = 3


def replayed(spark: SparkSession, d: str, work: str) -> DataFrame:
    """The events in order of time as a stream of several batches, with a flag for the market's hours (03:45 to 10:00 UTC)."""
    stream = tk.replay(table(spark, d, "events"), f"{work}/in", BATCHES)
    ticks = tk.valid_ticks(_ticks(stream))
    minute = F.hour("ts") * 60 + F.minute("ts")
    return ticks.withColumn("market_hours", F.when((minute >= 225) & (minute < 600), 1).otherwise(0))


@query("stream_volume_delta", """WITH c AS (SELECT event_type AS symbol, ts, event_id, event_id * 7 % 1000 + 0.0::DOUBLE AS day_volume FROM events WHERE value > 0)
SELECT event_id, greatest(coalesce(day_volume - lag(day_volume) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts, event_id), 0), 0) AS delta FROM c""")
def stream_delta(spark: SparkSession, d: str) -> DataFrame:
    """Counters carried from batch to batch in a value state."""
    work = new_folder(spark, "stream")
    counted = replayed(spark, d, work).withColumn("day_volume", (F.col("event_id") * 7 % 1000).cast("double"))
    return tk.run_available(tk.volume_deltas(counted), f"{work}/out", f"{work}/state")


MARKET_SQL = "t AS (SELECT event_type AS symbol, user_id, ts, value AS price, coalesce((props->>'$.k')::DOUBLE, 0.0) AS volume, event_id FROM events WHERE value > 0), m AS (SELECT * FROM t WHERE hour(ts) * 60 + minute(ts) BETWEEN 225 AND 599)"
LIVE_SQL = " UNION ALL ".join(
    f"SELECT symbol, {width.split()[0]} AS minutes, time_bucket(INTERVAL {width}, ts, INTERVAL {offset}) AS bar_start, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, sum(volume) AS volume FROM m GROUP BY ALL"
    for width, offset in lv.WIDTHS.items()
)


@query("stream_live_bars", f"WITH {MARKET_SQL}, b AS ({LIVE_SQL}) SELECT * FROM b WHERE bar_start + minutes * INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL {lv.DELAY} FROM m)")
def live_bars(spark: SparkSession, d: str) -> DataFrame:
    """Minute bars of market hours and, chained to them, bars of 5, 15, 30 and 60 minutes: those that the watermark has closed."""
    work = new_folder(spark, "stream")
    out = tk.run_available(lv.live_bars(replayed(spark, d, work)), f"{work}/out", f"{work}/state")
    return out.drop("bar_end").withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))


@query("stream_latest_quotes", f"WITH {MARKET_SQL} SELECT user_id AS symbol, max(ts) AS ts, arg_max(price, (ts, event_id)) AS price FROM t GROUP BY 1")
def stream_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last price, changed rows merged batch by batch into a table."""
    work = new_folder(spark, "stream")
    quotes = lv.latest(replayed(spark, d, work).withColumn("symbol", F.col("user_id")))
    target = lv.UpsertTable(spark, f"{work}/quotes", ["symbol"], "symbol long, ts timestamp, price double")
    return lv.upsert_available(quotes, target, f"{work}/state").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_bucket_marks", f"WITH {MARKET_SQL} SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, min(ts) AS ts, arg_min(price, (ts, event_id)) AS price FROM m GROUP BY 1, 2")
def stream_bucket_marks(spark: SparkSession, d: str) -> DataFrame:
    """One mark for each user and 15 minutes of the market's hours."""
    work = new_folder(spark, "stream")
    marks = lv.bucket_marks(replayed(spark, d, work), ["user_id"], "price")
    target = lv.UpsertTable(spark, f"{work}/marks", ["user_id", "bucket"], "user_id long, bucket timestamp, ts timestamp, price double")
    out = lv.upsert_available(marks, target, f"{work}/state")
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("bucket", "ts")], "price")


@query("session_windows", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = ev.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


@query("sliding_rate", "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS in_a_day FROM events")
def sliding_rate(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    ev = table(spark, d, "events").select("user_id", "event_id", nearest_second(F.col("ts")).alias("s"))
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-86400, 0)
    return ev.select("user_id", "event_id", F.count(F.lit(1)).over(w).alias("in_a_day"))
