"""Live ticks to candles: validation, windowed bars, volume deltas, latest quotes, deduplicated marks.

Each function takes a streaming or a batch DataFrame of ticks (symbol, ts, price, volume, event_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

DELAY = "2 days"


def tick_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = 8) -> DataFrame:
    """Parquet files as they come; times without zone are UTC.

    Without ``files_per_trigger`` all files there are make one batch: a replay whose results don't depend on the order of files,
    as no row is late for its own batch and folds see all rows of a key in order of time.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    source = reader.parquet(path)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def valid_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks with an id, a time and a finite positive price; others are dropped, so that replays agree."""
    price = F.col("price")
    return ticks.where(F.col("symbol").isNotNull() & F.col("ts").isNotNull() & (price > 0) & ~F.isnan(price) & (price < float("inf")))


def bars(ticks: DataFrame, width: str = "1 hour", offset: str = "45 minutes", delay: str = DELAY) -> DataFrame:
    """Open, high, low, close and volume per symbol and window (09:15 in Kolkata is 03:45 UTC)."""
    at = F.struct("ts", "event_id")
    grouped = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width, width, offset).alias("w"))
    out = grouped.agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume")
    )
    return out.select("symbol", F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "volume")


def latest_quotes(ticks: DataFrame) -> DataFrame:
    """The last price per symbol by event time (update or complete mode)."""
    return ticks.groupBy("symbol").agg(F.max_by(F.struct("ts", "price"), F.struct("ts", "event_id")).alias("q")).select("symbol", "q.*")


def marks_once(marks: DataFrame, keys: list[str], delay: str = DELAY) -> DataFrame:
    """One mark per key and source time, with state that the watermark bounds."""
    return marks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


class DayCounter(StatefulProcessor):
    """The counter of one symbol and day as a value state, cleared by a timer when the watermark passes the day's end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "last double, at double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ticks = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"])
        at = (ticks.ts - pd.Timestamp(0)).dt.total_seconds()
        held = self.counter.get() if self.counter.exists() else None
        last, seen = held if held is not None else (None, float("-inf"))
        fresh = ticks.day_volume[at >= seen]
        delta = pd.Series(0.0, index=ticks.index)
        if len(fresh):
            before = fresh.shift(1)
            if last is not None:
                before.iloc[0] = last
            delta[fresh.index] = (fresh - before).clip(lower=0).fillna(0.0)
            self.counter.update((float(fresh.iloc[-1]), float(at.iloc[-1])))
        if held is None:
            day_end = int((pd.Timestamp(key[1]) + pd.Timedelta(days=1)).timestamp() * 1000)
            self.handle.registerTimer(max(day_end, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"event_id": ticks.event_id, "delta": delta})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.counter.clear()
        return iter(())

    def close(self) -> None:
        pass


#: The state store that value states and timers need.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def volume_deltas(ticks: DataFrame, delay: str = DELAY) -> DataFrame:
    """Per-tick volume from a counter per symbol and day, held in a value state; first ticks and falls count zero.

    A tick older than one of an earlier batch counts zero too and leaves the counter as it is.  A day's state goes when the
    watermark passes the day's end; later ticks of the day are dropped as late.  Sets the session's state store to RocksDB.
    """
    ticks.sparkSession.conf.set(*ROCKS)
    keyed = ticks.withWatermark("ts", delay).withColumn("day", F.to_date("ts")).groupBy("symbol", "day")
    return keyed.transformWithStateInPandas(DayCounter(), "event_id long, delta double", "append", "EventTime")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what there is, write Parquet, and read it back."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(out)


def replay(df: DataFrame, folder: str, parts: int, by: str = "ts") -> DataFrame:
    """A stream of a batch table in order of a column: ``parts`` files, one a micro-batch, as if the rows had come in over time."""
    spark = df.sparkSession
    df.repartitionByRange(parts, by).sortWithinPartitions(by).write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    for k, file in enumerate(files):  # ``parts`` files at most; a file source takes the oldest first
        fs.setTimes(file, 1_700_000_000_000 + 1000 * k, -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
