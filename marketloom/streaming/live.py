"""Live candles in several widths from one stream, and tables that updates are merged into.

Ticks have symbol, ts, price, volume, event_id and, for ``market_minutes``, market_hours (1 in regular hours).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Widths of the bars, and where their windows begin so that one begins at 09:15 in Kolkata (03:45 UTC).
WIDTHS = {"5 minutes": "0 minutes", "15 minutes": "0 minutes", "30 minutes": "15 minutes", "60 minutes": "45 minutes"}
DELAY = "10 minutes"
REGULAR = 1


def market_minutes(ticks: DataFrame, delay: str = DELAY) -> DataFrame:
    """Minute bars of ticks in regular market hours, with the times of their first and last tick; null hours are not regular."""
    at = F.struct("ts", "event_id")
    regular = ticks.where(F.col("market_hours") == REGULAR).withWatermark("ts", delay)
    return regular.groupBy("symbol", F.window("ts", "1 minute").alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume")
    )


def rebucketed(minutes: DataFrame, width: str, offset: str) -> DataFrame:
    """Wider bars from minute bars, chained on the time of their windows: a second state that closes with the first one's watermark."""
    start = F.col("w.start")
    wide = minutes.groupBy("symbol", F.window(F.window_time("w"), width, width, offset).alias("b"))
    bars = wide.agg(F.min_by("open", start).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", start).alias("close"), F.sum("volume").alias("volume"))
    return bars.select("symbol", F.lit(int(width.split()[0])).alias("minutes"), F.col("b.start").alias("bar_start"), F.col("b.end").alias("bar_end"), "open", "high", "low", "close", "volume")


def live_bars(ticks: DataFrame, delay: str = DELAY) -> DataFrame:
    """Bars of all ``WIDTHS`` of a stream or a batch of ticks, in one query."""
    parts = [rebucketed(market_minutes(ticks, delay), width, offset) for width, offset in WIDTHS.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class UpsertTable:
    """A Parquet table that micro-batches of changed rows are merged into, by key.

    Each batch is a folder of its own, named by its id and written over if the batch comes again, so a replay after a failure changes
    nothing.  Readers take the row of each key from its last batch; ``compact`` folds all batches so far into one.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str):
        self.spark, self.folder, self.keys, self.schema = spark, folder.rstrip("/"), keys, schema

    def merge(self, changed: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``.  Keys must be distinct within a batch, as the rows of an aggregation in update mode are."""
        changed.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def read(self) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, batch long").option("basePath", self.folder).parquet(self.folder)
        rest = [c for c in rows.columns if c not in self.keys]
        best = F.max_by(F.struct(*rest), "batch").alias("_row")
        return rows.groupBy(*self.keys).agg(best).select(*self.keys, *[F.col(f"_row.{c}").alias(c) for c in rest if c != "batch"])

    def compact(self, upto: int) -> None:
        """Fold the batches up to ``upto``, which must all be done, into the last of them; others stay as they are."""
        whole = self.spark.read.schema(f"{self.schema}, batch long").option("basePath", self.folder).parquet(self.folder).where(F.col("batch") <= upto)
        w = Window.partitionBy(*self.keys).orderBy(F.desc("batch"))
        last = whole.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "batch")
        last.write.mode("overwrite").parquet(f"{self.folder}/_compact")
        place = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = place(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [s.getPath() for s in fs.listStatus(place(self.folder)) if s.getPath().getName().startswith("batch=") and int(s.getPath().getName()[6:]) <= upto]
        for path in old:
            fs.delete(path, True)
        fs.rename(place(f"{self.folder}/_compact"), place(f"{self.folder}/batch={upto}"))


def upsert_available(stream: DataFrame, table: UpsertTable, checkpoint: str) -> DataFrame:
    """Merge what there is, batch by batch, and read the table."""
    query = stream.writeStream.outputMode("update").foreachBatch(table.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return table.read()


def latest(ticks: DataFrame) -> DataFrame:
    """The last price of each symbol by event time, for update mode."""
    return ticks.groupBy("symbol").agg(F.max_by(F.struct("ts", "price"), F.struct("ts", "event_id")).alias("q")).select("symbol", "q.*")


def bucket_marks(marks: DataFrame, keys: list[str], value: str, width: str = "15 minutes", delay: str = DELAY) -> DataFrame:
    """One mark for each key and bucket of market hours, its first by (ts, event_id), for update mode; state goes with the watermark."""
    at: Column = F.struct("ts", "event_id")
    regular = marks.where(F.col("market_hours") == REGULAR).withWatermark("ts", delay)
    first = regular.groupBy(*keys, F.window("ts", width).alias("w")).agg(F.min_by(F.struct("ts", value), at).alias("m"))
    return first.select(*keys, F.col("w.start").alias("bucket"), "m.*")
