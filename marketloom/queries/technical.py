"""Technical indicators over candle windows, and the scan built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..operators.ordered import as_of, ewm_all, ewm_last, series, top_per_group
from ..plans.conditions import passes, strength
from ..registry import query
from ..sources.tables import CANDLES_SQL, candles, table

LIMIT = 70


def recent_candles(spark: SparkSession, d: str, limit: int = LIMIT) -> DataFrame:
    """Valid candles, the last of equal times, the latest ``limit`` per symbol, with a row number k from the start."""
    good = candles(spark, d).where("close > 0 AND volume >= 0")
    one = top_per_group(good, ["symbol", "ts"], [F.desc("event_id")], 1, "_dup").drop("_dup")
    late = top_per_group(one, ["symbol"], [F.desc("ts")], limit, "_back")
    return late.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))).drop("_back")


RECENT_SQL = f"""{CANDLES_SQL},
uniq AS (SELECT * FROM candles WHERE close > 0 AND volume >= 0 QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id DESC) = 1),
tail AS (SELECT * FROM uniq QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= {LIMIT}),
recent AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM tail)"""
#: Fold of an exponentially weighted mean over a list in SQL.
FOLD = "list_reduce({v}, lambda y, x: y + {a}::DOUBLE * (x - y))"


@query("candles_normalised", f"WITH {RECENT_SQL} SELECT symbol, ts, k, close, volume FROM recent")
def normalised(spark: SparkSession, d: str) -> DataFrame:
    return recent_candles(spark, d).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("k").cast("long").alias("k"), "close", "volume")


ARRAYS_SQL = f"""{RECENT_SQL}, moves AS (SELECT *, close - lag(close) OVER s AS delta, lag(close) OVER s AS before FROM recent WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
arrays AS (SELECT symbol, count(*) AS n, list(close ORDER BY ts) AS c, list(greatest(delta, 0) ORDER BY ts) FILTER (delta IS NOT NULL) AS up,
  list(greatest(-delta, 0) ORDER BY ts) FILTER (delta IS NOT NULL) AS down, list(greatest(high - low, coalesce(abs(high - before), 0), coalesce(abs(low - before), 0)) ORDER BY ts) AS tr,
  arg_max(close, ts) AS latest FROM moves GROUP BY symbol HAVING count(*) >= 35)"""


def candle_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of closes, gains, losses and true ranges of symbols with 35 candles or more."""
    w = Window.partitionBy("symbol").orderBy("ts")
    before = F.lag("close").over(w)
    moved = recent_candles(spark, d).withColumns({"before": before, "delta": F.col("close") - before})
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("before")), F.abs(F.col("low") - F.col("before")))
    out = series(
        moved, "symbol", ["ts"], c=F.col("close"), up=F.greatest("delta", F.lit(0.0)), down=F.greatest(-F.col("delta"), F.lit(0.0)), tr=tr
    )
    tail = lambda c: F.slice(c, 2, F.size(c))  # noqa: E731  a first difference doesn't exist
    out = out.withColumns({"up": tail("up"), "down": tail("down"), "n": F.size("c"), "latest": F.element_at("c", -1)})
    return out.where("n >= 35")


@query("ema_9_21", f"WITH {ARRAYS_SQL} SELECT symbol, round({FOLD.format(v='c', a=0.2)}, 6) AS ema_9, round({FOLD.format(v='c', a=2 / 22)}, 6) AS ema_21 FROM arrays")
def ema(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c")
    return candle_arrays(spark, d).select("symbol", F.round(ewm_last(c, 0.2), 6).alias("ema_9"), F.round(ewm_last(c, 2 / 22), 6).alias("ema_21"))


@query("rsi_wilder", f"""WITH {ARRAYS_SQL}, w AS (SELECT symbol, {FOLD.format(v='up', a=1 / 14)} AS g, {FOLD.format(v='down', a=1 / 14)} AS l FROM arrays)
SELECT symbol, round(CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi_14 FROM w""")
def rsi(spark: SparkSession, d: str) -> DataFrame:
    g, lo = ewm_last(F.col("up"), 1 / 14), ewm_last(F.col("down"), 1 / 14)
    w = candle_arrays(spark, d).select("symbol", g.alias("g"), lo.alias("l"))
    return w.select("symbol", F.round(F.when(F.col("l") == 0, 100.0).otherwise(100 - 100 / (1 + ratio(F.col("g"), F.col("l")))), 6).alias("rsi_14"))


@query("atr_wilder", f"WITH {ARRAYS_SQL} SELECT symbol, round({FOLD.format(v='tr', a=1 / 14)} / latest * 100, 6) AS atr_percent FROM arrays")
def atr(spark: SparkSession, d: str) -> DataFrame:
    return candle_arrays(spark, d).select("symbol", F.round(ewm_last(F.col("tr"), 1 / 14) / F.col("latest") * 100, 6).alias("atr_percent"))


def macd_columns(df: DataFrame) -> DataFrame:
    df = df.withColumns({"e12": ewm_all(F.col("c"), 2 / 13), "e26": ewm_all(F.col("c"), 2 / 27)})
    df = df.withColumn("line", F.zip_with("e12", "e26", lambda a, b: a - b))
    return df.withColumn("signal", ewm_last(F.col("line"), 0.2)).withColumn("macd_line", F.element_at("line", -1))


_ALL = "list_transform(range(1, n + 1), lambda i: list_reduce(c[1:i], lambda y, x: y + {a}::DOUBLE * (x - y)))"


@query("macd", f"""WITH {ARRAYS_SQL}, e AS (SELECT symbol, {_ALL.format(a=2 / 13)} AS e12, {_ALL.format(a=2 / 27)} AS e26 FROM arrays),
l AS (SELECT symbol, list_transform(list_zip(e12, e26), lambda p: p[1] - p[2]) AS line FROM e)
SELECT symbol, round(line[-1], 6) AS macd_line, round(line[-1] - {FOLD.format(v='line', a=0.2)}, 6) AS histogram FROM l""")
def macd(spark: SparkSession, d: str) -> DataFrame:
    m = macd_columns(candle_arrays(spark, d))
    return m.select("symbol", F.round("macd_line", 6).alias("macd_line"), F.round(F.col("macd_line") - F.col("signal"), 6).alias("histogram"))


@query("vwap_session", f"WITH {RECENT_SQL} SELECT symbol, round(CASE WHEN sum(volume) > 0 THEN sum((high + low + close) / 3 * volume) / sum(volume) ELSE avg(close) END, 6) AS vwap FROM recent GROUP BY 1")
def vwap(spark: SparkSession, d: str) -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    v = F.when(F.sum("volume") > 0, ratio(F.sum(typical * F.col("volume")), F.sum("volume"))).otherwise(F.avg("close"))
    return recent_candles(spark, d).groupBy("symbol").agg(F.round(v, 6).alias("vwap"))


@query("bollinger_relvol_returns", f"""WITH {RECENT_SQL}, w AS (SELECT symbol, k, close, avg(close) OVER b AS mid, stddev_pop(close) OVER b AS sd, volume / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS rv,
  (close / lag(close, 5) OVER s - 1) * 100 AS r5, (close / lag(close, 15) OVER s - 1) * 100 AS r15, (close / lag(close, 60) OVER s - 1) * 100 AS r60 FROM recent
  WINDOW s AS (PARTITION BY symbol ORDER BY ts), b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT symbol, k, round(CASE WHEN k >= 20 THEN CASE WHEN 4 * sd > 1e-12 THEN (close - (mid - 2 * sd)) / (4 * sd) * 100 ELSE 50.0 END END, 5) AS position, round(rv, 6) AS relative_volume,
  round(r5, 6) AS return_5, round(r15, 6) AS return_15, round(r60, 6) AS return_60 FROM w""")
def bollinger(spark: SparkSession, d: str) -> DataFrame:
    s = Window.partitionBy("symbol").orderBy("ts")
    band, prior = s.rowsBetween(-19, 0), s.rowsBetween(-20, -1)
    back = lambda n: (F.col("close") / F.lag("close", n).over(s) - 1) * 100
    w = recent_candles(spark, d).select(
        "symbol", "k", "close", F.avg("close").over(band).alias("mid"), F.stddev_pop("close").over(band).alias("sd"),
        ratio(F.col("volume"), F.avg("volume").over(prior)).alias("rv"), back(5).alias("r5"), back(15).alias("r15"), back(60).alias("r60"),
    )
    width = 4 * F.col("sd")
    position = F.when(width > 1e-12, ratio(F.col("close") - (F.col("mid") - 2 * F.col("sd")), width) * 100).otherwise(50.0)
    return w.select(
        "symbol", F.col("k").cast("long").alias("k"), F.round(F.when(F.col("k") >= 20, position), 5).alias("position"), F.round("rv", 6).alias("relative_volume"),
        F.round("r5", 6).alias("return_5"), F.round("r15", 6).alias("return_15"), F.round("r60", 6).alias("return_60"),
    )


SCAN_SQL = f"""{ARRAYS_SQL}, ind AS (SELECT symbol, latest, {FOLD.format(v='up', a=1 / 14)} AS g, {FOLD.format(v='down', a=1 / 14)} AS l,
  ({FOLD.format(v='c', a=0.2)} / {FOLD.format(v='c', a=2 / 22)} - 1) * 100 AS trend, {FOLD.format(v='tr', a=1 / 14)} / latest * 100 AS atr FROM arrays),
snap AS (SELECT symbol, latest, CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END AS rsi, trend, atr FROM ind),
hit AS (SELECT symbol, (greatest(0.5, 1 - 0.5 * abs(rsi - 50) / 20) + CASE WHEN trend > 0 THEN least(1.0, greatest(0.5, 0.5 + 0.5 * trend / 1.0)) ELSE 0 END) / (1 + (trend > 0)::INT) AS technical
  FROM snap WHERE rsi BETWEEN 30 AND 70)"""


@query("technical_scan_rank", f"""WITH {SCAN_SQL} SELECT symbol, round(0.55 * technical + 0.45 * (symbol % 10) / 10.0, 6) AS score FROM hit ORDER BY 0.55 * technical + 0.45 * (symbol % 10) / 10.0 DESC, symbol LIMIT 25""")
def technical_scan(spark: SparkSession, d: str) -> DataFrame:
    """A required band of RSI and an optional rising trend; mean strength, blended with a semantic score."""
    a = candle_arrays(spark, d).select(
        "symbol", ewm_last(F.col("up"), 1 / 14).alias("g"), ewm_last(F.col("down"), 1 / 14).alias("l"),
        ((ewm_last(F.col("c"), 0.2) / ewm_last(F.col("c"), 2 / 22) - 1) * 100).alias("trend"),
    )
    rsi_ = F.when(F.col("l") == 0, 100.0).otherwise(100 - 100 / (1 + ratio(F.col("g"), F.col("l"))))
    a = a.withColumn("rsi", rsi_)
    band, rising = ("between", 30.0, 70.0), ("gt", 0.0)
    held = a.where(passes(F.col("rsi"), *band)).withColumn("up", passes(F.col("trend"), *rising))
    total = strength(F.col("rsi"), *band) + F.when(F.col("up"), strength(F.col("trend"), *rising)).otherwise(0.0)
    score = 0.55 * total / (1 + F.col("up").cast("int")) + 0.45 * (F.col("symbol") % 10) / 10.0
    best = held.withColumn("s", score).orderBy(F.desc("s"), "symbol").limit(25)
    return best.select("symbol", F.round("s", 6).alias("score"))


@query("candles_ohlc_hour", f"WITH {CANDLES_SQL} SELECT symbol, date_trunc('hour', ts) AS bar, arg_min(close, (ts, event_id)) AS open, max(close) AS high, min(close) AS low, arg_max(close, (ts, event_id)) AS close, sum(volume) AS volume FROM candles GROUP BY 1, 2")
def ohlc(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return candles(spark, d).groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bar")).agg(
        F.min_by("close", at).alias("open"), F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", at).alias("close"), F.sum("volume").alias("volume")
    )


@query("bars_anchored_0915_ist", f"""WITH {CANDLES_SQL}, m AS (SELECT symbol, close, volume, ts + INTERVAL 330 MINUTE AS local FROM candles),
b AS (SELECT *, floor((hour(local) * 60 + minute(local) - 555) / 30.0) * 30 + 555 AS start FROM m)
SELECT symbol, local::DATE AS day, start::INT AS start_minute, count(*) AS n, max(close) AS high, sum(volume) AS volume FROM b GROUP BY 1, 2, 3""")
def anchored(spark: SparkSession, d: str) -> DataFrame:
    """Thirty-minute bars anchored at 09:15 in Kolkata, which has no daylight saving time."""
    local = F.from_utc_timestamp("ts", "Asia/Kolkata")
    minute = F.hour(local) * 60 + F.minute(local)
    start = (F.floor((minute - 555) / 30) * 30 + 555).cast("int")
    return candles(spark, d).groupBy("symbol", F.to_date(local).alias("day"), start.alias("start_minute")).agg(F.count(F.lit(1)).alias("n"), F.max("close").alias("high"), F.sum("volume").alias("volume"))


@query("volume_delta", f"""WITH {CANDLES_SQL}, c AS (SELECT symbol, ts, event_id, sum(volume) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts, event_id) % 40 AS day_volume FROM candles)
SELECT event_id, greatest(coalesce(day_volume - lag(day_volume) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts, event_id), 0), 0) AS delta FROM c""")
def volume_delta(spark: SparkSession, d: str) -> DataFrame:
    """Per-tick volume from a day counter; the first tick of a day and a fall of the counter count zero."""
    w = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts", "event_id")
    counted = candles(spark, d).withColumn("day_volume", F.sum("volume").over(w) % 40)
    w = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts", "event_id")
    return counted.select("event_id", F.greatest(F.coalesce(F.col("day_volume") - F.lag("day_volume").over(w), F.lit(0.0)), F.lit(0.0)).alias("delta"))


@query("asof_view_purchase", """SELECT v.event_id, p.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN
 (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON v.user_id = p.user_id AND v.ts >= p.ts""")
def asof_purchase(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    views = ev.where("event_type = 'view'").select("event_id", "user_id", "ts")
    bought = ev.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return as_of(views, bought, "user_id", "ts", ["value"]).select("event_id", "asof_value")


@query("prior_closes_251", """SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts < TIMESTAMP '2024-01-20') WHERE k <= 251 GROUP BY 1""")
def prior_closes(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "events").where("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'").select("user_id", "value", "ts", "event_id")
    last = top_per_group(old, ["user_id"], [F.desc("ts"), F.desc("event_id")], 251, "k")
    return last.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("overlay_forming_candle", f"""WITH {CANDLES_SQL}, h AS (SELECT symbol, date_trunc('hour', ts) AS bar, max(close) AS high, min(close) AS low, arg_max(close, (ts, event_id)) AS close, sum(volume) AS volume FROM candles WHERE event_id % 2 = 0 GROUP BY 1, 2),
l AS (SELECT symbol, date_trunc('hour', ts) AS bar, max(close) AS high, min(close) AS low, arg_max(close, (ts, event_id)) AS close, sum(volume) AS volume FROM candles WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(h.symbol, l.symbol) AS symbol, coalesce(h.bar, l.bar) AS bar, greatest(h.high, l.high) AS high, least(h.low, l.low) AS low, coalesce(l.close, h.close) AS close, greatest(h.volume, l.volume) AS volume FROM h FULL JOIN l ON h.symbol = l.symbol AND h.bar = l.bar""")
def overlay(spark: SparkSession, d: str) -> DataFrame:
    """Live bars over history: the same bucket is merged (volume by maximum), others are kept."""
    def bars(rest: int) -> DataFrame:
        some = candles(spark, d).where(F.col("event_id") % 2 == rest)
        return some.groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bar")).agg(
            F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", F.struct("ts", "event_id")).alias("close"), F.sum("volume").alias("volume")
        )

    h, live = bars(0).alias("h"), bars(1).alias("l")
    both = h.join(live, (F.col("h.symbol") == F.col("l.symbol")) & (F.col("h.bar") == F.col("l.bar")), "full")
    return both.select(
        F.coalesce("h.symbol", "l.symbol").alias("symbol"), F.coalesce("h.bar", "l.bar").alias("bar"), F.greatest("h.high", "l.high").alias("high"),
        F.least("h.low", "l.low").alias("low"), F.coalesce("l.close", "h.close").alias("close"), F.greatest("h.volume", "l.volume").alias("volume"),
    )
