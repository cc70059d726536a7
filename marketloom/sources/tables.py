"""Parquet tables, and the domain views that the operators' queries use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nearest_second(ts: Column) -> Column:
    """Seconds of the epoch rounded to the nearest, halves to the even one."""
    return F.rint(F.unix_micros(ts.cast("timestamp")) / 1e6).cast("long")


def require_columns(df: DataFrame, names: set[str]) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    missing = names - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    return df


def companies(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as companies: id, ticker, name, sector (region), country (nation), market cap (balance)."""
    nation = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        table(spark, d, "supplier")
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("company_id"),
            F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"),
            F.col("s_name").alias("name"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("country"),
            F.col("s_acctbal").alias("market_cap"),
        )
    )


COMPANIES_SQL = """companies AS (
  SELECT s_suppkey AS company_id, 'T' || s_suppkey AS ticker, s_name AS name, r_name AS sector, n_name AS country,
         s_acctbal AS market_cap
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def cards(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as cards of a company: directness and confidence follow from the id."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("card_id"),
        F.col("label").alias("company_id"),
        F.element_at(F.array(*map(F.lit, ("core", "direct", "indirect", "prospective"))), (F.col("vec_id") % 4 + 1).cast("int")).alias("directness"),
        ((F.col("vec_id") % 10) / 10.0).alias("confidence"),
        F.col("embedding"),
    )


CARDS_SQL = """cards AS (
  SELECT vec_id AS card_id, label AS company_id, ['core', 'direct', 'indirect', 'prospective'][(vec_id % 4 + 1)::INT] AS directness,
         (vec_id % 10) / 10.0::DOUBLE AS confidence, embedding FROM embeddings)"""


def conditions(spark: SparkSession, d: str, ids: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """The vectors of three cards as the conditions of a plan: few rows, fixed by the plan."""
    return (
        table(spark, d, "embeddings")
        .where(F.col("vec_id").isin(*ids))
        .select(
            F.col("vec_id").alias("cond_id"),
            F.col("embedding").alias("query"),
            (F.col("vec_id") < 2).alias("required"),
            (F.col("vec_id") + 1.0).alias("weight"),
        )
    )


CONDITIONS_SQL = """conditions AS (
  SELECT vec_id AS cond_id, embedding AS query, vec_id < 2 AS required, vec_id + 1.0::DOUBLE AS weight
  FROM embeddings WHERE vec_id IN (0, 1, 2))"""


def candles(spark: SparkSession, d: str) -> DataFrame:
    """Events as candles of a user: price is value, volume is props.k; highs and lows follow from the price."""
    v = F.col("value")
    return table(spark, d, "events").select(
        F.col("user_id").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id"),
        (v * 0.99).alias("open"),
        (v * 1.02).alias("high"),
        (v * 0.97).alias("low"),
        v.alias("close"),
        F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0)).alias("volume"),
    )


CANDLES_SQL = """candles AS (
  SELECT user_id AS symbol, ts, event_id, value * 0.99 AS open, value * 1.02 AS high, value * 0.97 AS low, value AS close,
         coalesce((props->>'$.k')::DOUBLE, 0.0) AS volume FROM events)"""


def daily_price(spark: SparkSession, d: str) -> DataFrame:
    """Mean order value per day as one price series."""
    return (
        table(spark, d, "orders")
        .groupBy(F.to_date("o_orderdate").alias("d"))
        .agg(F.avg("o_totalprice").alias("price"))
    )


DAILY_SQL = """daily AS (SELECT o_orderdate::DATE AS d, avg(o_totalprice) AS price FROM orders GROUP BY 1)"""


def monthly_prices(spark: SparkSession, d: str) -> DataFrame:
    """Monthly mean unit price of every supplier: the closes of the pair screens."""
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_suppkey").alias("ticker"), F.trunc("l_shipdate", "month").alias("d"))
        .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))
    )


MONTHLY_SQL = """monthly AS (
  SELECT l_suppkey AS ticker, date_trunc('month', l_shipdate)::DATE AS d, avg(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""


def weekly_prices(spark: SparkSession, d: str) -> DataFrame:
    """Weekly mean unit price of every supplier up to the last week of the table; weeks without a trade keep the close before."""
    week = F.trunc("l_shipdate", "week")
    lines = table(spark, d, "lineitem")
    traded = lines.groupBy(F.col("l_suppkey").alias("ticker"), week.alias("w")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))
    last = lines.agg(F.max(week)).scalar()
    until = F.coalesce(F.date_sub(F.lead("w").over(Window.partitionBy("ticker").orderBy("w")), 7), last)
    held = traded.withColumn("until", until)
    return held.select("ticker", F.explode(F.sequence("w", "until", F.expr("INTERVAL 7 DAY"))).alias("d"), "close")


WEEKLY_SQL = """traded AS (SELECT l_suppkey AS ticker, date_trunc('week', l_shipdate)::DATE AS w, avg(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1, 2),
held AS (SELECT *, coalesce(lead(w) OVER (PARTITION BY ticker ORDER BY w) - 7, (SELECT max(w) FROM traded)) AS until FROM traded),
weekly AS (SELECT ticker, unnest(generate_series(w::TIMESTAMP, until::TIMESTAMP, INTERVAL 7 DAY))::DATE AS d, close FROM held)"""


def supplier_days(spark: SparkSession, d: str) -> DataFrame:
    """Daily closes of every supplier on its trading days: its mean unit price, damped to moves of a few percent."""
    mean = F.avg(F.col("l_extendedprice") / F.col("l_quantity"))
    days = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("d"))
    return days.agg((100 * F.pow(mean / 1000, F.lit(0.05))).alias("price"))


SUPPLIER_DAYS_SQL = "supplier_days AS (SELECT l_suppkey AS symbol, l_shipdate::DATE AS d, 100 * pow(avg(l_extendedprice / l_quantity) / 1000, 0.05) AS price FROM lineitem GROUP BY 1, 2)"
