"""Fundamental facts: restatements, year-over-year comparison, series, peers, statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio, yoy
from ..operators.ordered import latest_per_key, top_per_group
from ..registry import query
from ..sources.tables import COMPANIES_SQL, companies, table

FACTS_SQL = """facts AS (
  SELECT l_suppkey AS company_id, date_trunc('quarter', l_shipdate)::DATE AS start_date, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH)::DATE - 1 AS end_date,
    l_returnflag AS version, count(*) AS n_lines, sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_extendedprice * (1 - l_discount) * (1 - 3 * l_tax)) AS income
  FROM lineitem GROUP BY 1, 2, 3, 4)"""
QUARTERS_SQL = f"""{FACTS_SQL}, quarters AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY company_id, start_date, end_date ORDER BY version DESC, revenue DESC) = 1)"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Revenue and income per company, quarter and filing version (the return flag stands for the version)."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    start = F.trunc("l_shipdate", "quarter")
    items = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("company_id"), start.alias("start_date"), F.col("l_returnflag").alias("version"), net.alias("net"), (net * (1 - 3 * F.col("l_tax"))).alias("inc")
    )
    sums = items.groupBy("company_id", "start_date", "version").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("net").alias("revenue"), F.sum("inc").alias("income"))
    return sums.withColumn("end_date", F.date_sub(F.add_months("start_date", 3), 1))


def quarters(spark: SparkSession, d: str) -> DataFrame:
    """The last restatement of each quarter: latest version, then largest value."""
    return latest_per_key(facts(spark, d), ["company_id", "start_date", "end_date"], "version", "revenue")


@query("facts_restatement_dedupe", f"WITH {QUARTERS_SQL} SELECT company_id, start_date, version, round(revenue, 4) AS revenue FROM quarters")
def restatement(spark: SparkSession, d: str) -> DataFrame:
    return quarters(spark, d).select("company_id", "start_date", "version", F.round("revenue", 4).alias("revenue"))


def year_before(df: DataFrame, period: str | None = None) -> DataFrame:
    """Each period with the one whose end is nearest to 365 days before its own, 21 days off at most.

    Bucketing the end dates in 43-day steps turns the range condition into an equality with two buckets,
    so the join is by key and never quadratic in a company's history.  With ``period``, periods of the same label come first.
    """
    width = 43
    cur = df.withColumn("target", F.date_sub("end_date", 365))
    day = F.datediff("target", F.lit("1970-01-01").cast("date"))
    cur = cur.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor((day - 21) / width), F.floor((day + 21) / width)))))
    prev = df.select(
        F.col("company_id").alias("p_company"),
        F.col("end_date").alias("p_end"),
        F.col("start_date").alias("p_start"),
        F.col("revenue").alias("p_revenue"),
        F.floor(F.datediff("end_date", F.lit("1970-01-01").cast("date")) / width).alias("p_bucket"),
        (F.col(period) if period else F.lit(None).cast("string")).alias("p_period"),
    )
    off = F.abs(F.datediff("p_end", "target"))
    both = cur.join(prev, (F.col("company_id") == F.col("p_company")) & (F.col("bucket") == F.col("p_bucket"))).where(off <= 21)
    unlike = (F.col(period).isNotNull() & ~F.col(period).eqNullSafe(F.col("p_period"))) if period else F.lit(False)
    best = F.min_by(F.struct("p_end", "p_start", "p_revenue"), F.struct(unlike, off, F.col("p_end"))).alias("p")
    return both.groupBy("company_id", "end_date", "start_date", "revenue").agg(best).select("company_id", "start_date", "end_date", "revenue", "p.*")


YOY_SQL = f"""{QUARTERS_SQL}, pairs AS (SELECT c.company_id, c.start_date, c.end_date, c.revenue, p.end_date AS p_end, p.start_date AS p_start, p.revenue AS p_revenue
  FROM quarters c JOIN quarters p ON c.company_id = p.company_id AND abs(p.end_date - (c.end_date - 365)) <= 21
  QUALIFY row_number() OVER (PARTITION BY c.company_id, c.end_date ORDER BY abs(p.end_date - (c.end_date - 365)), p.end_date) = 1)"""


@query("facts_yoy_pair", f"WITH {YOY_SQL} SELECT company_id, end_date, p_end, round((revenue - p_revenue) / abs(p_revenue) * 100, 4) AS growth FROM pairs")
def yoy_pair(spark: SparkSession, d: str) -> DataFrame:
    return year_before(quarters(spark, d)).select("company_id", "end_date", "p_end", F.round(yoy(F.col("revenue"), F.col("p_revenue")), 4).alias("growth"))


@query("facts_yoy_status", f"""WITH {YOY_SQL} SELECT q.company_id, q.end_date, CASE WHEN p_end IS NULL THEN 'unknown' WHEN p_revenue < 0 THEN 'not_directly_comparable'
  WHEN abs((q.end_date - q.start_date) - (p_end - p_start)) > 10 THEN 'unknown' ELSE 'ok' END AS status FROM quarters q LEFT JOIN pairs p ON q.company_id = p.company_id AND q.end_date = p.end_date""")
def yoy_status(spark: SparkSession, d: str) -> DataFrame:
    q = quarters(spark, d).select("company_id", "start_date", "end_date")
    pairs = year_before(quarters(spark, d)).select("company_id", "end_date", "p_end", "p_start", "p_revenue")
    longer = F.abs(F.datediff("end_date", "start_date") - F.datediff("p_end", "p_start")) > 10
    status = F.when(F.col("p_end").isNull(), "unknown").when(F.col("p_revenue") < 0, "not_directly_comparable").when(longer, "unknown").otherwise("ok")
    return q.join(pairs, ["company_id", "end_date"], "left").select("company_id", "end_date", status.alias("status"))


@query("growth_condition_score", f"""WITH {YOY_SQL}, g AS (SELECT company_id, end_date, p_revenue, (revenue - p_revenue) / abs(p_revenue) * 100 AS growth FROM pairs)
SELECT company_id, end_date, CASE WHEN p_revenue < 0 THEN 'partial' WHEN growth >= 5 THEN 'met' ELSE 'not_met' END AS status, CASE WHEN p_revenue < 0 THEN 0.5 WHEN growth >= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM g""")
def growth_condition(spark: SparkSession, d: str) -> DataFrame:
    g = yoy(F.col("revenue"), F.col("p_revenue"))
    partial = F.col("p_revenue") < 0
    return year_before(quarters(spark, d)).select(
        "company_id",
        "end_date",
        F.when(partial, "partial").when(g >= 5, "met").otherwise("not_met").alias("status"),
        F.when(partial, 0.5).when(g >= 5, 1.0).otherwise(0.0).alias("score"),
    )


@query("financial_series_prior_point", f"""WITH {QUARTERS_SQL} SELECT c.company_id, c.end_date, max(p.end_date) AS prior_end, round(arg_max(p.revenue, p.end_date), 4) AS prior_revenue
FROM quarters c JOIN quarters p ON c.company_id = p.company_id AND c.end_date - p.end_date BETWEEN 330 AND 400 GROUP BY 1, 2""")
def prior_point(spark: SparkSession, d: str) -> DataFrame:
    """The range condition is an equality of date buckets first; a point lies in one bucket, so pairs meet once."""
    q = quarters(spark, d).select("company_id", "end_date", "revenue")
    days, width = F.unix_date(F.col("end_date")), 400 - 330 + 1
    p = q.select(F.col("company_id").alias("c"), F.col("end_date").alias("p_end"), F.col("revenue").alias("p_revenue"), F.floor(days / width).alias("p_bucket"))
    q = q.withColumn("bucket", F.explode(F.sequence(F.floor((days - 400) / width), F.floor((days - 330) / width))))
    same = (F.col("company_id") == F.col("c")) & (F.col("bucket") == F.col("p_bucket"))
    both = q.join(p, same & F.datediff("end_date", "p_end").between(330, 400))
    return both.groupBy("company_id", "end_date").agg(F.max("p_end").alias("prior_end"), F.round(F.max_by("p_revenue", "p_end"), 4).alias("prior_revenue"))


@query("financial_movements_top4", f"""WITH {YOY_SQL} SELECT company_id, end_date, round((revenue - p_revenue) / abs(p_revenue) * 100, 4) AS growth FROM pairs
QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY end_date DESC, abs((revenue - p_revenue) / abs(p_revenue)) DESC) <= 4""")
def movements(spark: SparkSession, d: str) -> DataFrame:
    g = year_before(quarters(spark, d)).withColumn("g", yoy(F.col("revenue"), F.col("p_revenue")))
    return top_per_group(g, ["company_id"], [F.desc("end_date"), F.desc(F.abs("g"))], 4).select("company_id", "end_date", F.round("g", 4).alias("growth"))


@query("net_margin_series", f"WITH {QUARTERS_SQL} SELECT company_id, end_date, round(income / nullif(revenue, 0) * 100, 4) AS margin FROM quarters")
def margin(spark: SparkSession, d: str) -> DataFrame:
    return quarters(spark, d).select("company_id", "end_date", F.round(ratio(F.col("income"), F.col("revenue")) * 100, 4).alias("margin"))


@query("frequency_match", f"WITH {FACTS_SQL} SELECT company_id, count(*) FILTER (end_date - start_date BETWEEN 70 AND 100) AS quarterly, count(*) FILTER (end_date - start_date BETWEEN 300 AND 430) AS annual FROM facts GROUP BY 1")
def frequency(spark: SparkSession, d: str) -> DataFrame:
    days = F.datediff("end_date", "start_date")
    return facts(spark, d).groupBy("company_id").agg(F.count_if(days.between(70, 100)).alias("quarterly"), F.count_if(days.between(300, 430)).alias("annual"))


@query("latest_positive_revenue", f"WITH {QUARTERS_SQL} SELECT company_id, max(end_date) AS end_date, round(arg_max(revenue, end_date), 4) AS revenue FROM quarters WHERE revenue > 0 GROUP BY 1")
def latest_revenue(spark: SparkSession, d: str) -> DataFrame:
    good = quarters(spark, d).where("revenue > 0")
    return good.groupBy("company_id").agg(F.max("end_date").alias("m"), F.round(F.max_by("revenue", "end_date"), 4).alias("revenue")).withColumnRenamed("m", "end_date")


@query("revenue_cagr", f"""WITH {QUARTERS_SQL}, y AS (SELECT company_id, year(end_date) AS y, sum(revenue) AS r FROM quarters GROUP BY 1, 2)
SELECT company_id, round(pow(arg_max(r, y) / arg_min(r, y), 1.0 / nullif(max(y) - min(y), 0)) - 1, 6) AS cagr FROM y GROUP BY 1""")
def cagr(spark: SparkSession, d: str) -> DataFrame:
    y = quarters(spark, d).groupBy("company_id", F.year("end_date").alias("y")).agg(F.sum("revenue").alias("r"))
    span = F.nullif(F.max("y") - F.min("y"), F.lit(0))
    return y.groupBy("company_id").agg(F.round(F.pow(F.max_by("r", "y") / F.min_by("r", "y"), 1.0 / span) - 1, 6).alias("cagr"))


@query("statement_unpivot", f"""WITH {QUARTERS_SQL} SELECT company_id, end_date, item, round(value, 6) AS value FROM (UNPIVOT (SELECT company_id, end_date, revenue, income FROM quarters) ON revenue, income INTO NAME item VALUE value)""")
def unpivot(spark: SparkSession, d: str) -> DataFrame:
    return quarters(spark, d).unpivot(["company_id", "end_date"], ["revenue", "income"], "item", "value").withColumn("value", F.round("value", 6))


@query("statement_units", f"""WITH {QUARTERS_SQL} SELECT company_id, end_date, CASE WHEN abs(revenue) >= 1e7 THEN 'crore' ELSE 'million' END AS unit, round(revenue / CASE WHEN abs(revenue) >= 1e7 THEN 1e7 ELSE 1e6 END, 6) AS shown FROM quarters""")
def units(spark: SparkSession, d: str) -> DataFrame:
    big = F.abs("revenue") >= 1e7
    return quarters(spark, d).select("company_id", "end_date", F.when(big, "crore").otherwise("million").alias("unit"), F.round(F.col("revenue") / F.when(big, 1e7).otherwise(1e6), 6).alias("shown"))


def mid_rank(df: DataFrame, group: str, value: str) -> DataFrame:
    """Favourability percentile with mid-ranks for ties (higher is better); groups of three and more."""
    whole = Window.partitionBy(group)
    n = F.count(value).over(whole)
    same = F.count(value).over(Window.partitionBy(group, value)) - 1
    less = F.rank().over(Window.partitionBy(group).orderBy(value)) - 1
    return df.withColumns({"n": n, "percentile": 100.0 * (less + same / 2) / (n - 1)}).where("n >= 3")


@query("peer_percentiles", f"""WITH {COMPANIES_SQL}, v AS (SELECT country, company_id, market_cap FROM companies WHERE market_cap > 0),
p AS (SELECT a.country, a.company_id, (SELECT count(*) FROM v b WHERE b.country = a.country) AS n, (SELECT count(*) FROM v b WHERE b.country = a.country AND b.market_cap < a.market_cap) AS less,
  (SELECT count(*) FROM v b WHERE b.country = a.country AND b.market_cap = a.market_cap) - 1 AS same FROM v a)
SELECT country, company_id, round(100.0 * (less + same / 2) / (n - 1), 6) AS percentile FROM p WHERE n >= 3""")
def peer_percentiles(spark: SparkSession, d: str) -> DataFrame:
    good = companies(spark, d).where("market_cap > 0")
    return mid_rank(good, "country", "market_cap").select("country", "company_id", F.round("percentile", 6).alias("percentile"))


@query("direction_assessment", f"""WITH {YOY_SQL}, s AS (SELECT company_id, avg(sign(round((revenue - p_revenue) / abs(p_revenue) * 100, 6))) AS mean_sign, count(*) AS n FROM pairs GROUP BY 1)
SELECT company_id, round(mean_sign, 6) AS mean_sign, CASE WHEN mean_sign >= 0.25 THEN 'positive' WHEN mean_sign <= -0.25 THEN 'negative' ELSE 'mixed' END AS direction, n FROM s""")
def direction(spark: SparkSession, d: str) -> DataFrame:
    g = year_before(quarters(spark, d)).withColumn("s", F.signum(F.round(yoy(F.col("revenue"), F.col("p_revenue")), 6)))
    m = g.groupBy("company_id").agg(F.avg("s").alias("m"), F.count(F.lit(1)).alias("n"))
    word = F.when(F.col("m") >= 0.25, "positive").when(F.col("m") <= -0.25, "negative").otherwise("mixed")
    return m.select("company_id", F.round("m", 6).alias("mean_sign"), word.alias("direction"), "n")


@query("recent_filings_by_form", "SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) <= CASE o_orderpriority WHEN '1-URGENT' THEN 6 ELSE 1 END")
def recent_filings(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.desc("o_orderdate"), "o_orderkey")
    orders = table(spark, d, "orders").withColumn("k", F.row_number().over(w)).where("k <= 6")
    return orders.where(F.col("k") <= F.when(F.col("o_orderpriority") == "1-URGENT", 6).otherwise(1)).select("o_custkey", "o_orderpriority", "o_orderkey")
