"""Structured filters of a plan over companies, and card and text predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import positive
from ..plans.conditions import Condition, apply_filters, passes, status, strength, with_statuses
from ..registry import query
from ..sources.tables import CANDLES_SQL, COMPANIES_SQL, candles, companies, table

SECTOR = Condition("sector", "in", ("asia", "EUROPE"), required=True)
COUNTRY = Condition("country", "eq", "an", required=False)
AROUND = Condition("market_cap", "around", 5000.0)


@query("filter_text_match", f"WITH {COMPANIES_SQL} SELECT company_id, sector FROM companies WHERE contains(lower(sector), 'asia') OR contains(lower(sector), 'europe')")
def text_filter(spark: SparkSession, d: str) -> DataFrame:
    return companies(spark, d).where(status(SECTOR) == "pass").select("company_id", "sector")


@query("filter_ticker", f"WITH {COMPANIES_SQL} SELECT company_id, ticker FROM companies WHERE upper(ticker) IN ('T1', 'T7', 'T9')")
def ticker_filter(spark: SparkSession, d: str) -> DataFrame:
    return companies(spark, d).where(status(Condition("ticker", "gte", ["t1", "t7", "T9"])) == "pass").select("company_id", "ticker")


@query("filter_market_cap_around", f"WITH {COMPANIES_SQL} SELECT company_id, market_cap FROM companies WHERE market_cap BETWEEN 3000 AND 7000")
def cap_around(spark: SparkSession, d: str) -> DataFrame:
    return companies(spark, d).where(status(AROUND) == "pass").select("company_id", "market_cap")


@query("filter_market_cap_between", f"WITH {COMPANIES_SQL} SELECT company_id, market_cap FROM companies WHERE market_cap BETWEEN 1000 AND 9000")
def cap_between(spark: SparkSession, d: str) -> DataFrame:
    return companies(spark, d).where(status(Condition("market_cap", "between", (9000, 1000))) == "pass").select("company_id", "market_cap")


THREE_SQL = f"""WITH {COMPANIES_SQL}, n AS (SELECT *, CASE WHEN company_id % 7 = 0 THEN NULL ELSE market_cap END AS cap FROM companies),
s AS (SELECT company_id, CASE WHEN sector IS NULL THEN 'not_verified' WHEN contains(lower(sector), 'asia') OR contains(lower(sector), 'europe') THEN 'pass' ELSE 'fail' END AS status_0,
  CASE WHEN country IS NULL THEN 'not_verified' WHEN contains(lower(country), 'an') THEN 'pass' ELSE 'fail' END AS status_1,
  CASE WHEN cap IS NULL THEN 'not_verified' WHEN cap BETWEEN 3000 AND 7000 THEN 'pass' ELSE 'fail' END AS status_2 FROM n)"""


def _with_gaps(spark: SparkSession, d: str) -> DataFrame:
    return companies(spark, d).withColumn("market_cap", F.when(F.col("company_id") % 7 != 0, F.col("market_cap")))


@query("filter_three_valued", f"{THREE_SQL} SELECT * FROM s")
def three_valued(spark: SparkSession, d: str) -> DataFrame:
    return with_statuses(_with_gaps(spark, d), [SECTOR, COUNTRY, AROUND]).select("company_id", "status_0", "status_1", "status_2")


@query("filter_keep_rule", f"{THREE_SQL} SELECT company_id FROM s WHERE status_0 <> 'fail' AND status_2 <> 'fail'")
def keep_rule(spark: SparkSession, d: str) -> DataFrame:
    return apply_filters(_with_gaps(spark, d), [SECTOR, COUNTRY, AROUND]).select("company_id")


@query("filter_text_ordering_fails", f"WITH {COMPANIES_SQL} SELECT count(*) AS n FROM companies WHERE false")
def ordering_fails(spark: SparkSession, d: str) -> DataFrame:
    return companies(spark, d).where(status(Condition("sector", "gte", "asia")) != "fail").agg(F.count(F.lit(1)).alias("n"))


@query("technical_predicates", f"""WITH {CANDLES_SQL} SELECT event_id, close > 100 AS above, coalesce(close BETWEEN 50 AND 150, false) AS inside,
  round(greatest(0.5, 1 - 0.5 * abs(close - 100) / 50), 6) AS inside_strength, round(least(1.0, greatest(0.5, 0.5 + 0.5 * (close - 100) / 100.0)), 6) AS above_strength FROM candles""")
def technical_predicates(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("close")
    return candles(spark, d).select(
        "event_id",
        passes(c, "gt", 100).alias("above"),
        passes(c, "between", 50, 150).alias("inside"),
        F.round(strength(c, "between", 50, 150), 6).alias("inside_strength"),
        F.round(strength(c, "gt", 100), 6).alias("above_strength"),
    )


@query("positive_number_parse", """SELECT event_id, CASE WHEN try_cast(x AS DOUBLE) > 0 AND isfinite(try_cast(x AS DOUBLE)) THEN try_cast(x AS DOUBLE) END AS number
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'abc' WHEN 1 THEN '-3' WHEN 2 THEN '' ELSE value::VARCHAR END AS x FROM events)""")
def positive_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    x = F.when(k == 0, "abc").when(k == 1, "-3").when(k == 2, "").otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", positive(x).alias("number"))


@query("card_acceptable", """SELECT doc_id, len(w) AS n_words FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS w FROM documents)
WHERE len(w) BETWEEN 5 AND 80 AND NOT regexp_matches(text, '(?i)licensed under|copyright') AND NOT starts_with(lower(text), 'the ')""")
def card_acceptable(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    docs = table(spark, d, "documents").select("doc_id", "text", F.size(words).cast("long").alias("n_words"))
    noise = F.col("text").rlike("(?i)licensed under|copyright")
    return docs.where(F.col("n_words").between(5, 80) & ~noise & ~F.startswith(F.lower("text"), F.lit("the "))).select("doc_id", "n_words")


@query("free_text_filter_sorted", f"WITH {COMPANIES_SQL} SELECT company_id, ticker, name FROM companies WHERE contains(lower(concat_ws(' ', ticker, name, sector, country)), 'asia') ORDER BY market_cap DESC, company_id LIMIT 20")
def free_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "ticker", "name", "sector", "country"))
    return companies(spark, d).where(F.contains(text, F.lit("asia"))).orderBy(F.desc("market_cap"), "company_id").limit(20).select("company_id", "ticker", "name")
