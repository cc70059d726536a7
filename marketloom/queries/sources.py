"""Source shapes, uniqueness rules, chain lookups and status roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..operators.ordered import top_per_group
from ..operators.tolerance import within
from ..registry import query
from ..sources import shapes
from ..sources.shared import new_folder
from ..sources.tables import CANDLES_SQL, COMPANIES_SQL, candles, companies, table


@query("csv_scan_lines", "SELECT p_partkey AS id, p_brand AS brand, p_size AS size FROM part WHERE p_size > 10")
def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(",", F.col("p_partkey"), F.concat(F.lit("  "), F.col("p_brand"), F.lit(" ")), F.col("p_size"))
    rows = table(spark, d, "part").select(shapes.parsed_lines(line, "id bigint, brand string, size int").alias("r"))
    return rows.select("r.*").where("size > 10")


@query("facts_json_flatten", "SELECT s_suppkey AS company_id, 'Revenue' AS concept, DATE '2024-03-31' AS end_date, s_acctbal AS val FROM supplier WHERE s_suppkey % 3 <> 0")
def facts_json(spark: SparkSession, d: str) -> DataFrame:
    """Nested fact documents: two concepts and units, of which one counts; entries without a value are dropped."""
    entry = lambda v: F.array(F.struct(F.lit("2024-01-01").alias("start"), F.lit("2024-03-31").alias("end"), v.alias("val")))
    value = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal"))
    units = F.create_map(F.lit("USD"), entry(value), F.lit("EUR"), entry(F.lit(1.0)))
    body = F.create_map(F.lit("Revenue"), F.struct(units.alias("units")), F.lit("Other"), F.struct(units.alias("units")))
    docs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("company_id"), F.to_json(F.struct(body.alias("facts"))).alias("doc"))
    return shapes.flatten_facts(docs, "doc", ["Revenue"]).select("company_id", "concept", F.col("end").alias("end_date"), "val")


@query("struct_of_arrays_rows", "SELECT o_custkey, o_orderkey, o_orderdate::DATE AS filed FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1997-01-01'")
def struct_of_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Parallel arrays of one filer's forms, back to rows with the form filter and the cutoff."""
    recent = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.collect_list(F.struct("o_orderkey", F.to_date("o_orderdate").alias("filed"), F.col("o_orderpriority").alias("form"))).alias("s")
    )
    arrays = recent.select("o_custkey", *[F.col(f"s.{c}").alias(c) for c in ("o_orderkey", "filed", "form")])
    rows = shapes.unzip_arrays(arrays, ["o_custkey"], ["o_orderkey", "filed", "form"])
    return rows.where(F.col("form").isin("1-URGENT", "2-HIGH") & (F.col("filed") >= F.lit("1997-01-01").cast("date"))).select("o_custkey", "o_orderkey", "filed")


@query("lot_sizes_map", "SELECT l_suppkey, count(DISTINCT l_returnflag) AS flags, round(sum(l_quantity) FILTER (l_returnflag = 'R'), 4) AS r FROM lineitem GROUP BY 1")
def lot_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Wide columns (one per flag) to a map of the positive ones."""
    wide = table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).na.fill(0.0)
    m = shapes.wide_to_map(wide, "l_suppkey", ["A", "N", "R"])
    return m.select("l_suppkey", F.size("values").cast("long").alias("flags"), F.round(F.col("values")["R"], 4).alias("r"))


@query("futures_instrument_map", "SELECT p_brand AS underlying, p_size AS expiry, max(p_partkey) AS instrument FROM part WHERE p_type LIKE '%A%' GROUP BY 1, 2")
def instruments(spark: SparkSession, d: str) -> DataFrame:
    futures = table(spark, d, "part").where(F.col("p_type").like("%A%"))
    return futures.groupBy(F.col("p_brand").alias("underlying"), F.col("p_size").alias("expiry")).agg(F.max("p_partkey").alias("instrument"))


@query("universe_carry_sector", f"""WITH {COMPANIES_SQL}, previous AS (SELECT company_id, CASE WHEN company_id % 4 = 0 THEN '' ELSE 'old ' || sector END AS sector FROM companies WHERE company_id % 5 <> 0)
SELECT c.company_id, coalesce(nullif(p.sector, ''), c.sector) AS sector FROM companies c LEFT JOIN previous p USING (company_id)""")
def carry_sector(spark: SparkSession, d: str) -> DataFrame:
    c = companies(spark, d).select("company_id", "sector")
    old = F.when(F.col("company_id") % 4 == 0, "").otherwise(F.concat(F.lit("old "), F.col("sector")))
    previous = c.where("company_id % 5 <> 0").select("company_id", old.alias("old"))
    return c.join(previous, "company_id", "left").select("company_id", F.coalesce(F.nullif("old", F.lit("")), "sector").alias("sector"))


@query("universe_lowest_id_per_ticker", "SELECT p_brand AS ticker, min(p_partkey) AS cik, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1 ORDER BY 1 LIMIT 100")
def lowest_id(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").groupBy(F.col("p_brand").alias("ticker")).agg(F.min("p_partkey").alias("cik"), F.min_by("p_name", "p_partkey").alias("name"))
    return g.orderBy("ticker").limit(100)


@query("uniqueness_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("strike_lookup_rounded", "SELECT a.p_partkey AS id, min(b.p_partkey) AS quote FROM part a JOIN part b ON round(a.p_retailprice / 3, 4) = round(b.p_retailprice / 3, 4) GROUP BY 1")
def strike_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A lookup with tolerance as an equality of rounded keys."""
    k = F.round(F.col("p_retailprice") / 3, 4)
    parts = table(spark, d, "part")
    quotes = parts.groupBy(k.alias("k")).agg(F.min("p_partkey").alias("quote"))
    return parts.select(F.col("p_partkey").alias("id"), k.alias("k")).join(quotes, "k").select("id", "quote")


@query("csv_round_trip", f"WITH {COMPANIES_SQL} SELECT company_id, name, sector, round(market_cap / 1e6, 9) AS millions FROM companies WHERE company_id % 9 > 0")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A statement in millions, exported as headed CSV to the shared folder and read back with a fixed schema; rows without an id are left out there."""
    path = new_folder(spark, "csv")
    rows = companies(spark, d).select(F.when(F.col("company_id") % 9 > 0, F.col("company_id")).alias("company_id"), F.concat(F.lit("  "), "name", F.lit(" ")).alias("name"), "sector", F.col("market_cap").alias("millions"))
    shapes.write_csv(shapes.scaled_statement(rows, "millions", crore=False), path)
    back = shapes.read_csv(spark, path, "company_id LONG, name STRING, sector STRING, millions DOUBLE", {"company_id", "name"})
    return back.where("company_id IS NOT NULL").select("company_id", "name", "sector", F.round("millions", 9).alias("millions"))


@query("json_round_trip", f"WITH {COMPANIES_SQL} SELECT sector, count(*) AS n, list(ticker ORDER BY ticker)::VARCHAR[] AS tickers, round(sum(market_cap), 2) AS total FROM companies GROUP BY 1")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Reports with nested lists, exported as lines of JSON to the shared folder and read back."""
    path = new_folder(spark, "json")
    rows = companies(spark, d).groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("ticker")).alias("tickers"), F.sum("market_cap").alias("total"))
    shapes.write_json(rows, path)
    back = spark.read.schema("sector STRING, n LONG, tickers ARRAY<STRING>, total DOUBLE").json(path)
    return back.select("sector", "n", "tickers", F.round("total", 2).alias("total"))


TOLERANCE = 0.01


@query("strike_within_tolerance", f"""WITH s AS (SELECT p_partkey AS id, p_brand AS symbol, p_retailprice / 3 + p_partkey % 5 * 0.004 AS strike FROM part), q AS (SELECT p_partkey AS quote, p_brand AS symbol, p_retailprice / 3 AS listed FROM part)
SELECT id, arg_min(quote, (listed, quote)) AS quote, count(quote) AS quotes FROM s LEFT JOIN q ON s.symbol = q.symbol AND abs(strike - listed) <= {TOLERANCE} GROUP BY 1""")
def strike_within(spark: SparkSession, d: str) -> DataFrame:
    """The first listed strike within 0.01 of each wanted one of its symbol (least strike, then least id), and how many there are."""
    part, price = table(spark, d, "part"), F.col("p_retailprice") / 3
    wanted = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("symbol"), (price + F.col("p_partkey") % 5 * 0.004).alias("strike"))
    listed = part.select(F.col("p_partkey").alias("quote"), F.col("p_brand").alias("symbol"), price.alias("listed"))
    # equal strikes of a symbol meet as one row, so repeated ones don't multiply
    once = listed.groupBy("symbol", "listed").agg(F.min("quote").alias("quote"), F.count(F.lit(1)).alias("n"))
    met = within(wanted.select("symbol", "strike").distinct(), once, ["symbol"], "strike", "listed", TOLERANCE)
    found = met.groupBy("symbol", "strike").agg(F.min_by("quote", F.struct("listed", "quote")).alias("quote"), F.sum("n").alias("quotes"))
    return wanted.join(found, ["symbol", "strike"], "left").select("id", "quote", F.coalesce("quotes", F.lit(0).cast("long")).alias("quotes"))


@query("two_leg_quotes", """WITH q AS (SELECT l_suppkey AS ticker, date_trunc('month', l_shipdate)::DATE AS expiry, avg(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY 1, 2)
SELECT a.ticker, a.expiry, round(a.price - b.price, 6) AS spread FROM q a JOIN q b ON b.ticker = a.ticker + 1 AND b.expiry = a.expiry""")
def two_leg(spark: SparkSession, d: str) -> DataFrame:
    price = F.avg(F.col("l_extendedprice") / F.col("l_quantity"))
    q = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.trunc("l_shipdate", "month").alias("expiry")).agg(price.alias("price"))
    b = q.select((F.col("ticker") - 1).alias("ticker"), "expiry", F.col("price").alias("other"))
    return q.join(b, ["ticker", "expiry"]).select("ticker", "expiry", F.round(F.col("price") - F.col("other"), 6).alias("spread"))


@query("position_rejoin", f"WITH {COMPANIES_SQL}, r AS (SELECT company_id, row_number() OVER (PARTITION BY country ORDER BY company_id) - 1 AS position, country FROM companies) SELECT company_id, position FROM r WHERE position IN (0, 2)")
def position_rejoin(spark: SparkSession, d: str) -> DataFrame:
    """Model output by position joins its sources; a position that no table has (-1) matches nothing."""
    w = Window.partitionBy("country").orderBy("company_id")
    r = companies(spark, d).withColumn("position", F.row_number().over(w).cast("long") - 1)
    wanted = spark.createDataFrame([(0,), (2,), (-1,)], "position long")
    return r.join(F.broadcast(wanted), "position").select("company_id", "position")


@query("common_bars_not_marked", f"""WITH {CANDLES_SQL}, a AS (SELECT DISTINCT date_trunc('hour', ts) AS bar FROM candles WHERE symbol % 2 = 0), b AS (SELECT DISTINCT date_trunc('hour', ts) AS bar FROM candles WHERE symbol % 2 = 1),
m AS (SELECT DISTINCT date_trunc('hour', ts) AS bar FROM candles WHERE event_id % 50 = 0) SELECT bar FROM a JOIN b USING (bar) WHERE bar NOT IN (SELECT bar FROM m)""")
def common_bars(spark: SparkSession, d: str) -> DataFrame:
    bars = lambda c: candles(spark, d).where(c).select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bar")).distinct()
    return bars("symbol % 2 = 0").join(bars("symbol % 2 = 1"), "bar").join(bars("event_id % 50 = 0"), "bar", "left_anti")


@query("stale_and_fresh_merge", "SELECT l_suppkey, k, v FROM (SELECT l_suppkey, l_partkey AS k, arg_max(l_quantity, (l_returnflag = 'N', l_orderkey, l_linenumber, l_quantity)) AS v FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY k DESC) <= 50")
def stale_fresh(spark: SparkSession, d: str) -> DataFrame:
    """Fresh rows win over stale ones of the same key; the last fifty keys stay."""
    rank = F.struct(F.col("l_returnflag") == "N", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity"))
    m = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_partkey").alias("k")).agg(F.max_by("l_quantity", rank).alias("v"))
    return top_per_group(m, ["l_suppkey"], [F.desc("k")], 50).select("l_suppkey", "k", "v")


@query("log_line_progress", r"""SELECT event_id, regexp_extract(line, 'done=([0-9]+)/([0-9]+)', 1)::BIGINT AS done, round(regexp_extract(line, 'done=([0-9]+)/([0-9]+)', 1)::DOUBLE / regexp_extract(line, 'done=([0-9]+)/([0-9]+)', 2)::DOUBLE * 100, 6) AS percent
FROM (SELECT event_id, 'built ' || event_type || ' done=' || event_id % 90 || '/' || (90 + event_id % 7) AS line FROM events)""")
def log_progress(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    line = F.concat(F.lit("built "), F.col("event_type"), F.lit(" done="), (k % 90).cast("string"), F.lit("/"), (90 + k % 7).cast("string"))
    part = lambda i: F.regexp_extract("line", "done=([0-9]+)/([0-9]+)", i)
    rows = table(spark, d, "events").select("event_id", line.alias("line"))
    return rows.select("event_id", part(1).cast("long").alias("done"), F.round(ratio(part(1).cast("double"), part(2).cast("double")) * 100, 6).alias("percent"))


@query("throughput_eta", "SELECT event_type, round(count(*) / (epoch(max(ts) - min(ts)) / 3600), 4) AS per_hour, round(500 / (count(*) / (epoch(max(ts) - min(ts)) / 3600)), 4) AS eta_hours FROM events GROUP BY 1")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("ts").cast("timestamp").cast("double")
    rate = F.count(F.lit(1)) / ((F.max(s) - F.min(s)) / 3600)
    return table(spark, d, "events").groupBy("event_type").agg(F.round(rate, 4).alias("per_hour"), F.round(500 / rate, 4).alias("eta_hours"))


@query("business_days_ahead", "SELECT o_orderkey, (SELECT min(x)::DATE FROM (SELECT unnest([o_orderdate::DATE + 1, o_orderdate::DATE + 2, o_orderdate::DATE + 3]) AS x) WHERE isodow(x) <= 5) AS next_day FROM orders")
def business_days(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    ahead = F.filter(F.array(*[F.date_add(day, k) for k in (1, 2, 3)]), lambda x: F.weekday(x) < 5)
    return table(spark, d, "orders").select("o_orderkey", F.array_min(ahead).alias("next_day"))


@query("adaptive_lookback_z", """WITH e AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v, 10 + user_id % 30 AS n FROM events GROUP BY 1), t AS (SELECT user_id, v[-least(n, len(v)):] AS w FROM e)
SELECT user_id, round((w[-1] - list_avg(w)) / nullif(list_stddev_samp(w), 0), 5) AS z FROM t WHERE len(w) >= 2""")
def adaptive_z(spark: SparkSession, d: str) -> DataFrame:
    """z of the last value over a lookback that each symbol sets for itself."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, d, "events").withColumn("k", F.row_number().over(w)).where(F.col("k") <= 10 + F.col("user_id") % 30)
    g = rows.groupBy("user_id").agg(F.min_by("value", "k").alias("x"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 2").select("user_id", F.round(ratio(F.col("x") - F.col("m"), F.col("s")), 5).alias("z"))


@query("forecast_vs_market", "SELECT l_orderkey, l_linenumber, CASE WHEN gap > cut THEN 'expensive' WHEN gap < -cut THEN 'cheap' ELSE 'in_line' END AS verdict FROM (SELECT l_orderkey, l_linenumber, (l_discount - l_tax) * 100 AS gap, greatest(2.0, 1.5 * (l_quantity % 3)) AS cut FROM lineitem)")
def forecast_market(spark: SparkSession, d: str) -> DataFrame:
    gap, cut = (F.col("l_discount") - F.col("l_tax")) * 100, F.greatest(F.lit(2.0), 1.5 * (F.col("l_quantity") % 3))
    verdict = F.when(gap > cut, "expensive").when(gap < -cut, "cheap").otherwise("in_line")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", verdict.alias("verdict"))


@query("exceedance_quantiles", """WITH v AS (SELECT p_brand AS symbol, 50 + 2.0::DOUBLE * p_size AS x, 1 - p_size / 51.0::DOUBLE AS y FROM part GROUP BY 1, 2, 3),
b AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM v WINDOW w AS (PARTITION BY symbol ORDER BY x))
SELECT symbol, q, round(x + (y - q) / (y - y1) * (x1 - x), 6) AS level FROM b CROSS JOIN (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS q) WHERE y >= q AND y1 < q""")
def exceedance(spark: SparkSession, d: str) -> DataFrame:
    """Levels at which a piecewise-linear exceedance curve crosses given probabilities."""
    v = table(spark, d, "part").select(F.col("p_brand").alias("symbol"), (50 + 2.0 * F.col("p_size")).alias("x"), (1 - F.col("p_size") / 51.0).alias("y")).distinct()
    w = Window.partitionBy("symbol").orderBy("x")
    b = v.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w)}).withColumn("q", F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.75)))))
    return b.where("y >= q AND y1 < q").select("symbol", "q", F.round(F.expr("x + (y - q) / (y - y1) * (x1 - x)"), 6).alias("level"))
