"""Market rules: expiries, spots, preferred facts, language gates, peer metrics, paper pairs, reconstructed volatilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import options as opt
from ..functions.numeric import ratio, yoy
from ..registry import query
from ..sources.tables import table
from .facts import QUARTERS_SQL, YOY_SQL, quarters, year_before
from .options import QUOTED_SQL, quoted
from .pairs import LOTS_SQL, hedge_lots


def time_to_expiry(expiry: Column, as_of: Column) -> Column:
    """Years of 365.25 days from ``as_of`` to the close of the expiry day at 15:30; null once it is over."""
    of_day = F.hour(as_of) * 3600 + F.minute(as_of) * 60 + F.second(as_of)
    seconds = F.datediff(expiry, F.to_date(as_of)).cast("long") * 86400 + (15 * 3600 + 30 * 60) - of_day
    return F.when(seconds > 0, seconds / (365.25 * 86400))


@query("time_to_expiry", """SELECT o_orderkey, round(CASE WHEN s > 0 THEN s / (365.25::DOUBLE * 86400) END, 9) AS years
FROM (SELECT o_orderkey, date_diff('second', TIMESTAMP '1995-06-15 10:15:20', o_orderdate::DATE::TIMESTAMP + INTERVAL 15 HOUR + INTERVAL 30 MINUTE) AS s FROM orders)""")
def expiry_years(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit("1995-06-15 10:15:20").cast("timestamp_ntz")
    return table(spark, d, "orders").select("o_orderkey", F.round(time_to_expiry(F.to_date("o_orderdate"), as_of), 9).alias("years"))


@query("median_spot", "SELECT p_brand AS symbol, round(quantile_cont(p_retailprice - 1000, 0.5) FILTER (p_retailprice > 1000), 6) AS spot FROM part GROUP BY 1")
def median_spot(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("p_retailprice") - 1000
    spot = F.percentile(F.when(value > 0, value), F.lit(0.5))
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.round(spot, 6).alias("spot"))


CONCEPTS = ("2-HIGH", "1-URGENT", "5-LOW")


@query("preferred_concept", f"""SELECT company_id, period, concept, value FROM (SELECT o_custkey AS company_id, date_trunc('quarter', o_orderdate)::DATE AS period, o_orderpriority AS concept, o_orderdate::DATE AS filed, o_totalprice AS value, o_orderkey,
  list_position({list(CONCEPTS)}, o_orderpriority) AS preference FROM orders) WHERE preference IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_id, period ORDER BY preference, filed DESC, value DESC, o_orderkey DESC) = 1""")
def preferred_concept(spark: SparkSession, d: str) -> DataFrame:
    """The first concept of a list that a period has, and of its facts the last filed, then the largest: one aggregation."""
    place = F.array_position(F.array(*map(F.lit, CONCEPTS)), F.col("o_orderpriority"))
    rows = table(spark, d, "orders").withColumn("place", place).where("place > 0")
    rank = F.struct(-F.col("place"), F.to_date("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))
    best = F.max_by(F.struct(F.col("o_orderpriority").alias("concept"), F.col("o_totalprice").alias("value")), rank)
    g = rows.groupBy(F.col("o_custkey").alias("company_id"), F.trunc("o_orderdate", "quarter").alias("period")).agg(best.alias("f"))
    return g.select("company_id", "period", "f.concept", "f.value")


PERIODS_SQL = f"""{QUARTERS_SQL}, periods AS (SELECT company_id, start_date + k AS start_date, end_date + k AS end_date, CASE WHEN company_id % 5 = 0 THEN NULL WHEN (year(end_date) + k) % 2 = 0 THEN 'even' ELSE 'odd' END AS period, revenue FROM quarters, (SELECT unnest([0, 11]) AS k))"""


@query("facts_yoy_same_period", f"""WITH {PERIODS_SQL} SELECT c.company_id, c.end_date, p.end_date AS p_end, round((c.revenue - p.revenue) / nullif(abs(p.revenue), 0) * 100, 4) AS growth FROM periods c JOIN periods p ON p.company_id = c.company_id AND abs(p.end_date - (c.end_date - 365)) <= 21
QUALIFY row_number() OVER (PARTITION BY c.company_id, c.end_date ORDER BY (c.period IS NOT NULL AND c.period IS DISTINCT FROM p.period), abs(p.end_date - (c.end_date - 365)), p.end_date) = 1""")
def yoy_same_period(spark: SparkSession, d: str) -> DataFrame:
    """The period a year before, of the same fiscal label where there is one within the tolerance."""
    q = quarters(spark, d).select("company_id", "start_date", "end_date", "revenue").withColumn("k", F.explode(F.array(F.lit(0), F.lit(11))))
    label = F.when(F.col("company_id") % 5 == 0, None).when((F.year("end_date") + F.col("k")) % 2 == 0, "even").otherwise("odd")
    q = q.withColumn("period", label).withColumns({c: F.date_add(c, F.col("k")) for c in ("start_date", "end_date")}).drop("k")
    return year_before(q, period="period").select("company_id", "end_date", "p_end", F.round(yoy(F.col("revenue"), F.col("p_revenue")), 4).alias("growth"))


@query("growth_condition_ops", f"""WITH {YOY_SQL}, g AS (SELECT company_id, end_date, p_revenue, (revenue - p_revenue) / abs(p_revenue) * 100 AS growth FROM pairs),
m AS (SELECT *, CASE company_id % 3 WHEN 0 THEN growth >= 5 WHEN 1 THEN growth <= 5 ELSE abs(growth - 5) <= 0.5 END AS met FROM g)
SELECT company_id, end_date, CASE WHEN p_revenue < 0 THEN 'partial' WHEN met THEN 'met' ELSE 'not_met' END AS status, CASE WHEN p_revenue < 0 THEN 0.5 WHEN met THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM m""")
def growth_ops(spark: SparkSession, d: str) -> DataFrame:
    """At least, at most, or equal within half a point."""
    g, way = yoy(F.col("revenue"), F.col("p_revenue")), F.col("company_id") % 3
    met = F.when(way == 0, g >= 5).when(way == 1, g <= 5).otherwise(F.abs(g - 5) <= 0.5)
    partial = F.col("p_revenue") < 0
    return year_before(quarters(spark, d)).select(
        "company_id", "end_date", F.when(partial, "partial").when(met, "met").otherwise("not_met").alias("status"), F.when(partial, 0.5).when(met, 1.0).otherwise(0.0).alias("score")
    )


@query("lookback_days", """SELECT c_custkey, spec, greatest(7, ceil(ceil(least(greatest(n, 35), 70) / per_day) * 7 / 5) + 5)::BIGINT AS days
FROM (SELECT c_custkey, c_custkey % 120 AS n, s.spec, s.per_day FROM customer, (VALUES ('1h', 7.0::DOUBLE), ('1d', 1.0::DOUBLE), ('15m', 25.0::DOUBLE)) s(spec, per_day))""")
def lookback(spark: SparkSession, d: str) -> DataFrame:
    """Calendar days to request for a bounded number of candles of an interval."""
    specs = F.explode(F.create_map(*[F.lit(x) for kv in (("1h", 7.0), ("1d", 1.0), ("15m", 25.0)) for x in kv])).alias("spec", "per_day")
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 120).alias("n"), specs)
    count = F.least(F.greatest(F.col("n"), F.lit(35)), F.lit(70))
    days = F.ceil(F.ceil(count / F.col("per_day")) * 7 / F.lit(5.0)) + 5
    return rows.select("c_custkey", "spec", F.greatest(F.lit(7).cast("long"), days).alias("days"))


#: Stems of adverse language and phrases of causal language.
ADVERSE = "depend|concentrat|constraint|risk|reliance|rely|expos|shortage|competition|fluctuat|advers|sensitive|subject to|limited|uncertain|declin"
CAUSAL = "due to|driven by|because|attributable to|resulted from|reflecting"
#: Texts are lower-cased first; a word begins where no letter, digit or underscore stands before.
ADVERSE_RE, CAUSAL_RE = rf"(^|[^a-z0-9_])({ADVERSE})", rf"(^|[^a-z0-9_])({CAUSAL})($|[^a-z0-9_])"


def _whole_words(alternatives: str, *, end: bool) -> str:
    """What ``ADVERSE_RE`` and ``CAUSAL_RE`` match, with the alternatives grouped by their first letter, so a word is tried against few of them."""
    first: dict[str, list[str]] = {}
    for word in alternatives.split("|"):
        first.setdefault(word[0], []).append(word[1:])
    grouped = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(first.items()))
    return rf"(?<![a-z0-9_])(?=[{''.join(sorted(first))}])(?:{grouped})" + ("(?![a-z0-9_])" if end else "")


@query("language_gates", f"SELECT doc_id, regexp_matches(t, '{ADVERSE_RE}') AS adverse, regexp_matches(t, '{CAUSAL_RE}') AS causal FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def language_gates(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("text")
    return table(spark, d, "documents").select("doc_id", t.rlike(_whole_words(ADVERSE, end=False)).alias("adverse"), t.rlike(_whole_words(CAUSAL, end=True)).alias("causal"))


#: Cues of a business description and their weights, and the keywords of industry labels in order.
ACTIVITY = ("engaged in", "business of", "operates in", "operates as", "primarily engaged", "segments:", "manufactures", "provides", "specializes", "develops")
GENERIC = ("gdp", "inflation", "economy", "sector forms", "is forecast", "is projected", "shareholders", "total income", "total expenditure")
LABELS = {
    "Infrastructure & construction": ("infrastructure", "construction", "epc", "contracting"),
    "Hotels & hospitality": ("hotel", "hospitality", "resort"),
    "Financial services": ("banking", "lending", "finance", "insurance"),
    "Pharmaceuticals": ("pharma", "pharmaceutical", "drug", "formulation"),
    "Information technology": ("software", "information technology", "digital services"),
    "Manufacturing": ("manufactur", "industrial products", "factory"),
    "Real estate": ("real estate", "residential development", "commercial development"),
    "Power & energy": ("power generation", "renewable energy", "electricity"),
    "Consumer products": ("consumer products", "fmcg", "retail"),
}
NO_LABEL = "Business-activity peers"
_HAS = lambda words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"
_COUNT = lambda words: "(" + " + ".join(f"contains(t, '{w}')::INT" for w in words) + ")"


@query("business_cards", f"""WITH c AS (SELECT doc_id, text, lower(text) || CASE doc_id % 4 WHEN 0 THEN ' is engaged in banking and retail' WHEN 1 THEN ' total income of a hotel' ELSE '' END AS t FROM documents),
l AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {_HAS(w)} THEN '{n}' END" for n, w in LABELS.items())}], lambda x: x IS NOT NULL)[1:2] AS labels FROM c)
SELECT doc_id, round(4.0 * {_COUNT(ACTIVITY)} - 3.0 * {_COUNT(GENERIC)} + doc_id % 4 + least(length(text), 240) / 240.0::DOUBLE, 6) AS priority, CASE WHEN len(labels) > 0 THEN array_to_string(labels, ' / ') ELSE '{NO_LABEL}' END AS label FROM l""")
def business_cards(spark: SparkSession, d: str) -> DataFrame:
    """Priority of a card as a description of a business, and the first two industry labels that its words suggest."""
    k = F.col("doc_id") % 4
    t = F.concat(F.lower("text"), F.when(k == 0, " is engaged in banking and retail").when(k == 1, " total income of a hotel").otherwise(""))
    cards = table(spark, d, "documents").select("doc_id", "text", t.alias("t"))
    has = lambda w: F.contains("t", F.lit(w))
    count = lambda words: sum((has(w).cast("int") for w in words), F.lit(0))
    some = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("t"), w))
    labels = F.slice(F.array_compact(F.array(*[F.when(some(words), name) for name, words in LABELS.items()])), 1, 2)
    priority = 4.0 * count(ACTIVITY) - 3.0 * count(GENERIC) + k + F.least(F.length("text"), F.lit(240)) / 240.0
    return cards.select("doc_id", F.round(priority, 6).alias("priority"), F.when(F.size(labels) > 0, F.array_join(labels, " / ")).otherwise(NO_LABEL).alias("label"))


@query("peer_metrics", """SELECT p_partkey, round(CASE WHEN high > 0 THEN (price / high - 1) * 100 END, 6) AS price_vs_52w_high_percent, round(CASE WHEN average > 0 THEN volume / average END, 6) AS relative_volume
FROM (SELECT p_partkey, p_retailprice AS price, CASE WHEN p_partkey % 11 = 0 THEN -1.0 ELSE p_retailprice + 50 * (p_partkey % 7) END::DOUBLE AS high, p_size::DOUBLE AS volume, (p_partkey % 13)::DOUBLE AS average FROM part)""")
def peer_metrics(spark: SparkSession, d: str) -> DataFrame:
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    high, average = F.when(k % 11 == 0, -1.0).otherwise(price + 50 * (k % 7)), (k % 13).cast("double")
    return table(spark, d, "part").select(
        "p_partkey", F.round(F.when(high > 0, (price / high - 1) * 100), 6).alias("price_vs_52w_high_percent"), F.round(F.when(average > 0, F.col("p_size") / average), 6).alias("relative_volume")
    )


@query("card_documents", """SELECT doc_id AS card_id, lang AS card_type, round((doc_id % 9973) / 9973.0::DOUBLE, 4) AS similarity, md5(left(text, 600)) AS excerpt FROM documents""")
def card_documents(spark: SparkSession, d: str) -> DataFrame:
    """A match as one nested document: similarity to four places, the excerpt cut to 600 characters."""
    body = F.struct(
        F.col("doc_id").alias("card_id"), F.col("lang").alias("card_type"), F.round((F.col("doc_id") % 9973) / 9973.0, 4).alias("similarity"), F.substring("text", 1, 600).alias("source_excerpt")
    )
    cards = table(spark, d, "documents").select(body.alias("card"))
    return cards.select("card.card_id", "card.card_type", "card.similarity", F.md5("card.source_excerpt").alias("excerpt"))


@query("synthetic_start_dates", f"""WITH {QUARTERS_SQL}, e AS (SELECT company_id, 'QUARTERLY' AS form, end_date, sum(revenue) AS revenue, sum(income) AS income FROM quarters GROUP BY 1, 3 UNION ALL
 SELECT company_id, 'ANNUAL', max(end_date), sum(revenue), sum(income) FROM quarters GROUP BY company_id, year(end_date)),
u AS (UNPIVOT e ON revenue, income INTO NAME concept VALUE value)
SELECT company_id, form, concept, end_date - CASE form WHEN 'ANNUAL' THEN 364 ELSE 89 END AS start_date, end_date, year(end_date) AS fiscal_year, CASE form WHEN 'ANNUAL' THEN 'FY' END AS fiscal_period,
 sha1(company_id || '|' || form || '|' || end_date) AS accession, round(value, 6) AS value FROM u""")
def synthetic_starts(spark: SparkSession, d: str) -> DataFrame:
    """Statement rows as facts: the start follows from the form (364 or 89 days), the key from ticker, form and end."""
    q = quarters(spark, d)
    sums = [F.sum(c).alias(c) for c in ("revenue", "income")]
    each = q.groupBy("company_id", "end_date").agg(*sums).withColumn("form", F.lit("QUARTERLY"))
    year = q.groupBy("company_id", F.year("end_date").alias("y")).agg(F.max("end_date").alias("end_date"), *sums).drop("y").withColumn("form", F.lit("ANNUAL"))
    facts = each.unionByName(year).unpivot(["company_id", "form", "end_date"], ["revenue", "income"], "concept", "value")
    annual = F.col("form") == "ANNUAL"
    return facts.select(
        "company_id", "form", "concept", F.date_sub("end_date", F.when(annual, 364).otherwise(89)).alias("start_date"), "end_date", F.year("end_date").cast("long").alias("fiscal_year"),
        F.when(annual, "FY").alias("fiscal_period"), F.sha1(F.concat_ws("|", "company_id", "form", "end_date").cast("binary")).alias("accession"), F.round("value", 6).alias("value"),
    )


def pair_mark(df: DataFrame) -> DataFrame:
    """``df`` (entry and current prices and units of both legs) with each leg's profit, their sum and its share of the entry notional."""
    long = F.col("long_units") * (F.col("long_price") - F.col("entry_long_price"))
    short = F.col("short_units") * (F.col("entry_short_price") - F.col("short_price"))
    notional = F.col("long_units") * F.col("entry_long_price") + F.col("short_units") * F.col("entry_short_price")
    percent = F.when(notional > 0, (long + short) / notional * 100).otherwise(0.0)
    gross = F.col("long_units") * F.col("long_price") + F.col("short_units") * F.col("short_price")
    two = lambda c, n: F.round(c, 2).alias(n)
    return df.select("*", two(long, "long_pnl"), two(short, "short_pnl"), two(long + short, "total_pnl"), two(percent, "return_percent"), two(gross, "current_gross_notional"))


@query("pair_paper_mark", f"""WITH {LOTS_SQL}, h AS (SELECT a, b, coalesce(arg_min(m, (contracts, error, m)) FILTER (error <= 0.15), arg_min(m, (error, contracts, m))) AS la, coalesce(arg_min(n, (contracts, error, m)) FILTER (error <= 0.15), arg_min(n, (error, contracts, m))) AS lb FROM g GROUP BY 1, 2),
e AS (SELECT h.a, h.b, x.price AS pa, y.price AS pb, la * x.lot AS ua, lb * y.lot AS ub, x.price * (1 + (h.a % 5 - 2) / 100.0::DOUBLE) AS qa, y.price * (1 + (h.b % 7 - 3) / 100.0::DOUBLE) AS qb, h.a % 2 = 0 AS long_a FROM h JOIN p x ON x.k = h.a JOIN p y ON y.k = h.b),
l AS (SELECT a, b, CASE WHEN long_a THEN ua * (qa - pa) ELSE ub * (qb - pb) END AS lp, CASE WHEN long_a THEN ub * (pb - qb) ELSE ua * (pa - qa) END AS sp, ua * pa + ub * pb AS notional, ua * qa + ub * qb AS gross FROM e)
SELECT a, b, round(lp, 2) AS long_pnl, round(sp, 2) AS short_pnl, round(lp + sp, 2) AS total_pnl, round((lp + sp) / notional * 100, 2) AS return_percent, round(gross, 2) AS current_gross_notional FROM l""")
def paper_mark(spark: SparkSession, d: str) -> DataFrame:
    """Hedged lots of neighbouring contracts, entered at one price and marked at another."""
    k = F.col("k")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price"), (25 * (1 + F.col("p_partkey") % 8)).alias("lot"))
    a = p.select(k.alias("a"), F.col("price").alias("pa"), F.col("lot").alias("lot_a"), (F.col("price") * (1 + (k % 5 - 2) / 100.0)).alias("qa"))
    b = p.select(k.alias("b"), F.col("price").alias("pb"), F.col("lot").alias("lot_b"), (F.col("price") * (1 + (k % 7 - 3) / 100.0)).alias("qb"))
    e = hedge_lots(spark, d).join(a, "a").join(b, "b").withColumns({"ua": F.col("lots_a") * F.col("lot_a"), "ub": F.col("lots_b") * F.col("lot_b")})
    long_a = F.col("a") % 2 == 0
    pick = lambda x, y, n: F.when(long_a, F.col(x)).otherwise(F.col(y)).alias(n)
    legs = e.select(
        "a", "b", pick("ua", "ub", "long_units"), pick("ub", "ua", "short_units"), pick("pa", "pb", "entry_long_price"), pick("pb", "pa", "entry_short_price"),
        pick("qa", "qb", "long_price"), pick("qb", "qa", "short_price"),
    )
    return pair_mark(legs).select("a", "b", "long_pnl", "short_pnl", "total_pnl", "return_percent", "current_gross_notional")


@query("leg_iv_reconstruction", f"""WITH RECURSIVE {QUOTED_SQL}, q AS (SELECT id, s, strike, t, r, sg, premium, CASE WHEN id % 3 = 0 THEN of_vol END AS saved FROM quoted), {opt.implied_sql('q', 'saved')}
SELECT id, round(coalesce(saved, vol) * 100, 3) AS iv_percent, CASE WHEN saved IS NOT NULL THEN 'saved' WHEN vol IS NOT NULL THEN 'reconstructed' END AS iv_source FROM implied""")
def leg_iv(spark: SparkSession, d: str) -> DataFrame:
    """Saved volatilities stay; missing ones follow from the quote and the underlying that were saved with the mark, where these tell them."""
    s, k, t, r, v = (F.col(c) for c in ("s", "strike", "t", "r", "vol"))
    legs = quoted(spark, d).withColumn("saved", F.when(F.col("id") % 3 == 0, v))
    found = opt.implied_vol(F.col("premium"), s, k, t, r, F.col("is_call"))
    source = F.when(F.col("saved").isNotNull(), "saved").when(found.isNotNull(), "reconstructed")
    return legs.select("id", F.round(F.coalesce("saved", found) * 100, 3).alias("iv_percent"), source.alias("iv_source"))


@query("sd_quartiles", """WITH r AS (SELECT l_suppkey, l_discount - l_tax AS x FROM lineitem), s AS (SELECT l_suppkey, avg(x) AS m, stddev_samp(x) AS sd FROM r GROUP BY 1)
SELECT l_suppkey, round(quantile_cont(x, 0.25), 6) + 0.0 AS p25, round(quantile_cont(x, 0.75), 6) + 0.0 AS p75, round(avg((abs(x - m) <= 3 * sd)::INT), 6) AS within_3 FROM r JOIN s USING (l_suppkey) GROUP BY 1""")
def sd_quartiles(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_discount") - F.col("l_tax")).alias("x"))
    s = r.groupBy("l_suppkey").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"), F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("p"))
    inside = (F.abs(F.col("x") - F.col("m")) <= 3 * F.col("sd")).cast("int")
    g = r.join(s, "l_suppkey").groupBy("l_suppkey").agg(F.first("p").alias("p"), F.avg(inside).alias("w"))
    near = lambda i: F.round(F.col("p")[i], 6) + 0.0
    return g.select("l_suppkey", near(0).alias("p25"), near(1).alias("p75"), F.round("w", 6).alias("within_3"))


# Scored forecasts that a verdict needs, and the percents that it asks of variance, improvement and direction.
EVIDENCE, VARIANCE, IMPROVEMENT, DIRECTION = 100, 95, 10, 55
VERDICTS = ("Collecting evidence", "Review FPCA representation", "VAR is not adding value", "Promising forecasting edge", "Weak or inconclusive edge")


def evaluation_report(records: DataFrame, group: str) -> DataFrame:
    """By group: averages that skip nulls, improvement, win rate, covered symbols and a verdict.

    records: ``group``, symbol, status (scored or pending), model_rmse, baseline_rmse, explained, reconstruction and direction.  Averages of a group
    without values are null, as is the win rate without scored forecasts; a record without both errors is no win.
    """
    scored = F.col("status") == "scored"
    of = lambda c: F.avg(F.when(scored, F.col(c)))
    g = records.groupBy(group).agg(
        F.count_if(scored).alias("scored"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_distinct("symbol").alias("symbols"),
        of("model_rmse").alias("model_rmse"),
        of("baseline_rmse").alias("baseline_rmse"),
        of("direction").alias("direction"),
        F.avg("explained").alias("explained"),
        F.avg("reconstruction").alias("reconstruction"),
        F.count_if(scored & (F.col("model_rmse") < F.col("baseline_rmse"))).alias("wins"),
    )
    g = g.withColumn("improvement", ratio(F.col("baseline_rmse") - F.col("model_rmse"), F.col("baseline_rmse")) * 100)
    edge = (F.col("improvement") >= IMPROVEMENT) & (F.coalesce("direction", F.lit(0.0)) >= DIRECTION)
    rules = (F.col("scored") < EVIDENCE, F.col("explained") < VARIANCE, F.col("improvement") <= 0, edge)
    verdict = F.lit(VERDICTS[-1])
    for rule, name in reversed(list(zip(rules, VERDICTS, strict=False))):
        verdict = F.when(rule, name).otherwise(verdict)
    return g.withColumns({"win_rate": 100 * F.col("wins") / F.nullif("scored", F.lit(0)), "verdict": verdict}).drop("wins")


RECORDS_SQL = """rec AS (SELECT l_suppkey AS symbol, s_nationkey AS market, date_trunc('month', l_shipdate) AS d, CASE WHEN count(*) >= 3 THEN 'scored' ELSE 'pending' END AS status, 100 * sqrt(avg(pow(l_tax - l_discount, 2))) AS model_rmse,
 CASE WHEN l_suppkey % 13 > 0 THEN 100 * sqrt(avg(pow(l_quantity % 10 / 100 - l_discount, 2))) END AS baseline_rmse, 100 * avg((l_tax > l_discount)::INT) FILTER (l_quantity > 25) AS direction,
 CASE WHEN l_suppkey % 7 > 0 THEN 91 + l_suppkey % 9 END::DOUBLE AS explained, 10 * avg(l_tax) AS reconstruction FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey, s_nationkey, date_trunc('month', l_shipdate))"""


@query("iv_evaluation_report", f"""WITH {RECORDS_SQL}, g AS (SELECT market, count(*) FILTER (status = 'scored') AS scored, count(*) FILTER (status = 'pending') AS pending, count(DISTINCT symbol) AS symbols, avg(model_rmse) FILTER (status = 'scored') AS model_rmse,
 avg(baseline_rmse) FILTER (status = 'scored') AS baseline_rmse, avg(direction) FILTER (status = 'scored') AS direction, avg(explained) AS explained, avg(reconstruction) AS reconstruction, count(*) FILTER (status = 'scored' AND model_rmse < baseline_rmse) AS wins FROM rec GROUP BY 1),
i AS (SELECT *, (baseline_rmse - model_rmse) / nullif(baseline_rmse, 0) * 100 AS improvement FROM g)
SELECT market, scored, pending, symbols, round(model_rmse, 5) AS model_rmse, round(baseline_rmse, 5) AS baseline_rmse, round(direction, 5) AS direction, round(explained, 5) AS explained, round(reconstruction, 5) AS reconstruction, round(improvement, 5) AS improvement,
 round(100.0 * wins / nullif(scored, 0), 5) AS win_rate, CASE WHEN scored < {EVIDENCE} THEN '{VERDICTS[0]}' WHEN explained < {VARIANCE} THEN '{VERDICTS[1]}' WHEN improvement <= 0 THEN '{VERDICTS[2]}' WHEN improvement >= {IMPROVEMENT} AND coalesce(direction, 0) >= {DIRECTION} THEN '{VERDICTS[3]}' ELSE '{VERDICTS[4]}' END AS verdict FROM i""")
def iv_evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """Monthly forecasts of every supplier, reported by nation."""
    items, owner = table(spark, d, "lineitem"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("market"))
    c, s = F.col, F.col("l_suppkey")
    off = lambda x: 100 * F.sqrt(F.avg(F.pow(x - c("l_discount"), 2.0)))
    g = items.groupBy(s.alias("symbol"), F.trunc("l_shipdate", "month").alias("d")).agg(
        F.when(F.count(F.lit(1)) >= 3, "scored").otherwise("pending").alias("status"),
        off(c("l_tax")).alias("model_rmse"),
        off(c("l_quantity") % 10 / 100).alias("base"),
        (100 * F.avg(F.when(c("l_quantity") > 25, (c("l_tax") > c("l_discount")).cast("int")))).alias("direction"),
        (10 * F.avg("l_tax")).alias("reconstruction"),
    )
    k = c("symbol")
    records = g.join(owner, "symbol").withColumns({"baseline_rmse": F.when(k % 13 > 0, c("base")), "explained": F.when(k % 7 > 0, 91 + k % 9).cast("double")})
    out = evaluation_report(records, "market")
    rounded = ("model_rmse", "baseline_rmse", "direction", "explained", "reconstruction", "improvement", "win_rate")
    return out.select("market", "scored", "pending", "symbols", *[F.round(x, 5).alias(x) for x in rounded], "verdict")
