"""Composite reports: pair suggestions, futures plans, rolling validation, strategies, distributions, catalysts, news eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import cosine, ratio, with_engle_granger_p
from ..operators.ordered import top_per_group
from ..registry import query
from ..sources.tables import MONTHLY_SQL, monthly_prices, table
from .options import CHAIN_SQL, chain
from .pairs import ADF_SQL, FORMATION, P_SQL, Z_WINDOW, screened

SUGGEST_SQL = f"""{ADF_SQL}, pv AS (SELECT a, b, t, {P_SQL} AS p FROM adf), ar AS (SELECT a, b, regr_slope(s, s1) AS phi FROM lagged WHERE s1 IS NOT NULL GROUP BY 1, 2),
lz AS (SELECT a, b, t, beta, s, (s - avg(s) OVER w) / nullif(stddev_samp(s) OVER w, 0) AS z FROM spread WINDOW w AS (PARTITION BY a, b ORDER BY t ROWS BETWEEN {Z_WINDOW - 1} PRECEDING AND CURRENT ROW)),
sug AS (SELECT pv.a, pv.b, p, z, beta, CASE WHEN phi > 0 AND phi < 1 THEN ln(0.5) / ln(phi) END AS half_life, CASE WHEN z <= -1 THEN 'long_spread' WHEN z >= 1 THEN 'short_spread' ELSE 'watch' END AS signal
 FROM pv JOIN ar USING (a, b) JOIN lz ON lz.a = pv.a AND lz.b = pv.b AND lz.t = {FORMATION})"""


def suggestions(spark: SparkSession, d: str) -> DataFrame:
    """p-value, half-life, last z and signal of each pair."""
    phi = F.col("phi")
    signal = F.when(F.col("z") <= -1, "long_spread").when(F.col("z") >= 1, "short_spread").otherwise("watch")
    life = F.when((phi > 0) & (phi < 1), F.log(F.lit(0.5)) / F.ln(phi))
    both = with_engle_granger_p(screened(spark, d, "adf_t", "phi", "z", "beta").where("adf_t IS NOT NULL"), "adf_t")
    return both.withColumns({"half_life": life, "signal": signal})


@query("pair_suggestions", f"WITH {SUGGEST_SQL} SELECT a, b, signal, round(z, 5) AS z, round(half_life, 4) AS half_life, round(p, 6) AS p FROM sug WHERE half_life BETWEEN 0.01 AND 90 ORDER BY signal = 'watch', round(abs(z), 9) DESC, half_life, a, b LIMIT 200")
def pair_suggestions(spark: SparkSession, d: str) -> DataFrame:
    ok = suggestions(spark, d).where(F.col("half_life").between(0.01, 90))
    best = ok.orderBy(F.col("signal") == "watch", F.desc(F.round(F.abs("z"), 9)), "half_life", "a", "b").limit(200)
    return best.select("a", "b", "signal", F.round("z", 5).alias("z"), F.round("half_life", 4).alias("half_life"), F.round("p", 6).alias("p"))


@query("pair_admission", f"WITH {SUGGEST_SQL} SELECT a, b FROM sug WHERE p <= 0.5 AND beta > 0 AND half_life BETWEEN 0.01 AND 90 AND isfinite(z)")
def admission(spark: SparkSession, d: str) -> DataFrame:
    return suggestions(spark, d).where("p <= 0.5 AND beta > 0 AND half_life BETWEEN 0.01 AND 90 AND z IS NOT NULL").select("a", "b")


@query("rolling_validation", f"""WITH {MONTHLY_SQL}, r AS (SELECT ticker, d, ln(close) AS x, row_number() OVER (PARTITION BY ticker ORDER BY d) AS t, count(*) OVER (PARTITION BY ticker) AS n FROM monthly),
w AS (SELECT ticker, x, t, k FROM r CROSS JOIN range(0, 6) q(k) WHERE t > n - 40 - 5 * k AND t <= n - 5 * k)
SELECT ticker, k, count(*) AS n, round(regr_slope(x, t), 7) AS slope FROM w GROUP BY 1, 2""")
def rolling_validation(spark: SparkSession, d: str) -> DataFrame:
    """Six windows of forty rows that step back by five: one explode of the windows each row is in."""
    p = Window.partitionBy("ticker")
    r = monthly_prices(spark, d).select("ticker", F.ln("close").alias("x"), F.row_number().over(p.orderBy("d")).alias("t"), F.count(F.lit(1)).over(p).alias("n"))
    w = r.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")))).where("t > n - 40 - 5 * k AND t <= n - 5 * k")
    return w.groupBy("ticker", "k").agg(F.count(F.lit(1)).alias("m"), F.round(F.regr_slope("x", "t"), 7).alias("slope")).withColumnRenamed("m", "n")


@query("cross_market_summary", f"""WITH {MONTHLY_SQL}, r AS (SELECT ticker, d, close, first_value(close) OVER (PARTITION BY ticker ORDER BY d) AS f FROM monthly), s AS (SELECT ticker, arg_max(close / f - 1, d) AS total FROM r GROUP BY 1)
SELECT count(*) AS n, round(avg((total > 0)::INT), 6) AS win_rate, round(quantile_cont(total, 0.5), 6) AS median_total FROM s""")
def cross_market(spark: SparkSession, d: str) -> DataFrame:
    s = monthly_prices(spark, d).groupBy("ticker").agg((F.max_by("close", "d") / F.min_by("close", "d") - 1).alias("total"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("total") > 0).cast("int")), 6).alias("win_rate"), F.round(F.percentile("total", F.lit(0.5)), 6).alias("median_total"))


@query("futures_plan", """WITH q AS (SELECT p_brand AS underlying, p_size AS expiry, min(p_partkey) AS id, arg_min(p_retailprice, p_partkey) AS price FROM part GROUP BY 1, 2), u AS (SELECT underlying, dense_rank() OVER (ORDER BY underlying) AS k FROM (SELECT DISTINCT underlying FROM q)),
c AS (SELECT a.underlying AS a, b.underlying AS b, min(x.expiry) AS expiry FROM u a JOIN u b ON b.k = a.k + 1 JOIN q x ON x.underlying = a.underlying JOIN q y ON y.underlying = b.underlying AND y.expiry = x.expiry WHERE x.expiry >= 10 GROUP BY 1, 2)
SELECT c.a, c.b, c.expiry, round(x.price * 25 * (1 + x.id % 8) + y.price * 25 * (1 + y.id % 8), 4) AS notional, c.expiry <= 12 AS rollover FROM c JOIN q x ON x.underlying = c.a AND x.expiry = c.expiry JOIN q y ON y.underlying = c.b AND y.expiry = c.expiry""")
def futures_plan(spark: SparkSession, d: str) -> DataFrame:
    """Nearest common expiry of neighbouring underlyings, notional of one lot each, rollover flag."""
    q = table(spark, d, "part").groupBy(F.col("p_brand").alias("u"), F.col("p_size").alias("expiry")).agg(F.min("p_partkey").alias("id"), F.min_by("p_retailprice", "p_partkey").alias("price"))
    value = F.col("price") * 25 * (1 + F.col("id") % 8)
    q = q.select("u", "expiry", value.alias("v")).where("expiry >= 10")
    names = q.select("u").distinct().withColumn("k", F.dense_rank().over(Window.orderBy("u")))  # the underlyings: a few dozen
    a = q.join(F.broadcast(names), "u").select(F.col("u").alias("a"), "k", "expiry", F.col("v").alias("va"))
    b = q.join(F.broadcast(names), "u").select(F.col("u").alias("b"), (F.col("k") - 1).alias("k"), "expiry", F.col("v").alias("vb"))
    near = a.join(b, ["k", "expiry"]).groupBy("a", "b").agg(F.min("expiry").alias("e"), F.min_by(F.col("va") + F.col("vb"), "expiry").alias("notional"))
    return near.select("a", "b", F.col("e").alias("expiry"), F.round("notional", 4).alias("notional"), (F.col("e") <= 12).alias("rollover"))


STRAT_SQL = f"""{CHAIN_SQL}, q AS (SELECT symbol, strike, is_call, min(vol) AS vol FROM chain GROUP BY 1, 2, 3), p AS (SELECT c.symbol, c.strike, 100 * (c.vol + p.vol) * 0.2 AS debit FROM q c JOIN q p ON c.symbol = p.symbol AND c.strike = p.strike AND c.is_call AND NOT p.is_call),
straddle AS (SELECT symbol, 'straddle' AS kind, strike AS low, strike AS high, debit FROM p), strangle AS (SELECT c.symbol, 'strangle' AS kind, p.strike AS low, c.strike AS high, 100 * (c.vol + p.vol) * 0.1 AS debit FROM q c JOIN q p ON c.symbol = p.symbol AND c.is_call AND NOT p.is_call AND c.strike = p.strike + 10),
vertical AS (SELECT a.symbol, 'vertical' AS kind, a.strike AS low, b.strike AS high, 100 * (a.vol - b.vol) * 0.2 AS debit FROM q a JOIN q b ON a.symbol = b.symbol AND a.is_call AND b.is_call AND b.strike = a.strike + 10)"""


@query("iv_strategies_top6", f"WITH {STRAT_SQL} SELECT symbol, kind, low, high, round(debit, 6) AS debit FROM (SELECT * FROM straddle UNION ALL SELECT * FROM strangle UNION ALL SELECT * FROM vertical) WHERE debit > 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(debit, 9), kind, low) <= 6")
def strategies(spark: SparkSession, d: str) -> DataFrame:
    """Straddles, strangles and call verticals as joins of a chain's legs, the six cheapest per symbol."""
    q = chain(spark, d).groupBy("symbol", "strike", "is_call").agg(F.min("vol").alias("vol"))
    calls = q.where("is_call").select("symbol", F.col("strike").alias("kc"), F.col("vol").alias("vc"))
    puts = q.where("NOT is_call").select("symbol", F.col("strike").alias("kp"), F.col("vol").alias("vp"))
    more = calls.select("symbol", (F.col("kc") - 10).alias("kc"), F.col("vc").alias("v2"))
    cols = lambda df, kind, low, high, debit: df.select("symbol", F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), debit.alias("debit"))
    c, p = F.col("kc"), F.col("kp")
    both = F.col("vc") + F.col("vp")
    straddle = cols(calls.join(puts.withColumn("kc", p), ["symbol", "kc"]), "straddle", c, c, 100 * both * 0.2)
    strangle = cols(calls.join(puts.withColumn("kc", p + 10), ["symbol", "kc"]), "strangle", p, c, 100 * both * 0.1)
    vertical = cols(calls.join(more, ["symbol", "kc"]), "vertical", c, c + 10, 100 * (F.col("vc") - F.col("v2")) * 0.2)
    every = straddle.union(strangle).union(vertical).where("debit > 0")
    best = top_per_group(every, ["symbol"], [F.round("debit", 9).asc(), F.asc("kind"), F.asc("low")], 6)
    return best.select("symbol", "kind", "low", "high", F.round("debit", 6).alias("debit"))


@query("distribution_buckets", """WITH v AS (SELECT p_brand AS symbol, 50 + 2.0::DOUBLE * p_size AS strike, count(*) AS liquidity, avg(p_retailprice) AS w FROM part GROUP BY 1, 2),
g AS (SELECT symbol, CASE WHEN strike < 80 THEN 'low' WHEN strike <= 120 THEN 'middle' ELSE 'high' END AS bucket, sum(liquidity * w) AS mass FROM v WHERE liquidity >= 1 GROUP BY 1, 2)
SELECT symbol, bucket, round(mass / sum(mass) OVER (PARTITION BY symbol), 6) AS probability FROM g""")
def distribution(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "part").groupBy(F.col("p_brand").alias("symbol"), (50 + 2.0 * F.col("p_size")).alias("strike")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("w"))
    bucket = F.when(F.col("strike") < 80, "low").when(F.col("strike") <= 120, "middle").otherwise("high")
    g = v.groupBy("symbol", bucket.alias("bucket")).agg(F.sum(F.col("n") * F.col("w")).alias("mass"))
    return g.select("symbol", "bucket", F.round(F.col("mass") / F.sum("mass").over(Window.partitionBy("symbol")), 6).alias("probability"))


@query("option_conditions", f"""WITH {CHAIN_SQL} SELECT symbol, count(*) FILTER (is_call) / nullif(count(*) FILTER (NOT is_call), 0)::DOUBLE >= 0.8 AS balanced, arg_min(id, (round(abs(strike - 105), 6), id)) FILTER (is_call) AS nearest_call, round(avg(vol), 6) AS mean_vol FROM chain GROUP BY 1""")
def option_conditions(spark: SparkSession, d: str) -> DataFrame:
    call = F.col("is_call")
    near = F.when(call, F.struct(F.round(F.abs(F.col("strike") - 105), 6), F.col("id")))
    return chain(spark, d).groupBy("symbol").agg(
        (F.count_if(call) / F.nullif(F.count_if(~call), F.lit(0)) >= 0.8).alias("balanced"), F.min_by("id", near).alias("nearest_call"), F.round(F.avg("vol"), 6).alias("mean_vol")
    )


@query("catalyst_top12", """WITH r AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)), q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS similarity FROM r, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 12""")
def catalysts(spark: SparkSession, d: str) -> DataFrame:
    """The twelve chunks nearest to a query among those a semi-join allows."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    allowed = e.join(table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    best = allowed.crossJoin(F.broadcast(q)).withColumn("s", cosine(F.col("embedding"), F.col("q"))).orderBy(F.desc("s"), "vec_id").limit(12)
    return best.select("vec_id", F.round("s", 6).alias("similarity"))


@query("news_eligibility", r"""SELECT page_id, regexp_matches(lower(url), '(page|item|news)') AS signal, regexp_extract(url, 'page=([0-9]+)', 1) AS page_no, NOT regexp_matches(url, '(spam|ads)\.') AS domain_ok FROM pages""")
def eligibility(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.lower(u).rlike("(page|item|news)").alias("signal"), F.regexp_extract(u, "page=([0-9]+)", 1).alias("page_no"), (~u.rlike(r"(spam|ads)\.")).alias("domain_ok"))


@query("greedy_pages_per_section", """WITH s AS (SELECT source, doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS a, (length(text) - length(replace(text, 'and', ''))) // 3 AS b FROM documents),
f AS (SELECT source, doc_id FROM s WHERE a > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY a DESC, doc_id) <= 8),
g AS (SELECT source, doc_id FROM s WHERE b > 0 AND doc_id NOT IN (SELECT doc_id FROM f) QUALIFY row_number() OVER (PARTITION BY source ORDER BY b DESC, doc_id) <= 8)
SELECT source, doc_id, 'first' AS section FROM f UNION ALL SELECT source, doc_id, 'second' FROM g""")
def greedy_pages(spark: SparkSession, d: str) -> DataFrame:
    """Eight best pages of a section, then eight of the next among those not used yet: one top-n and one anti-join per section."""
    text = F.col("text")
    n = lambda t: ((F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / 3).cast("long")
    s = table(spark, d, "documents").select("source", "doc_id", n("the").alias("a"), n("and").alias("b"))
    first = top_per_group(s.where("a > 0"), ["source"], [F.desc("a"), F.asc("doc_id")], 8).select("source", "doc_id")
    rest = s.where("b > 0").join(first.select("doc_id"), "doc_id", "left_anti")
    second = top_per_group(rest, ["source"], [F.desc("b"), F.asc("doc_id")], 8).select("source", "doc_id")
    return first.withColumn("section", F.lit("first")).union(second.withColumn("section", F.lit("second")))


@query("embedding_backfill", "SELECT vec_id FROM embeddings WHERE embedding IS NULL OR label <> 3")
def backfill(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose vector is missing or was made by another model."""
    return table(spark, d, "embeddings").where("embedding IS NULL OR label <> 3").select("vec_id")


@query("spot_proxy_z", """WITH q AS (SELECT l_orderkey AS trade, l_linenumber AS k, l_partkey AS i, l_extendedprice / l_quantity AS p, l_tax AS x FROM lineitem WHERE l_quantity > 0)
SELECT trade, k, i, round((ln(p) - 0.8 * ln(p * (1 + x)) - 1.2) / 0.05, 5) AS z FROM q""")
def spot_proxy(spark: SparkSession, d: str) -> DataFrame:
    """z of a frozen snapshot (hedge ratio, mean and deviation are constants of the trade) at new prices."""
    p = F.col("l_extendedprice") / F.col("l_quantity")
    z = (F.ln(p) - 0.8 * F.ln(p * (1 + F.col("l_tax"))) - 1.2) / 0.05
    return table(spark, d, "lineitem").where("l_quantity > 0").select(F.col("l_orderkey").alias("trade"), F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("i"), F.round(z, 5).alias("z"))
