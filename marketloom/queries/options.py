"""Options: chains, Greeks, open interest, smiles, distributions, payoffs, strategy marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import options as opt
from ..functions.numeric import norm_cdf_sql, norm_pdf_sql, ratio
from ..operators.ordered import top_per_group
from ..registry import query
from ..sources.tables import table

SPOT, RATE, T = 100.0, 0.05, 0.25

CHAIN_SQL = """chain AS (SELECT p_partkey AS id, p_brand AS symbol, 50 + 2.0::DOUBLE * p_size AS strike, (15 + p_partkey % 30) / 100.0::DOUBLE AS vol, p_partkey % 2 = 0 AS is_call,
  CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS sg, 100.0::DOUBLE AS s, 0.25::DOUBLE AS t, 0.05::DOUBLE AS r FROM part)"""


def chain(spark: SparkSession, d: str) -> DataFrame:
    """Parts as option contracts: strike by size, volatility by key, side by parity."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("id"), F.col("p_brand").alias("symbol"), (50 + 2.0 * F.col("p_size")).alias("strike"), ((15 + k % 30) / 100.0).alias("vol"),
        (k % 2 == 0).alias("is_call"), F.lit(SPOT).alias("s"), F.lit(T).alias("t"), F.lit(RATE).alias("r"),
    )


ARGS = ("s", "strike", "t", "r", "vol")


def _args() -> list:
    return [F.col(c) for c in ARGS]


_D1 = opt.d1_sql("s", "strike", "t", "r", "vol")
_D2 = f"({_D1} - vol * sqrt(t))"


@query("option_greeks", f"""WITH {CHAIN_SQL} SELECT id, round({norm_cdf_sql(_D1)} - CASE WHEN is_call THEN 0 ELSE 1 END, 6) AS delta, round({norm_pdf_sql(_D1)} / (s * vol * sqrt(t)), 6) AS gamma,
 round((-s * {norm_pdf_sql(_D1)} * vol / (2 * sqrt(t)) - sg * r * strike * exp(-r * t) * {norm_cdf_sql(f'sg * {_D2}')}) / 365, 6) AS theta, round(s * {norm_pdf_sql(_D1)} * sqrt(t) / 100, 6) AS vega,
 round(sg * strike * exp(-r * t) * t * {norm_cdf_sql(f'sg * {_D2}')} / 100, 6) AS rho FROM chain""")
def greeks(spark: SparkSession, d: str) -> DataFrame:
    g = opt.greeks(*_args(), F.col("is_call"))
    return chain(spark, d).select("id", *[F.round(c, 6).alias(n) for n, c in g.items()])


@query("option_price", f"WITH {CHAIN_SQL} SELECT id, round({opt.price_sql('s', 'strike', 't', 'r', 'vol', 'sg')}, 5) AS price, round({norm_cdf_sql(_D2)}, 6) AS prob_above FROM chain")
def option_price(spark: SparkSession, d: str) -> DataFrame:
    return chain(spark, d).select("id", F.round(opt.price(*_args(), F.col("is_call")), 5).alias("price"), F.round(opt.prob_above(*_args()), 6).alias("prob_above"))


#: Quotes in whole cents, moved by up to 15 of them, so that some tell no volatility.
QUOTED_SQL = f"""{CHAIN_SQL}, quoted AS (SELECT *, greatest(0, floor({opt.price_sql('s', 'strike', 't', 'r', 'vol', 'sg')} * 100 + 1e-6) / 100 + (id % 7 - 3) * 0.05::DOUBLE) AS premium, vol AS of_vol FROM chain)"""


def quoted(spark: SparkSession, d: str) -> DataFrame:
    cents = F.floor(opt.price(*_args(), F.col("is_call")) * 100 + 1e-6) / 100
    return chain(spark, d).withColumn("premium", F.greatest(F.lit(0.0), cents + (F.col("id") % 7 - 3) * 0.05))


@query("implied_volatility", f"WITH RECURSIVE {QUOTED_SQL}, q AS (SELECT id, s, strike, t, r, sg, premium FROM quoted), {opt.implied_sql('q', 'premium')} SELECT id, round(vol, 5) AS implied FROM implied")
def implied(spark: SparkSession, d: str) -> DataFrame:
    """The volatility of every quote, null where the quote doesn't tell it."""
    s, k, t, r, _ = _args()
    return quoted(spark, d).select("id", F.round(opt.implied_vol(F.col("premium"), s, k, t, r, F.col("is_call")), 5).alias("implied"))


@query("oi_summary", """WITH o AS (SELECT p_brand AS symbol, p_partkey % 2 = 0 AS is_call, l_quantity AS oi, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS change FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT symbol, sum(oi) FILTER (is_call) AS call_oi, sum(oi) FILTER (NOT is_call) AS put_oi, sum(change) FILTER (is_call) AS call_change FROM o GROUP BY 1)
SELECT symbol, call_oi, put_oi, round(put_oi / nullif(call_oi, 0), 6) AS put_call_ratio, round(CASE WHEN call_oi - call_change > 0 THEN call_change / (call_oi - call_change) * 100 END, 6) AS call_change_percent FROM g""")
def oi_summary(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    items = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_returnflag")
    # pre-aggregate by part before the join: one row per part and flag crosses the network
    items = items.groupBy("l_partkey").agg(F.sum("l_quantity").alias("oi"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("change"))
    both = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    call = F.col("l_partkey") % 2 == 0
    g = both.groupBy("symbol").agg(F.sum(F.when(call, F.col("oi"))).alias("call_oi"), F.sum(F.when(~call, F.col("oi"))).alias("put_oi"), F.sum(F.when(call, F.col("change"))).alias("cc"))
    prev = F.col("call_oi") - F.col("cc")
    return g.select("symbol", "call_oi", "put_oi", F.round(ratio(F.col("put_oi"), F.col("call_oi")), 6).alias("put_call_ratio"), F.round(F.when(prev > 0, F.col("cc") / prev * 100), 6).alias("call_change_percent"))


@query("chain_window_25", f"WITH {CHAIN_SQL}, k AS (SELECT symbol, strike, row_number() OVER (PARTITION BY symbol ORDER BY strike) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT DISTINCT symbol, strike FROM chain)), m AS (SELECT symbol, arg_min(i, (abs(strike - 100), i)) AS mid FROM k GROUP BY 1) SELECT k.symbol, strike FROM k JOIN m USING (symbol) WHERE i BETWEEN greatest(1, least(mid - 12, n - 24)) AND greatest(25, least(mid + 12, n))")
def chain_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol")
    k = chain(spark, d).select("symbol", "strike").distinct().withColumns({"i": F.row_number().over(w.orderBy("strike")), "n": F.count(F.lit(1)).over(w)})
    k = k.withColumn("mid", F.min_by("i", F.struct(F.abs(F.col("strike") - SPOT), F.col("i"))).over(w))
    low = F.greatest(F.lit(1), F.least(F.col("mid") - 12, F.col("n") - 24))
    high = F.greatest(F.lit(25), F.least(F.col("mid") + 12, F.col("n")))
    return k.where(F.col("i").between(low, high)).select("symbol", "strike")


@query("most_active_top3", "SELECT p_brand AS symbol, is_call, id FROM (SELECT p_brand, p_partkey % 2 = 0 AS is_call, p_partkey AS id, sum(l_quantity) AS oi FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY p_brand, is_call ORDER BY oi DESC, id) <= 3")
def most_active(spark: SparkSession, d: str) -> DataFrame:
    oi = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("oi"))
    both = oi.join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("symbol")), "id").withColumn("is_call", F.col("id") % 2 == 0)
    return top_per_group(both, ["symbol", "is_call"], [F.desc("oi"), F.asc("id")], 3).select("symbol", "is_call", "id")


_DELTA = f"abs({norm_cdf_sql(_D1)} - CASE WHEN is_call THEN 0 ELSE 1 END)"
BUCKETS = (0.10, 0.25, 0.50)


@query("smile_delta_buckets", f"""WITH {CHAIN_SQL}, dl AS (SELECT id, symbol, is_call, vol, {_DELTA} AS ad FROM chain), b AS (SELECT unnest([0.10, 0.25, 0.50]::DOUBLE[]) AS target)
SELECT symbol, is_call, target, round(arg_min(vol, (round(abs(ad - target), 9), id)), 6) AS vol FROM dl CROSS JOIN b GROUP BY 1, 2, 3 HAVING min(abs(ad - target)) <= 0.18""")
def smile(spark: SparkSession, d: str) -> DataFrame:
    delta = opt.greeks(*_args(), F.col("is_call"))["delta"]
    rows = chain(spark, d).withColumn("ad", F.abs(delta)).withColumn("target", F.explode(F.array(*map(F.lit, BUCKETS))))
    off = F.abs(F.col("ad") - F.col("target"))
    g = rows.groupBy("symbol", "is_call", "target").agg(F.min_by("vol", F.struct(F.round(off, 9), F.col("id"))).alias("vol"), F.min(off).alias("off"))
    return g.where("off <= 0.18").select("symbol", "is_call", "target", F.round("vol", 6).alias("vol"))


@query("tenor_interpolation", """WITH k AS (SELECT l_suppkey AS symbol, month(l_shipdate) AS x, avg(l_discount) AS y FROM lineitem GROUP BY 1, 2), t AS (SELECT unnest([0.5, 4.5, 8.25, 13.0]::DOUBLE[]) AS x0),
b AS (SELECT symbol, x0, max(x) FILTER (x <= x0) AS a, arg_max(y, x) FILTER (x <= x0) AS ya, min(x) FILTER (x > x0) AS b, arg_min(y, x) FILTER (x > x0) AS yb FROM k CROSS JOIN t GROUP BY 1, 2)
SELECT symbol, x0, round(CASE WHEN a IS NULL THEN yb WHEN b IS NULL THEN ya ELSE ya + (yb - ya) * (x0 - a) / (b - a) END, 6) AS y FROM b""")
def interpolation(spark: SparkSession, d: str) -> DataFrame:
    """Piecewise-linear values at four tenors, clamped at the ends."""
    k = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.month("l_shipdate").alias("x")).agg(F.avg("l_discount").alias("y"))
    rows = k.withColumn("x0", F.explode(F.array(*map(F.lit, (0.5, 4.5, 8.25, 13.0)))))
    low, high = F.when(F.col("x") <= F.col("x0"), F.col("x")), F.when(F.col("x") > F.col("x0"), F.col("x"))
    g = rows.groupBy("symbol", "x0").agg(F.max(low).alias("a"), F.max_by("y", low).alias("ya"), F.min(high).alias("b"), F.min_by("y", high).alias("yb"))
    line = F.expr("ya + (yb - ya) * (x0 - a) / (b - a)")
    return g.select("symbol", "x0", F.round(F.when(F.col("a").isNull(), F.col("yb")).when(F.col("b").isNull(), F.col("ya")).otherwise(line), 6).alias("y"))


def isotonic_decreasing(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Least-squares decreasing fit of each group: min over starts at or before i of max over ends at or after i of the mean.

    A group is one chain (tens of strikes), so the quadratic form is small; it needs no Python.
    """
    arr = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("s"))
    arr = arr.withColumn("c", F.aggregate(F.col(f"s.{value}"), F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))
    n = F.size("s")
    mean = lambda j, k: (F.get("c", k) - F.get("c", j - 1)) / (k - j + 1)
    fit = lambda i: F.array_min(F.transform(F.sequence(F.lit(1), i), lambda j: F.array_max(F.transform(F.sequence(i, n), lambda k: mean(j, k)))))
    rows = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.get("s", i - 1)[order].alias(order), F.get("s", i - 1)[value].alias(value), fit(i).alias("fitted")))
    return arr.select(key, F.inline(rows))


@query("isotonic_exceedance", """WITH v AS (SELECT p_brand AS symbol, p_size AS x, avg((p_partkey % 97) / 97.0) AS y FROM part GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY x) AS i FROM v), m AS (SELECT a.symbol, a.i AS j, b.i AS k, avg(c.y) AS m FROM o a JOIN o b ON a.symbol = b.symbol AND a.i <= b.i JOIN o c ON c.symbol = a.symbol AND c.i BETWEEN a.i AND b.i GROUP BY 1, 2, 3)
SELECT symbol, x, round(min(best), 6) AS fitted FROM (SELECT o.symbol, o.x, m.j, max(m.m) AS best FROM o JOIN m ON m.symbol = o.symbol AND m.j <= o.i AND m.k >= o.i GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def isotonic(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "part").groupBy(F.col("p_brand").alias("symbol"), F.col("p_size").alias("x")).agg(F.avg((F.col("p_partkey") % 97) / 97.0).alias("y"))
    return isotonic_decreasing(v, "symbol", "x", "y").select("symbol", "x", F.round("fitted", 6).alias("fitted"))


IRON_SQL = f"""{CHAIN_SQL}, g AS (SELECT symbol, strike, is_call, min(vol) AS vol, any_value(sg) AS sg, any_value(s) AS s, any_value(t) AS t, any_value(r) AS r FROM chain GROUP BY 1, 2, 3),
q AS (SELECT *, {opt.price_sql('s', 'strike', 't', 'r', 'vol', 'sg')} AS price, abs({norm_cdf_sql(_D1)} - CASE WHEN is_call THEN 0 ELSE 1 END) AS ad FROM g),
v AS (SELECT symbol, avg(vol) AS mean_vol FROM q GROUP BY 1),
pair AS (SELECT symbol, strike, max(price) FILTER (is_call) AS c, max(price) FILTER (NOT is_call) AS p, any_value(s) AS s FROM q GROUP BY 1, 2),
atm AS (SELECT symbol, arg_min(strike, (abs(strike - s), strike)) AS k, arg_min(c + p, (abs(strike - s), strike)) AS straddle FROM pair WHERE c IS NOT NULL AND p IS NOT NULL GROUP BY 1),
wing AS (SELECT symbol, arg_min(strike, (round(abs(ad - 0.1), 9), -strike)) FILTER (NOT is_call AND strike < k) AS k1, arg_min(price, (round(abs(ad - 0.1), 9), -strike)) FILTER (NOT is_call AND strike < k) AS p1,
 arg_min(strike, (round(abs(ad - 0.1), 9), strike)) FILTER (is_call AND strike > k) AS k4, arg_min(price, (round(abs(ad - 0.1), 9), strike)) FILTER (is_call AND strike > k) AS p4 FROM q JOIN atm USING (symbol) GROUP BY 1),
""" + "near AS (SELECT symbol, " + ", ".join(
    f"arg_min({c}, (round(abs(ad - {x}), 9), strike)) FILTER ({side}) AS {a}{k}"
    for k, x, side in ((1, 0.1, "NOT is_call"), (2, 0.25, "NOT is_call"), (3, 0.25, "is_call"), (4, 0.1, "is_call"))
    for c, a in (("strike", "k"), ("price", "p"), ("vol", "v"))
) + """ FROM q GROUP BY 1), built AS (SELECT symbol, 'iron_butterfly' AS kind, k1, k AS k2, k AS k3, k4, straddle - p1 - p4 AS credit FROM atm JOIN wing USING (symbol)
UNION ALL SELECT symbol, 'iron_condor', k1, k2, k3, k4, p2 + p3 - p1 - p4 FROM near JOIN v USING (symbol) WHERE k1 < k2 AND k2 < k3 AND k3 < k4 AND v2 > mean_vol AND v3 > mean_vol)"""


@query("iron_strategies", f"WITH {IRON_SQL} SELECT symbol, kind, k1, k2, k3, k4, round(credit, 4) AS credit, round(greatest(k2 - k1, k4 - k3) - credit, 4) AS max_loss, round(k2 - credit, 4) AS low_even, round(k3 + credit, 4) AS high_even FROM built WHERE credit > 0 AND greatest(k2 - k1, k4 - k3) > credit")
def iron_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Short iron butterfly at the money and short iron condor of each symbol, by sums over its chain without a join.

    The butterfly's wings are the out-of-the-money options nearest to a delta of 0.10; the condor sells the deltas nearest to 0.25 if both
    are dearer than the chain's mean volatility (its prediction here) and buys those nearest to 0.10.  No credit or no risk: no row.
    """
    g = chain(spark, d).groupBy("symbol", "strike", "is_call", "s", "t", "r").agg(F.min("vol").alias("vol"))
    q = g.withColumns({"price": opt.price(*_args(), F.col("is_call")), "ad": F.abs(opt.greeks(*_args(), F.col("is_call"))["delta"])})
    call, put, strike = F.col("is_call"), ~F.col("is_call"), F.col("strike")
    at = Window.partitionBy("symbol", "strike")
    q = q.withColumn("straddle", F.max(F.when(call, F.col("price"))).over(at) + F.max(F.when(put, F.col("price"))).over(at))
    middle = F.when(F.col("straddle").isNotNull(), F.struct(F.abs(strike - F.col("s")).alias("off"), strike.alias("k"), "straddle"))
    q = q.withColumn("atm", F.min(middle).over(Window.partitionBy("symbol")))

    def nearest(delta: float, where, name: str, tie=strike):
        off = F.round(F.abs(F.col("ad") - delta), 9)
        return F.min(F.when(where, F.struct(off.alias("off"), tie.alias("tie"), strike.alias("k"), F.col("price").alias("p"), F.col("vol").alias("v")))).alias(name)

    k = F.col("atm.k")
    b = q.groupBy("symbol").agg(
        F.first("atm").alias("atm"), F.avg("vol").alias("mean_vol"),
        nearest(0.1, put & (strike < k), "w1", -strike), nearest(0.1, call & (strike > k), "w4"),
        nearest(0.1, put, "l1"), nearest(0.25, put, "s2"), nearest(0.25, call, "s3"), nearest(0.1, call, "l4"),
    )
    of = lambda kind, legs, credit: F.struct(F.lit(kind).alias("kind"), *[c.alias(f"k{i}") for i, c in enumerate(legs, 1)], credit.alias("credit"))
    butterfly = of("iron_butterfly", [F.col("w1.k"), k, k, F.col("w4.k")], F.col("atm.straddle") - F.col("w1.p") - F.col("w4.p"))
    condor = of("iron_condor", [F.col(f"{c}.k") for c in ("l1", "s2", "s3", "l4")], F.expr("s2.p + s3.p - l1.p - l4.p"))
    dear = F.expr("l1.k < s2.k AND s2.k < s3.k AND s3.k < l4.k AND s2.v > mean_vol AND s3.v > mean_vol")
    built = b.select("symbol", F.inline(F.array(butterfly, F.when(dear, condor))))
    width, credit = F.greatest(F.expr("k2 - k1"), F.expr("k4 - k3")), F.col("credit")
    r4 = lambda c, n: F.round(c, 4).alias(n)
    rows = built.where((credit > 0) & (width > credit))
    return rows.select("symbol", "kind", "k1", "k2", "k3", "k4", r4(credit, "credit"), r4(width - credit, "max_loss"), r4(F.col("k2") - credit, "low_even"), r4(F.col("k3") + credit, "high_even"))


LEGS_SQL = """legs AS (SELECT l_orderkey AS trade, l_linenumber AS leg, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS side, 80 + 5.0 * (l_partkey % 9) AS strike, l_partkey % 2 = 0 AS is_call, 1 + (l_quantity % 5) AS premium FROM lineitem)"""


def legs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("trade"), F.col("l_linenumber").alias("leg"), F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1).alias("side"),
        (80 + 5.0 * (F.col("l_partkey") % 9)).alias("strike"), (F.col("l_partkey") % 2 == 0).alias("is_call"), (1 + F.col("l_quantity") % 5).alias("premium"),
    )


#: Prices of a payoff grid, two apart from 60 on.
GRID = 41


def payoffs(spark: SparkSession, d: str) -> DataFrame:
    """(trade, payoffs): each trade's payoff at every price of the grid; a trade's legs are summed before the shuffle, no leg becomes rows."""
    def at(x: float) -> F.Column:
        value = F.greatest(F.lit(0.0), F.when(F.col("is_call"), x - F.col("strike")).otherwise(F.col("strike") - x))
        return F.sum(F.col("side") * (value - F.col("premium")))

    sums = legs(spark, d).groupBy("trade").agg(*[at(60 + 2.0 * i).alias(f"p{i}") for i in range(GRID)])
    return sums.select("trade", F.array(*[F.round(f"p{i}", 6) for i in range(GRID)]).alias("payoffs"))


@query("payoff_grid", f"""WITH {LEGS_SQL} SELECT trade, x, round(sum(side * (CASE WHEN is_call THEN greatest(x - strike, 0) ELSE greatest(strike - x, 0) END - premium)), 6) AS payoff
FROM legs CROSS JOIN (SELECT 60 + 2.0::DOUBLE * unnest(range(0, 41)) AS x) GROUP BY 1, 2""")
def payoff_grid(spark: SparkSession, d: str) -> DataFrame:
    points = F.array(*[F.struct(F.lit(60 + 2.0 * i).alias("x"), F.get("payoffs", F.lit(i)).alias("payoff")) for i in range(GRID)])
    return payoffs(spark, d).select("trade", F.inline(points))


@query("strategy_extremes", f"""WITH {LEGS_SQL}, g AS (SELECT trade, x, sum(side * (CASE WHEN is_call THEN greatest(x - strike, 0) ELSE greatest(strike - x, 0) END - premium)) AS p
FROM legs CROSS JOIN (SELECT 60 + 2.0::DOUBLE * unnest(range(0, 41)) AS x) GROUP BY 1, 2), l AS (SELECT *, lag(p) OVER (PARTITION BY trade ORDER BY x) AS p0 FROM g)
SELECT trade, round(max(p), 6) AS best, round(greatest(-min(p), 0), 6) AS at_risk, count(*) FILTER (p0 * p < 0) AS break_evens FROM l GROUP BY 1""")
def strategy_extremes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("payoffs")
    turns = F.filter(F.sequence(F.lit(1), F.lit(GRID - 1)), lambda i: F.get(p, i - 1) * F.get(p, i) < 0)
    best, worst = F.array_max(p), F.greatest(-F.array_min(p), F.lit(0.0))
    return payoffs(spark, d).select("trade", F.round(best, 6).alias("best"), F.round(worst, 6).alias("at_risk"), F.size(turns).cast("long").alias("break_evens"))


@query("strategy_mark", f"""WITH {LEGS_SQL}, q AS (SELECT DISTINCT p_size AS k, first_value(p_retailprice) OVER (PARTITION BY p_size ORDER BY p_partkey) / 1000 AS bid FROM part), m AS (SELECT trade, side, premium, bid FROM legs LEFT JOIN q ON k = strike - 79)
SELECT trade, round(sum(side * (bid - premium)), 6) AS pnl FROM m GROUP BY 1 HAVING bool_and(bid IS NOT NULL)""")
def strategy_mark(spark: SparkSession, d: str) -> DataFrame:
    """Profit of closing every leg; a missing quote of any leg gives no mark."""
    q = table(spark, d, "part").groupBy(F.col("p_size").alias("k")).agg((F.min_by("p_retailprice", "p_partkey") / 1000).alias("bid"))
    m = legs(spark, d).join(q, F.col("k") == F.col("strike") - 79, "left").groupBy("trade")
    m = m.agg(F.sum(F.col("side") * (F.col("bid") - F.col("premium"))).alias("pnl"), F.bool_and(F.col("bid").isNotNull()).alias("whole"))
    return m.where("whole").select("trade", F.round("pnl", 6).alias("pnl"))


@query("spread_and_execution_price", "SELECT l_orderkey, l_linenumber, round((ask - bid) / ((ask + bid) / 2), 6) AS relative_spread, CASE WHEN ask > 15 THEN ask WHEN bid > 5 THEN bid ELSE last END AS execution, CASE WHEN ask > 15 THEN 'ask' WHEN bid > 5 THEN 'bid' ELSE 'last' END AS source FROM (SELECT l_orderkey, l_linenumber, l_quantity AS bid, l_quantity + 10 * l_discount AS ask, l_quantity + 1 AS last FROM lineitem)")
def execution(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("bid"), (q + 10 * F.col("l_discount")).alias("ask"), (q + 1).alias("last"))
    by_ask, by_bid = F.col("ask") > 15, F.col("bid") > 5
    middle = (F.col("ask") + F.col("bid")) / 2
    return rows.select(
        "l_orderkey", "l_linenumber", F.round(ratio(F.col("ask") - F.col("bid"), middle), 6).alias("relative_spread"),
        F.when(by_ask, F.col("ask")).when(by_bid, F.col("bid")).otherwise(F.col("last")).alias("execution"), F.when(by_ask, "ask").when(by_bid, "bid").otherwise("last").alias("source"),
    )


@query("iv_evaluation", """WITH e AS (SELECT l_suppkey AS symbol, l_tax * 100 AS f, l_discount * 100 AS a, l_quantity % 10 AS b FROM lineitem) SELECT symbol, round(sqrt(avg(pow(f - a, 2))), 6) AS rmse, round(sqrt(avg(pow(b - a, 2))), 6) AS base_rmse,
 round((1 - sqrt(avg(pow(f - a, 2))) / nullif(sqrt(avg(pow(b - a, 2))), 0)) * 100, 6) AS improvement, round(avg((sign(f - b) = sign(a - b))::INT) FILTER (abs(a - b) >= 0.25), 6) AS directional, round(avg(f - a), 6) AS bias FROM e GROUP BY 1""")
def iv_evaluation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), (F.col("l_tax") * 100).alias("f"), (F.col("l_discount") * 100).alias("a"), (F.col("l_quantity") % 10).alias("b"))
    rmse = lambda x: F.sqrt(F.avg(F.pow(F.col(x) - F.col("a"), 2.0)))
    right = (F.signum(F.col("f") - F.col("b")) == F.signum(F.col("a") - F.col("b"))).cast("int")
    return e.groupBy("symbol").agg(
        F.round(rmse("f"), 6).alias("rmse"), F.round(rmse("b"), 6).alias("base_rmse"), F.round((1 - ratio(rmse("f"), rmse("b"))) * 100, 6).alias("improvement"),
        F.round(F.avg(F.when(F.abs(F.col("a") - F.col("b")) >= 0.25, right)), 6).alias("directional"), F.round(F.avg(F.col("f") - F.col("a")), 6).alias("bias"),
    )
