"""Price distributions of option chains and their monotone curves, beside SQL with the min-max form of the decreasing fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import options as opt
from ..functions.numeric import norm_cdf_sql
from ..operators import curves
from ..operators import distribution as dist
from ..operators import iv_surface as ivs
from ..registry import query
from ..sources.tables import table
from .options import CHAIN_SQL, chain

QUOTES_SQL = """traded AS (SELECT l_partkey AS id, sum(CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN l_quantity ELSE 0 END)::DOUBLE AS volume,
 sum(CASE WHEN l_linenumber = 2 AND l_returnflag = 'A' THEN l_quantity ELSE 0 END)::DOUBLE AS oi FROM lineitem GROUP BY 1),
quotes AS (SELECT p_brand AS symbol, 50 + 2.0::DOUBLE * p_size AS strike, p_partkey % 2 = 0 AS is_call, CASE WHEN p_partkey % 11 > 0 THEN 15 + p_partkey % 30 END::DOUBLE AS iv, volume, oi,
 10.0::DOUBLE + p_partkey % 5 AS bid, (10.0::DOUBLE + p_partkey % 5) * (0.95 + p_partkey % 9 / 10.0::DOUBLE) AS ask, 100.0::DOUBLE AS spot, 0.25::DOUBLE AS t, 0.05::DOUBLE AS r FROM part LEFT JOIN traded ON id = p_partkey)"""


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Parts as option quotes: some have no volatility, no trade, crossed or wide prices."""
    k, line, flag, size = F.col("p_partkey"), F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_quantity")
    of = lambda n, f: F.sum(F.when((line == n) & (flag == f), size).otherwise(0.0)).cast("double")
    traded = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(of(1, "R").alias("volume"), of(2, "A").alias("oi"))
    bid = 10.0 + k % 5
    return (
        table(spark, d, "part")
        .join(traded, "p_partkey", "left")
        .select(
            F.col("p_brand").alias("symbol"), (50 + 2.0 * F.col("p_size")).alias("strike"), (k % 2 == 0).alias("is_call"), F.when(k % 11 > 0, 15 + k % 30).cast("double").alias("iv"), "volume", "oi",
            bid.alias("bid"), (bid * (0.95 + k % 9 / 10.0)).alias("ask"), F.lit(100.0).alias("spot"), F.lit(0.25).alias("t"), F.lit(0.05).alias("r"),
        )
    )


_D2 = f"({opt.d1_sql('spot', 'strike', 't', 'r', '(iv / 100)')} - iv / 100 * sqrt(t))"
_PICK = "arg_min(q, (iv IS NULL, iv, volume IS NULL, volume, oi IS NULL, oi, bid, ask)) FILTER"
CURVE_SQL = f"""{QUOTES_SQL}, q1 AS (SELECT symbol, strike, spot, t, r, is_call, iv, volume, oi, bid, ask, {{'iv': iv, 'volume': volume, 'oi': oi, 'bid': bid, 'ask': ask}} AS q FROM quotes),
legs AS (SELECT symbol, strike, any_value(spot) AS spot, any_value(t) AS t, any_value(r) AS r, {_PICK} (is_call) AS c, {_PICK} (NOT is_call) AS p FROM q1 GROUP BY 1, 2),
pref AS (SELECT *, CASE WHEN strike < spot THEN p ELSE c END AS one, CASE WHEN strike < spot THEN c ELSE p END AS two FROM legs),
leg AS (SELECT symbol, strike, spot, t, r, CASE WHEN one.iv > 0 AND one.iv <= {dist.MOST_IV} THEN one WHEN two.iv > 0 AND two.iv <= {dist.MOST_IV} THEN two END AS l FROM pref),
flat AS (SELECT symbol, strike, spot, t, r, l.iv AS iv, coalesce(l.volume, 0) AS volume, coalesce(l.oi, 0) AS oi, CASE WHEN l.bid >= 0 AND l.ask > 0 AND l.ask >= l.bid THEN (l.ask - l.bid) / ((l.ask + l.bid) / 2) END AS spread FROM leg),
ob AS (SELECT *, iv IS NOT NULL AND (volume > 0 OR oi > 0) AS active, greatest({dist.LEAST_WEIGHT}, ln(1 + volume + oi) / (1 + 4 * coalesce(spread, 0))) AS weight FROM flat),
us AS (SELECT symbol, strike, spread, {norm_cdf_sql(_D2)} AS raw, weight, row_number() OVER (PARTITION BY symbol ORDER BY strike) AS i FROM ob WHERE active AND coalesce(spread, 0) <= {dist.WIDEST}),
cu AS (SELECT *, sum(raw * weight) OVER w AS cv, sum(weight) OVER w AS cw FROM us WINDOW w AS (PARTITION BY symbol ORDER BY i)),
mm AS (SELECT j.symbol, j.i AS j, k.i AS k, (k.cv - j.cv + j.raw * j.weight) / (k.cw - j.cw + j.weight) AS m FROM cu j JOIN cu k ON k.symbol = j.symbol AND k.i >= j.i),
mx AS (SELECT us.symbol, us.i, mm.j, max(mm.m) AS m FROM us JOIN mm ON mm.symbol = us.symbol AND mm.j <= us.i AND mm.k >= us.i GROUP BY 1, 2, 3),
fit AS (SELECT symbol, i, greatest(0.0, least(1.0, min(m))) AS above FROM mx GROUP BY 1, 2),
tot AS (SELECT symbol, any_value(spot) AS spot, count(*) AS total_strikes, count(iv) AS valid, count(*) FILTER (active) AS trading FROM ob GROUP BY 1),
cnt AS (SELECT symbol, count(*) AS strikes_used FROM us GROUP BY 1),
curve AS (SELECT us.symbol, us.i, us.strike, us.raw, us.spread, fit.above, strikes_used AS n FROM us JOIN fit USING (symbol, i) JOIN cnt USING (symbol) JOIN tot USING (symbol) WHERE strikes_used >= {dist.LEAST_STRIKES} AND total_strikes >= {dist.LEAST_STRIKES})"""


@query("exceedance_fit", f"WITH {CURVE_SQL} SELECT symbol, strike, round(above, 7) AS above FROM curve")
def exceedance_fit(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities above each usable strike after the weighted decreasing fit."""
    rows = dist.distributions(quotes(spark, d)).where("available")
    return rows.select("symbol", F.inline(F.arrays_zip(F.col("strikes").alias("strike"), "above"))).select("symbol", "strike", F.round("above", 7).alias("above"))


def _level(q: float) -> str:
    t = f"{1 - q}::DOUBLE"
    return f"""CASE WHEN {t} >= max(above) FILTER (i = 1) THEN max(strike) FILTER (i = 1) WHEN {t} <= max(above) FILTER (i = n) THEN max(strike) FILTER (i = n)
 ELSE arg_min(strike + (CASE WHEN above = nxt THEN 0.5 ELSE (above - {t}) / (above - nxt) END) * (k1 - strike), i) FILTER (above >= {t} AND {t} >= nxt) END"""


LEVELS_SQL = ", ".join(f"round({_level(q)}, 5) AS {n}" for n, q in dist.LEVELS.items())
SCORE_SQL = "round(100 * (0.4 * valid / total_strikes + 0.35 * trading / total_strikes + 0.25 * greatest(0.0, 1 - least(coalesce(nullif(mid, 0), 0.5), 1.0))), 1)"


@query("price_distribution", f"""WITH {CURVE_SQL}, nx AS (SELECT *, lead(above) OVER w AS nxt, lead(strike) OVER w AS k1 FROM curve WINDOW w AS (PARTITION BY symbol ORDER BY i)),
lv AS (SELECT symbol, count(*) FILTER (abs(raw - above) > 1e-8) AS adjustments, list_sort(list(spread) FILTER (spread IS NOT NULL)) AS sp, {LEVELS_SQL},
 round(CASE WHEN 100 <= min(strike) THEN max(above) FILTER (i = 1) WHEN 100 >= max(strike) THEN max(above) FILTER (i = n) ELSE arg_min(above + (100 - strike) / (k1 - strike) * (nxt - above), i) FILTER (strike <= 100 AND 100 <= k1) END, 6) AS above_spot FROM nx GROUP BY 1),
al AS (SELECT *, sp[len(sp) // 2 + 1] AS mid FROM tot LEFT JOIN cnt USING (symbol) LEFT JOIN lv USING (symbol))
SELECT symbol, total_strikes, coalesce(strikes_used, 0) AS strikes_used, adjustments IS NOT NULL AS available, adjustments, {', '.join(dist.LEVELS)}, above_spot, round(mid * 100, 5) AS median_spread,
 CASE WHEN adjustments IS NOT NULL THEN {SCORE_SQL} END AS quality_score, CASE WHEN adjustments IS NULL THEN 'unavailable' WHEN {SCORE_SQL} >= 75 THEN 'high' WHEN {SCORE_SQL} >= 50 THEN 'medium' ELSE 'low' END AS quality_label,
 round(100.0 * valid / total_strikes, 4) AS iv_coverage, round(100.0 * trading / total_strikes, 4) AS active_coverage FROM al""")
def price_distribution(spark: SparkSession, d: str) -> DataFrame:
    rows = dist.distributions(quotes(spark, d))
    rounded = {**dict.fromkeys(dist.LEVELS, 5), "above_spot": 6, "median_spread": 5, "iv_coverage": 4, "active_coverage": 4}
    return rows.select("symbol", "total_strikes", "strikes_used", "available", "adjustments", "quality_score", "quality_label", *[F.round(c, k).alias(c) for c, k in rounded.items()])


@query("price_ranges", f"""WITH {CURVE_SQL}, st AS (SELECT symbol, list_sort(list(w)) AS ws FROM (SELECT symbol, lead(strike) OVER (PARTITION BY symbol ORDER BY i) - strike AS w FROM curve) WHERE w IS NOT NULL GROUP BY 1),
b AS (SELECT symbol, i, lag(strike) OVER w AS low, strike AS high, CASE WHEN i = 1 THEN strike - ws[len(ws) // 2 + 1] / 2 ELSE (lag(strike) OVER w + strike) / 2 END AS price, round(CASE WHEN i = 1 THEN 1 - above ELSE greatest(0.0, lag(above) OVER w - above) END, 6) AS probability
 FROM curve JOIN st USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY i) UNION ALL SELECT symbol, n + 1, strike, NULL, strike + ws[len(ws) // 2 + 1] / 2, round(above, 6) FROM curve JOIN st USING (symbol) WHERE i = n)
SELECT symbol, i - 1 AS i, low, high, price, probability, row_number() OVER (PARTITION BY symbol ORDER BY probability DESC, i) = 1 AS likeliest FROM b""")
def price_ranges(spark: SparkSession, d: str) -> DataFrame:
    return dist.ranges(dist.distributions(quotes(spark, d)))


MONOTONE_SQL = """p1 AS (SELECT *, x1 - x AS h, (y1 - y) / (x1 - x) AS s FROM (SELECT symbol, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM pts WINDOW w AS (PARTITION BY symbol ORDER BY x))),
p2 AS (SELECT *, lag(h) OVER w AS hb, lag(s) OVER w AS sb, lag(h, 2) OVER w AS hbb, lag(s, 2) OVER w AS sbb, lead(h) OVER w AS ha, lead(s) OVER w AS sa FROM p1 WINDOW w AS (PARTITION BY symbol ORDER BY x)),
p3 AS (SELECT *, ((2 * h + ha) * s - h * sa) / (h + ha) AS f, ((2 * hb + hbb) * sb - hb * sbb) / (hb + hbb) AS l FROM p2),
p4 AS (SELECT *, CASE WHEN sb IS NULL THEN CASE WHEN sa IS NULL THEN s WHEN sign(f) <> sign(s) THEN 0 WHEN sign(s) <> sign(sa) AND abs(f) > abs(3 * s) THEN 3 * s ELSE f END
 WHEN s IS NULL THEN CASE WHEN sbb IS NULL THEN sb WHEN sign(l) <> sign(sb) THEN 0 WHEN sign(sb) <> sign(sbb) AND abs(l) > abs(3 * sb) THEN 3 * sb ELSE l END
 WHEN sb * s <= 0 THEN 0 ELSE (3 * h + 3 * hb) / ((2 * h + hb) / sb + (h + 2 * hb) / s) END AS m FROM p3),
p5 AS (SELECT *, lead(m) OVER (PARTITION BY symbol ORDER BY x) AS m1 FROM p4),
ext AS (SELECT symbol, min(x) AS low, max(x) - min(x) AS span, least(1600, greatest(200, ceil(max(x) - min(x))))::BIGINT AS steps FROM pts GROUP BY 1),
smp AS (SELECT symbol, i, low + span * i / steps AS px FROM ext, generate_series(0, 1600) g(i) WHERE i <= steps),
hit AS (SELECT smp.symbol, smp.i, px, p5.*, (px - x) / h AS u FROM smp ASOF JOIN (SELECT * FROM p5 WHERE x1 IS NOT NULL) p5 ON p5.symbol = smp.symbol AND smp.px >= p5.x)"""


@query("monotone_exceedance", f"""WITH {CURVE_SQL}, pts AS (SELECT symbol, strike AS x, above AS y FROM curve), {MONOTONE_SQL}
SELECT symbol, i, round(px, 4) AS price, round(100 * least(greatest(y, y1), greatest(least(y, y1), (2 * u ** 3 - 3 * u ** 2 + 1) * y + (u ** 3 - 2 * u ** 2 + u) * h * m + (3 * u ** 2 - 2 * u ** 3) * y1 + (u ** 3 - u ** 2) * h * m1)), 5) AS percent FROM hit""")
def monotone_exceedance(spark: SparkSession, d: str) -> DataFrame:
    """The curve of probabilities above a price, at 200 to 1,600 steps a chain."""
    rows = dist.distributions(quotes(spark, d)).where("available")
    points = rows.select("symbol", F.inline(F.arrays_zip(F.col("strikes").alias("x"), F.col("above").alias("y"))))
    curve = curves.monotone_curve(points, "symbol")
    return curve.select("symbol", "i", F.round("x", 4).alias("price"), F.round(100 * F.col("y"), 5).alias("percent"))


SURFACE_SQL = f"""{CHAIN_SQL}, w AS (SELECT id, symbol, strike, sg, is_call, 100.0::DOUBLE AS s, [9, 40, 100, 160][(id // 2 % 4 + 1)::INT] AS days, id % 3 AS volume, id % 5 AS oi, vol AS of_vol FROM chain),
w2 AS (SELECT *, days / {ivs.YEAR}::DOUBLE AS t, {ivs.RATE}::DOUBLE AS r FROM w),
q AS (SELECT id, s, strike, t, r, sg, floor({opt.price_sql('s', 'strike', 't', 'r', 'of_vol', 'sg')} * 100 + 1e-6) / 100 AS premium, symbol, is_call, days, (volume + oi)::DOUBLE AS liquid FROM w2
 WHERE days BETWEEN {ivs.LEAST_DAYS} AND {ivs.MOST_DAYS} AND volume + oi > 0 AND CASE WHEN is_call THEN strike >= {ivs.CALL_FROM} * s ELSE strike <= {ivs.PUT_TO} * s END),
{opt.implied_sql('q', 'symbol, is_call, days, liquid, s, strike, t, r')},
dl AS (SELECT *, abs({norm_cdf_sql(opt.d1_sql('s', 'strike', 't', 'r', 'vol'))} - CASE WHEN is_call THEN 0 ELSE 1 END) AS delta FROM implied WHERE vol IS NOT NULL),
b AS (SELECT symbol, days, count(*) AS n, {", ".join(f"CASE WHEN min(round(abs(delta - {x}), 9)) FILTER ({'is_call' if call else 'NOT is_call'} AND delta BETWEEN {ivs.LEAST_DELTA} AND {ivs.MOST_DELTA}) <= {ivs.NEAREST} THEN 100 * arg_min(vol, (round(abs(delta - {x}), 9), -liquid, id)) FILTER ({'is_call' if call else 'NOT is_call'} AND delta BETWEEN {ivs.LEAST_DELTA} AND {ivs.MOST_DELTA}) END AS {name}" for name, call, x in ivs.BUCKETS)} FROM dl GROUP BY 1, 2),
sm AS (SELECT symbol, days, unnest([0, 1, 2, 3, 4]) AS j, unnest([put_10, put_25, CASE WHEN put_50 IS NULL THEN call_50 WHEN call_50 IS NULL THEN put_50 ELSE (put_50 + call_50) / 2 END, call_25, call_10]) AS v FROM b
 WHERE n >= {ivs.LEAST_QUOTES} AND put_10 IS NOT NULL AND put_25 IS NOT NULL AND coalesce(put_50, call_50) IS NOT NULL AND call_25 IS NOT NULL AND call_10 IS NOT NULL),
tn AS (SELECT symbol, j, i, x, max(days) FILTER (days <= x) AS a, arg_max(v, days) FILTER (days <= x) AS va, min(days) FILTER (days > x) AS c, arg_min(v, days) FILTER (days > x) AS vc, count(*) AS m
 FROM sm CROSS JOIN (SELECT unnest(range({len(ivs.TENORS)})) AS i, unnest({list(ivs.TENORS)}::DOUBLE[]) AS x) GROUP BY ALL)"""


@query("iv_surface_build", f"WITH RECURSIVE {SURFACE_SQL} SELECT symbol, 5 * i + j AS k, round(CASE WHEN a IS NULL THEN vc WHEN c IS NULL THEN va ELSE va + (vc - va) * (x - a) / (c - a) END, 5) AS iv FROM tn WHERE m >= {ivs.LEAST_EXPIRIES}")
def iv_surface_build(spark: SparkSession, d: str) -> DataFrame:
    """Surfaces of 4 tenors by 5 delta buckets from quotes in whole cents, of four expiries of which one is too far."""
    day = F.lit("2024-01-01").cast("date")
    rows = chain(spark, d).withColumns({"d": day, "expiry": F.date_add(day, F.get(F.array(*map(F.lit, (9, 40, 100, 160))), (F.floor(F.col("id") / 2) % 4).cast("int")))})
    t = F.datediff("expiry", "d") / ivs.YEAR
    cents = F.floor(opt.price(F.col("s"), F.col("strike"), t, F.lit(ivs.RATE), F.col("vol"), F.col("is_call")) * 100 + 1e-6) / 100
    rows = rows.select("id", "symbol", "d", "expiry", "strike", "is_call", cents.alias("price"), F.col("s").alias("spot"), (F.col("id") % 3).cast("double").alias("volume"), (F.col("id") % 5).cast("double").alias("oi"))
    out = ivs.surfaces(rows)
    return out.select("symbol", F.posexplode_outer("values").alias("k", "iv")).select("symbol", F.col("k").cast("long").alias("k"), F.round("iv", 5).alias("iv"))
