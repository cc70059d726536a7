"""Volatility surfaces from option quotes: a smile of five delta buckets per expiry, interpolated to four tenors.

Defined results: quotes without a positive strike, price and spot, without volume and open interest, or whose price doesn't tell a volatility are left out, as are
calls under 97 % and puts over 103 % of the spot and expiries under 2 or over 140 days away; an expiry needs five quotes and all five buckets, a surface two
expiries; beyond the first and last expiry a tenor takes their values; of equally near deltas the more liquid counts, then the smaller id; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import options as opt
from ..functions.numeric import norm_cdf

# Fixed values.
TENORS = (14.0, 30.0, 60.0, 90.0)
BUCKETS = (("put_10", False, 0.10), ("put_25", False, 0.25), ("put_50", False, 0.50), ("call_50", True, 0.50), ("call_25", True, 0.25), ("call_10", True, 0.10))
RATE, YEAR, LEAST_DAYS, MOST_DAYS = 0.065, 365.25, 2, 140
CALL_FROM, PUT_TO, LEAST_DELTA, MOST_DELTA, NEAREST, LEAST_QUOTES, LEAST_EXPIRIES = 0.97, 1.03, 0.02, 0.98, 0.18, 5, 2


def usable(quotes: DataFrame) -> DataFrame:
    """quotes (id, symbol, d, expiry, strike, is_call, price, spot, volume, oi) with t, vol and delta, where they tell a volatility."""
    c = F.col
    days = F.datediff("expiry", "d")
    traded = (F.coalesce("volume", F.lit(0.0)) > 0) | (F.coalesce("oi", F.lit(0.0)) > 0)
    wing = F.when(c("is_call"), c("strike") >= CALL_FROM * c("spot")).otherwise(c("strike") <= PUT_TO * c("spot"))
    good = quotes.withColumn("days", days).where(c("days").between(LEAST_DAYS, MOST_DAYS) & (c("strike") > 0) & (c("price") > 0) & (c("spot") > 0) & traded & wing)
    good = good.withColumn("t", c("days") / YEAR)
    good = good.withColumn("vol", opt.implied_vol(c("price"), c("spot"), c("strike"), c("t"), F.lit(RATE), c("is_call"))).where("vol IS NOT NULL")
    return good.withColumn("delta", F.abs(norm_cdf(opt.d1(c("spot"), c("strike"), c("t"), F.lit(RATE), c("vol"))) - F.when(c("is_call"), 0.0).otherwise(1.0)))


def smiles(quotes: DataFrame) -> DataFrame:
    """(symbol, d, days, smile): the five buckets of each expiry in percent, from the 10-delta put to the 10-delta call."""
    c = F.col
    rows = usable(quotes)
    liquid = F.greatest(F.lit(0.0), F.coalesce("volume", F.lit(0.0))) + F.greatest(F.lit(0.0), F.coalesce("oi", F.lit(0.0)))
    near = {}
    for name, call, target in BUCKETS:
        off = F.round(F.abs(c("delta") - target), 9)
        place = F.when((c("is_call") == call) & c("delta").between(LEAST_DELTA, MOST_DELTA), F.struct(off.alias("off"), (-liquid).alias("l"), "id"))
        near[name] = F.when(F.min(place)["off"] <= NEAREST, F.min_by("vol", place) * 100)
    g = rows.groupBy("symbol", "d", "days").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in near.items()]).where(c("n") >= LEAST_QUOTES)
    both = F.filter(F.array("put_50", "call_50"), lambda x: x.isNotNull())
    middle = F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(both), F.lit(0))
    smile = F.array("put_10", "put_25", middle, "call_25", "call_10")
    return g.withColumn("smile", smile).where(~F.exists("smile", lambda x: x.isNull())).select("symbol", "d", "days", "smile")


def _at(tenor: float) -> Column:
    """The smile of a tenor between the expiries around it."""
    e = F.col("expiries")
    below, above = F.filter(e, lambda x: x["days"] <= tenor), F.filter(e, lambda x: x["days"] > tenor)
    a, b = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    part = (tenor - a["days"]) / (b["days"] - a["days"])
    line = F.zip_with(a["smile"], b["smile"], lambda x, y: x + part * (y - x))
    return F.when(F.size(below) == 0, b["smile"]).when(F.size(above) == 0, a["smile"]).otherwise(line)


def surfaces(quotes: DataFrame) -> DataFrame:
    """(symbol, d, values): tenors by buckets, row by row; the few expiries of a day are one array."""
    g = smiles(quotes).groupBy("symbol", "d").agg(F.array_sort(F.collect_list(F.struct("days", "smile"))).alias("expiries")).where(F.size("expiries") >= LEAST_EXPIRIES)
    return g.select("symbol", "d", F.concat(*[_at(t) for t in TENORS]).alias("values"))
