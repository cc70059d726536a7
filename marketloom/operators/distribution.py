"""Risk-neutral price distributions of option chains: leg choice, filters, a weighted decreasing fit, ranges and a quality score.

Defined results: strikes without a usable volatility (0 to 200 percent) on the preferred or the other leg, without volume and open
interest, or with a relative spread over one half are left out; a quote whose bid and ask can't be told has no spread; a chain with fewer than three
strikes, without spot or time, or with fewer than three usable strikes is not available and has null ranges; of several quotes of one strike
and side the one that sorts first by (iv, volume, oi, bid, ask) counts, nulls last; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.options import prob_above
from .curves import decreasing_fit

# Fixed values.
MOST_IV, WIDEST, LEAST_STRIKES, LEAST_WEIGHT = 200.0, 0.5, 3, 0.1
LEVELS = {"median_price": 0.5, "range_50_low": 0.25, "range_50_high": 0.75, "range_80_low": 0.1, "range_80_high": 0.9}
LEG = ("iv", "volume", "oi", "bid", "ask")


def relative_spread(bid: Column, ask: Column) -> Column:
    return F.when((bid >= 0) & (ask > 0) & (ask >= bid), (ask - bid) / ((ask + bid) / 2))


def observations(quotes: DataFrame) -> DataFrame:
    """A row for each strike: its usable leg, whether it trades, its spread, probability above and weight.

    ``quotes``: symbol, strike, is_call, iv (percent), volume, oi, bid, ask, spot, t (years), r.
    """
    c = F.col
    leg = F.struct(*LEG)
    order = F.struct(*[x for n in LEG for x in (c(n).isNull(), c(n))])
    legs = quotes.where("strike IS NOT NULL").groupBy("symbol", "strike").agg(
        F.min_by(leg, F.when(c("is_call"), order)).alias("call"), F.min_by(leg, F.when(~c("is_call"), order)).alias("put"), F.max("spot").alias("spot"), F.max("t").alias("t"), F.max("r").alias("r")
    )
    below = c("strike") < c("spot")
    usable = lambda leg: F.when((leg["iv"] > 0) & (leg["iv"] <= MOST_IV), leg)
    first, second = F.when(below, c("put")).otherwise(c("call")), F.when(below, c("call")).otherwise(c("put"))
    one = legs.withColumn("leg", F.coalesce(usable(first), usable(second))).select("symbol", "strike", "spot", "t", "r", "leg.*")
    volume, oi = F.coalesce("volume", F.lit(0.0)), F.coalesce("oi", F.lit(0.0))
    spread = relative_spread(c("bid"), c("ask"))
    active = c("iv").isNotNull() & ((volume > 0) | (oi > 0))
    weight = F.greatest(F.lit(LEAST_WEIGHT), F.log1p(volume + oi) / (1 + 4 * F.coalesce(spread, F.lit(0.0))))
    known = (c("spot") > 0) & (c("t") > 0)
    return one.select(
        "symbol",
        "strike",
        "spot",
        c("iv").isNotNull().alias("has_iv"),
        active.alias("active"),
        spread.alias("spread"),
        F.when(known & active & (F.coalesce(spread, F.lit(0.0)) <= WIDEST), prob_above(c("spot"), c("strike"), c("t"), c("r"), c("iv") / 100)).alias("raw"),
        weight.alias("weight"),
    )


def quantile(level: float) -> Column:
    """The price that the distribution of the columns strikes and above passes with probability 1 - level."""
    e, k, target = F.col("above"), F.col("strikes"), F.lit(1 - level)
    n = F.size(e)
    at = F.filter(F.sequence(F.lit(0), n - 2), lambda i: (F.get(e, i) >= target) & (target >= F.get(e, i + 1)))
    i = F.get(at, F.lit(0))
    width = F.get(e, i) - F.get(e, i + 1)
    part = F.when(width == 0, 0.5).otherwise((F.get(e, i) - target) / F.nullif(width, F.lit(0.0)))
    return F.when(target >= F.get(e, F.lit(0)), F.get(k, F.lit(0))).when(target <= F.get(e, n - 1), F.get(k, n - 1)).otherwise(F.get(k, i) + part * (F.get(k, i + 1) - F.get(k, i)))


def above_price(price: Column) -> Column:
    """The probability above a price, linear between strikes and level outside of them."""
    e, k = F.col("above"), F.col("strikes")
    n = F.size(e)
    i = F.get(F.filter(F.sequence(F.lit(0), n - 2), lambda j: (F.get(k, j) <= price) & (price <= F.get(k, j + 1))), F.lit(0))
    line = F.get(e, i) + (price - F.get(k, i)) / (F.get(k, i + 1) - F.get(k, i)) * (F.get(e, i + 1) - F.get(e, i))
    return F.when(price <= F.get(k, F.lit(0)), F.get(e, F.lit(0))).when(price >= F.get(k, n - 1), F.get(e, n - 1)).otherwise(line)


def distributions(quotes: DataFrame) -> DataFrame:
    """A row for each symbol: strikes and probabilities above them, levels, coverage and quality."""
    c = F.col
    rows = observations(quotes)
    used = F.when(c("raw").isNotNull(), F.struct("strike", "raw", "weight", "spread"))
    g = rows.groupBy("symbol").agg(
        F.max("spot").alias("spot"),
        F.count(F.lit(1)).alias("total_strikes"),
        F.count_if("has_iv").alias("valid"),
        F.count_if("active").alias("trading"),
        F.array_sort(F.collect_list(used)).alias("o"),
    )
    g = g.withColumn("above", decreasing_fit(F.col("o.raw"), F.col("o.weight"))).withColumns({"strikes": c("o.strike"), "strikes_used": F.size("o").cast("long")})
    available = (c("total_strikes") >= LEAST_STRIKES) & (c("strikes_used") >= LEAST_STRIKES)
    spreads = F.sort_array(F.filter(c("o.spread"), lambda x: x.isNotNull()))
    middle = F.get(spreads, F.floor(F.size(spreads) / 2).cast("int"))
    iv, active = c("valid") / c("total_strikes"), c("trading") / c("total_strikes")
    score = F.round(100 * (0.4 * iv + 0.35 * active + 0.25 * F.greatest(F.lit(0.0), 1 - F.least(F.coalesce(F.nullif(middle, F.lit(0.0)), F.lit(0.5)), F.lit(1.0)))), 1)
    moved = F.size(F.filter(F.zip_with(c("o.raw"), c("above"), lambda a, b: F.abs(a - b) > 1e-8), lambda x: x)).cast("long")
    told = lambda x: F.when(available, x)
    out = {
        "available": available,
        "strikes": told(c("strikes")),
        "above": told(c("above")),
        "iv_coverage": iv * 100,
        "active_coverage": active * 100,
        "median_spread": told(middle * 100),
        "quality_score": told(score),
        "quality_label": F.when(~available, "unavailable").when(score >= 75, "high").when(score >= 50, "medium").otherwise("low"),
        "adjustments": told(moved),
        "above_spot": told(above_price(c("spot"))),
    } | {n: told(quantile(q)) for n, q in LEVELS.items()}
    return g.select("symbol", "spot", "total_strikes", "strikes_used", *[v.alias(n) for n, v in out.items()])


def ranges(distribution: DataFrame) -> DataFrame:
    """(symbol, i, low, high, price, probability, likeliest): the ranges of available distributions, tails with a null bound."""
    c = F.col
    k, e = c("strikes"), c("above")
    n = F.size(k)
    steps = F.sort_array(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.get(k, i + 1) - F.get(k, i)))
    step = F.get(steps, F.floor((n - 1) / 2).cast("int"))
    bound = lambda i: F.get(k, i)
    inner = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.struct(
            i.cast("long").alias("i"),
            F.when(i > 0, bound(i - 1)).alias("low"),
            F.when(i < n, bound(i)).alias("high"),
            F.when(i == 0, bound(F.lit(0)) - step / 2).when(i == n, bound(n - 1) + step / 2).otherwise((bound(i - 1) + bound(i)) / 2).alias("price"),
            F.round(F.when(i == 0, 1 - F.get(e, F.lit(0))).when(i == n, F.get(e, n - 1)).otherwise(F.greatest(F.lit(0.0), F.get(e, i - 1) - F.get(e, i))), 6).alias("probability"),
        ),
    )
    rows = distribution.where("available").select("symbol", inner.alias("r"))
    best = F.array_max(F.transform("r", lambda x: F.struct(x["probability"], (-x["i"]).alias("i"))))
    rows = rows.withColumn("best", -best["i"]).select("symbol", "best", F.inline("r"))
    return rows.select("symbol", "i", "low", "high", "price", "probability", (c("i") == c("best")).alias("likeliest"))
