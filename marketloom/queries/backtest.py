"""Walk-forward signals and backtests of many daily price series, and forecast evaluation, each per symbol.

Every window and every aggregate has the symbol as its key, so symbols spread over tasks; one symbol's trading days
are bounded (a few thousand).
"""

from __future__ import annotations

import math
from bisect import insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..operators.ordered import top_per_group
from ..registry import query
from ..sources.tables import SUPPLIER_DAYS_SQL, supplier_days, table

LENGTH = 21
LENGTHS = (21, 63, 126, 252)
THRESHOLDS = (0.0, 0.05, 0.10, 0.15)
LEAST_HISTORY = 126
COST = 0.001
S = "1"


def by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("d")


def prices(spark: SparkSession, d: str) -> DataFrame:
    return supplier_days(spark, d).withColumn("t", F.row_number().over(by_symbol()))


PRICES_SQL = f"""{SUPPLIER_DAYS_SQL}, prices AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) AS t FROM supplier_days)"""


#: Sums over a window of the rows that have a price, with j rows back from its last one and c the log price: of 1, j, j * j, c, j * c, c * c; and the least and greatest c.
SUMS = ("n", "j", "jj", "c", "jc", "cc")
STATE = (*SUMS, "low", "high")


def joined(parts: list[dict[str, Column]], length: int) -> dict[str, Column]:
    """The sums of neighbouring windows of ``length`` rows, the newest first, as those of one window."""
    out = dict(parts[0])
    for k, p in enumerate(parts[1:], 1):
        back = float(k * length)
        moved = p | {"j": p["j"] + back * p["n"], "jj": p["jj"] + 2 * back * p["j"] + back * back * p["n"], "jc": p["jc"] + back * p["c"]}
        out |= {name: out[name] + moved[name] for name in SUMS}
    return out | {"low": F.least(*[p["low"] for p in parts]), "high": F.greatest(*[p["high"] for p in parts])}


def with_sums(df: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """``SUMS`` over the last rows of every length, each of which divides the next, as columns ``<sum>_<length>``; whole from row ``length`` of a symbol on.

    A window is put together from shorter ones some rows back (21 rows are 7 times 3, 252 are 2 times 126), so a row costs a
    few lags, not a pass over its window, and nothing is subtracted that would be left over from earlier rows.
    """
    w = by_symbol()
    y = F.ln("price")
    base = F.first(F.when(F.abs(y) < float("inf"), y), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_c", y - F.coalesce(base, F.lit(0.0)))
    c, zero = F.coalesce("_c", F.lit(0.0)), F.lit(0.0)
    one = {"n": F.col("_c").isNotNull().cast("double"), "j": zero, "jj": zero, "c": c, "jc": zero, "cc": c * c, "low": F.col("_c"), "high": F.col("_c")}
    df, length = df.withColumns({f"_{name}": v for name, v in one.items()}), 1
    own = {name: F.col(f"_{name}") for name in STATE}
    for n in lengths:
        times, left = n // length, 2
        while times > 1:
            left = next(k for k in range(left, times + 1) if times % k == 0)
            back = [f"_s{k}" for k in range(1, left)]
            packed = F.struct(*[v.alias(name) for name, v in own.items()])
            df = df.withColumns({name: F.lag(packed, k * length).over(w) for k, name in enumerate(back, 1)})
            parts = [own, *[{name: F.col(s)[name] for name in STATE} for s in back]]
            df = df.withColumns({f"_{name}": v for name, v in joined(parts, length).items()}).drop(*back)  # plain columns: fields of a struct would be worked out again at each use
            times, length = times // left, length * left
        df = df.withColumns({f"{name}_{n}": v for name, v in own.items()})
    return df.drop(*[f"_{name}" for name in STATE])


def sums_of(*lengths: int) -> list[str]:
    return [f"{name}_{n}" for n in lengths for name in STATE]


def fitted(n: int) -> tuple[Column, Column]:
    """Slope and R2 of log price on time over ``n`` rows, from their sums; no slope without two prices, and equal prices fit."""
    s = {name: F.col(f"{name}_{n}") for name in STATE}
    full, equal = (F.col("t") >= n) & (s["n"] >= 2), (s["low"] == s["high"]) & (s["high"] < float("inf"))
    both, time, price = s["j"] * s["c"] - s["n"] * s["jc"], s["n"] * s["jj"] - s["j"] * s["j"], s["n"] * s["cc"] - s["c"] * s["c"]
    slope = F.when(full, F.when(equal, 0.0).otherwise(ratio(both, time)))
    r2 = F.when(full & equal, 1.0).when(full, ratio(both * both, time * F.greatest(price, F.lit(0.0))))
    return slope, F.when(F.col("t") >= n, F.coalesce(r2, F.lit(0.0)))


def regressions(df: DataFrame, length: int = LENGTH) -> DataFrame:
    """Slope and R2 of log price on time over ``length`` rows, and their product as the score."""
    slope, r2 = fitted(length)
    df = with_sums(df, (length,)).withColumns({"slope": slope, "r2": r2}).drop(*sums_of(length))
    return df.withColumn("score", (F.exp(252 * F.col("slope")) - 1) * F.col("r2"))


def all_regressions(df: DataFrame) -> DataFrame:
    """``regressions`` of every length of ``LENGTHS`` as rows with their ``lookback``, over one sort of the series."""
    fits = []
    for n in LENGTHS:
        slope, r2 = fitted(n)
        fits.append(F.struct(F.lit(n).cast("long").alias("lookback"), slope.alias("slope"), r2.alias("r2")))
    df = with_sums(df, LENGTHS).select("symbol", "d", "price", "t", F.inline(F.array(*fits)))
    return df.withColumn("score", (F.exp(252 * F.col("slope")) - 1) * F.col("r2"))


def scores_beside(df: DataFrame) -> DataFrame:
    """The score of every length of ``LENGTHS`` as a column of its own."""
    fits = {n: fitted(n) for n in LENGTHS}
    df = with_sums(df, LENGTHS).withColumns({f"score_{n}": (F.exp(252 * slope) - 1) * r2 for n, (slope, r2) in fits.items()})
    return df.drop(*sums_of(*LENGTHS))


def reg_sql(n: int) -> str:
    return f"""{PRICES_SQL}, reg AS (SELECT *, CASE WHEN count(*) OVER w = {n} THEN regr_slope(ln(price), t) OVER w END AS slope,
  CASE WHEN count(*) OVER w = {n} THEN coalesce(regr_r2(ln(price), t) OVER w, 0) END AS r2 FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
scored AS (SELECT *, (exp(252 * slope) - 1) * r2 AS score FROM reg)"""


REG_SQL = reg_sql(LENGTH)


@query("rolling_regression", " UNION ALL ".join(f"SELECT * FROM (WITH {reg_sql(n)} SELECT {n}::BIGINT AS lookback, symbol, d, round(slope, 7) AS slope, round(r2, 6) AS r2 FROM scored)" for n in LENGTHS))
def rolling(spark: SparkSession, d: str) -> DataFrame:
    return all_regressions(prices(spark, d)).select("lookback", "symbol", "d", F.round("slope", 7).alias("slope"), F.round("r2", 6).alias("r2"))


def backtest(scored: DataFrame, threshold: float = 0.0, cost: float = COST) -> DataFrame:
    """Hold from two closes after the score exceeds the threshold; costs on changes of the position."""
    w = by_symbol()
    df = scored.withColumn("target", F.coalesce((F.col("score") > threshold).cast("double"), F.lit(0.0)))
    df = df.withColumns(
        {
            "ret": F.coalesce(F.col("price") / F.lag("price").over(w) - 1, F.lit(0.0)),
            "position": F.coalesce(F.lag("target", 2).over(w), F.lit(0.0)),
            "turnover": F.abs(F.coalesce(F.lag("target", 1).over(w), F.lit(0.0)) - F.coalesce(F.lag("target", 2).over(w), F.lit(0.0))),
        }
    )
    df = df.withColumn("net", F.col("position") * F.col("ret") - cost * F.col("turnover"))
    df = df.withColumn("equity", F.exp(F.sum(F.ln(1 + F.col("net"))).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    peak = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("drawdown", F.col("equity") / peak - 1)


def bt_sql(n: int, threshold: float) -> str:
    return f"""{reg_sql(n)}, tgt AS (SELECT *, coalesce((score > {threshold})::INT::DOUBLE, 0.0) AS target FROM scored),
pos AS (SELECT *, coalesce(price / lag(price) OVER w - 1, 0) AS ret, coalesce(lag(target, 2) OVER w, 0) AS position,
  abs(coalesce(lag(target, 1) OVER w, 0) - coalesce(lag(target, 2) OVER w, 0)) AS turnover FROM tgt WINDOW w AS (PARTITION BY symbol ORDER BY d)),
net AS (SELECT *, position * ret - {COST} * turnover AS net FROM pos),
eq AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY symbol ORDER BY d ROWS UNBOUNDED PRECEDING)) AS equity FROM net),
bt AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq)"""


BT_SQL = bt_sql(LENGTH, 0.0)


def tested(spark: SparkSession, d: str) -> DataFrame:
    return backtest(regressions(prices(spark, d)))


@query("backtest_equity", f"WITH {BT_SQL} SELECT symbol, d, position, round(net, 6) AS net, round(equity, 5) AS equity, round(drawdown, 6) AS drawdown FROM bt")
def equity(spark: SparkSession, d: str) -> DataFrame:
    return tested(spark, d).select("symbol", "d", "position", F.round("net", 6).alias("net"), F.round("equity", 5).alias("equity"), F.round("drawdown", 6).alias("drawdown"))


METRICS_SQL = """round(pow(arg_max(equity, d), 252.0 / count(*)) - 1, 5) AS cagr, round(stddev_samp(net) * sqrt(252.0), 5) AS volatility,
  round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252.0), 5) AS sharpe, round(min(drawdown), 5) AS max_drawdown, round(arg_max(equity, d) - 1, 5) AS total_return,
  round(avg(net) * 252 / nullif(sqrt(avg(pow(least(net, 0), 2))) * sqrt(252.0), 0), 5) AS sortino, round(covar_samp(net, ret) / nullif(var_samp(ret), 0), 5) AS beta, round(avg(position), 6) AS time_in_market"""


def metrics(df: DataFrame, *keys: str) -> DataFrame:
    n, last = F.count(F.lit(1)), F.max_by("equity", "d")
    root = 252.0**0.5
    down = F.sqrt(F.avg(F.pow(F.least("net", F.lit(0.0)), 2.0)))
    r5 = lambda c, name: F.round(c, 5).alias(name)
    return df.groupBy(*keys).agg(
        r5(F.pow(last, 252.0 / n) - 1, "cagr"), r5(F.stddev_samp("net") * root, "volatility"), r5(ratio(F.avg("net"), F.stddev_samp("net")) * root, "sharpe"),
        r5(F.min("drawdown"), "max_drawdown"), r5(last - 1, "total_return"), r5(ratio(F.avg("net") * 252, down * root), "sortino"),
        r5(ratio(F.covar_samp("net", "ret"), F.var_samp("ret")), "beta"), F.round(F.avg("position"), 6).alias("time_in_market"),
    )


@query("backtest_metrics", f"WITH {BT_SQL} SELECT symbol, {METRICS_SQL} FROM bt GROUP BY 1")
def bt_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics(tested(spark, d), "symbol")


GRID_SQL = "SELECT * FROM (WITH {bt} SELECT symbol, {n}::BIGINT AS lookback, {t}::DOUBLE AS threshold, round(arg_max(equity, d) - 1, 5) AS total_return, round(min(drawdown), 5) AS max_drawdown FROM bt GROUP BY 1)"


@query("backtest_grid", " UNION ALL ".join(GRID_SQL.format(bt=bt_sql(n, t), n=n, t=t) for n in LENGTHS for t in THRESHOLDS))
def bt_grid(spark: SparkSession, d: str) -> DataFrame:
    """All lookbacks and thresholds beside each other in the rows of a symbol, so one sort of its days serves the whole grid."""
    w = by_symbol()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    cells = [(n, k, t) for n in LENGTHS for k, t in enumerate(THRESHOLDS)]
    each = {f"{n}_{k}": (F.col(f"score_{n}"), t) for n, k, t in cells}
    df = scores_beside(prices(spark, d)).withColumn("ret", F.coalesce(F.col("price") / F.lag("price").over(w) - 1, F.lit(0.0)))
    df = df.withColumns({f"target_{c}": F.coalesce((score > t).cast("double"), F.lit(0.0)) for c, (score, t) in each.items()})
    before = lambda c, n: F.coalesce(F.lag(f"target_{c}", n).over(w), F.lit(0.0))
    df = df.withColumns({f"net_{c}": before(c, 2) * F.col("ret") - COST * F.abs(before(c, 1) - before(c, 2)) for c in each})
    df = df.withColumns({f"equity_{c}": F.exp(F.sum(F.ln(1 + F.col(f"net_{c}"))).over(upto)) for c in each})
    df = df.withColumns({f"drawdown_{c}": F.col(f"equity_{c}") / F.max(f"equity_{c}").over(upto) - 1 for c in each})
    results = [F.struct((F.max_by(f"equity_{c}", "d") - 1).alias("total"), F.min(f"drawdown_{c}").alias("worst")).alias(f"r_{c}") for c in each]
    rows = F.array(*[F.struct(F.lit(n).cast("long").alias("lookback"), F.lit(t).alias("threshold"), F.col(f"r_{n}_{k}").alias("r")) for n, k, t in cells])
    out = df.groupBy("symbol").agg(*results).select("symbol", F.inline(rows))
    return out.select("symbol", "lookback", "threshold", F.round("r.total", 5).alias("total_return"), F.round("r.worst", 5).alias("max_drawdown"))


def _versus(net: str, equity: str, drawdown: str) -> dict[str, Column]:
    """The four measures that signal and benchmark are compared by."""
    n, root = F.count(F.lit(1)), 252.0**0.5
    down = F.sqrt(F.avg(F.pow(F.least(net, F.lit(0.0)), 2.0)))
    return {"cagr": F.pow(F.max_by(equity, "d"), 252.0 / n) - 1, "sharpe": ratio(F.avg(net), F.stddev_samp(net)) * root, "sortino": ratio(F.avg(net) * 252, down * root), "drawdown": F.min(drawdown)}


def _versus_sql(net: str, equity: str, drawdown: str, suffix: str) -> str:
    return f"""pow(arg_max({equity}, d), 252.0 / count(*)) - 1 AS cagr{suffix}, avg({net}) / nullif(stddev_samp({net}), 0) * sqrt(252.0) AS sharpe{suffix},
 avg({net}) * 252 / nullif(sqrt(avg(pow(least({net}, 0), 2))) * sqrt(252.0), 0) AS sortino{suffix}, min({drawdown}) AS drawdown{suffix}"""


MEASURES = ("cagr", "sharpe", "sortino", "drawdown")


@query("cross_market_report", f"""WITH {BT_SQL}, hold AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY d ROWS UNBOUNDED PRECEDING)) AS held FROM bt), h2 AS (SELECT *, held / max(held) OVER (PARTITION BY symbol ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM hold),
m AS (SELECT symbol, {_versus_sql('net', 'equity', 'drawdown', '')}, {_versus_sql('ret', 'held', 'fall', '_b')} FROM h2 GROUP BY 1), v AS (SELECT symbol % 5 AS market, {', '.join(f'{c} - {c}_b AS {c}_delta' for c in MEASURES)} FROM m)
SELECT market, count(*) AS n, {', '.join(f'round(avg(coalesce({c}_delta > 0, false)::INT), 6) AS {c}_win_rate, round(quantile_cont({c}_delta, 0.5), 5) AS median_{c}_delta' for c in MEASURES)} FROM v GROUP BY 1""")
def cross_market_report(spark: SparkSession, d: str) -> DataFrame:
    """By market: how often the signal beats holding, and by how much at the median."""
    upto = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    df = tested(spark, d).withColumn("held", F.exp(F.sum(F.ln(1 + F.col("ret"))).over(upto)))
    df = df.withColumn("fall", F.col("held") / F.max("held").over(upto) - 1)
    own, bench = _versus("net", "equity", "drawdown"), _versus("ret", "held", "fall")
    deltas = df.groupBy("symbol").agg(*[(own[c] - bench[c]).alias(f"{c}_delta") for c in MEASURES]).withColumn("market", F.col("symbol") % 5)
    out = []
    for c in MEASURES:
        delta = F.col(f"{c}_delta")
        out += [F.round(F.avg(F.coalesce(delta > 0, F.lit(False)).cast("int")), 6).alias(f"{c}_win_rate"), F.round(F.percentile(delta, F.lit(0.5)), 5).alias(f"median_{c}_delta")]
    return deltas.groupBy("market").agg(F.count(F.lit(1)).alias("n"), *out)


def expanding_medians(scores: list[float | None], least: int = LEAST_HISTORY) -> list[float | None]:
    """The median of the known scores before each place, NaN counting as the largest; null before ``least`` of them."""
    held: list[float] = []
    unordered, out = 0, []
    for x in scores:
        n = len(held) + unordered
        low, high = (n - 1) // 2, n // 2
        place = lambda k: held[k] if k < len(held) else math.nan
        out.append(None if n < least else place(low) if low == high else 0.5 * place(low) + 0.5 * place(high))
        if x is not None and x != x:
            unordered += 1
        elif x is not None:
            insort(held, x)
    return out


@query("expanding_quantile_cutoff", f"WITH {REG_SQL} SELECT symbol, d, round(CASE WHEN count(score) OVER p >= {LEAST_HISTORY} THEN quantile_cont(score, 0.5) OVER p END, 5) + 0.0::DOUBLE AS cutoff FROM scored WINDOW p AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def expanding(spark: SparkSession, d: str) -> DataFrame:
    """The median of all scores before each day: a symbol's scores are kept in order as they come, where a window would sort them anew each day."""
    rows = regressions(prices(spark, d)).select("symbol", F.to_date("d").alias("d"), "score")

    def medians(t: pa.Table) -> pa.Table:
        t = t.sort_by("d")
        return pa.table({"symbol": t.column("symbol"), "d": t.column("d"), "cutoff": pa.array(expanding_medians(t.column("score").to_pylist()), pa.float64())})

    kind = rows.schema["symbol"].dataType.simpleString()
    out = rows.groupBy("symbol").applyInArrow(medians, f"symbol {kind}, d date, cutoff double")
    return out.select("symbol", "d", (F.round("cutoff", 5) + F.lit(0.0)).alias("cutoff"))


@query("entries_exits", f"WITH {BT_SQL} SELECT symbol, count(*) FILTER (position > p) AS entries, count(*) FILTER (position < p) AS exits, round(sum(turnover), 6) AS turnover FROM (SELECT *, lag(position, 1, 0.0) OVER (PARTITION BY symbol ORDER BY d) AS p FROM bt) GROUP BY 1")
def entries(spark: SparkSession, d: str) -> DataFrame:
    df = tested(spark, d).withColumn("p", F.lag("position", 1, 0.0).over(by_symbol()))
    return df.groupBy("symbol").agg(F.count_if(F.col("position") > F.col("p")).alias("entries"), F.count_if(F.col("position") < F.col("p")).alias("exits"), F.round(F.sum("turnover"), 6).alias("turnover"))


@query("returns_by_year_quarter", f"WITH {BT_SQL} SELECT symbol, year(d) AS y, quarter(d) AS q, round(exp(sum(ln(1 + net))) - 1, 6) AS compounded FROM bt GROUP BY 1, 2, 3")
def by_quarter(spark: SparkSession, d: str) -> DataFrame:
    return tested(spark, d).groupBy("symbol", F.year("d").cast("long").alias("y"), F.quarter("d").cast("long").alias("q")).agg(F.round(F.exp(F.sum(F.ln(1 + F.col("net")))) - 1, 6).alias("compounded"))


@query("missed_and_held_extremes", f"WITH {BT_SQL} SELECT symbol, arg_max(d, ret) FILTER (position = 0) AS best_missed, arg_min(d, ret) FILTER (position = 1) AS worst_held FROM bt GROUP BY 1")
def extremes(spark: SparkSession, d: str) -> DataFrame:
    df = tested(spark, d)
    missed, held = F.when(F.col("position") == 0, F.col("ret")), F.when(F.col("position") == 1, F.col("ret"))
    return df.groupBy("symbol").agg(F.max_by("d", missed).alias("best_missed"), F.min_by("d", held).alias("worst_held"))


@query("weekly_last", f"WITH {PRICES_SQL} SELECT symbol, (date_trunc('week', d) + INTERVAL 4 DAY)::DATE AS week_end, max(d) AS d, round(arg_max(price, d), 4) AS price FROM prices GROUP BY 1, 2")
def weekly(spark: SparkSession, d: str) -> DataFrame:
    friday = F.date_add(F.trunc("d", "week"), 4)
    return prices(spark, d).groupBy("symbol", friday.alias("week_end")).agg(F.max("d").alias("d"), F.round(F.max_by("price", "d"), 4).alias("price"))


@query("sd_summary", f"""WITH {BT_SQL}, s AS (SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS sd FROM bt GROUP BY 1) SELECT symbol, round(avg(ret), 6) AS mean, round(quantile_cont(ret, 0.5), 6) AS median, round(quantile_cont(ret, 0.1), 6) AS p10,
 round(quantile_cont(ret, 0.9), 6) AS p90, round(avg((abs(ret) > 0.01)::INT), 6) AS above_1pc, round(avg((abs(ret - m) <= sd)::INT), 6) AS within_1, round(avg((abs(ret - m) <= 2 * sd)::INT), 6) AS within_2 FROM bt JOIN s USING (symbol) GROUP BY 1""")
def sd_summary(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol")
    each = tested(spark, d).select("symbol", "ret", F.avg("ret").over(w).alias("m"), F.stddev_samp("ret").over(w).alias("sd"))
    share = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    p = lambda q, n: F.round(F.percentile("ret", F.lit(q)), 6).alias(n)
    off = F.abs(F.col("ret") - F.col("m"))
    return each.groupBy("symbol").agg(F.round(F.avg("ret"), 6).alias("mean"), p(0.5, "median"), p(0.1, "p10"), p(0.9, "p90"), share(F.abs("ret") > 0.01, "above_1pc"), share(off <= F.col("sd"), "within_1"), share(off <= 2 * F.col("sd"), "within_2"))


FORECAST_SQL = f"""{REG_SQL}, f AS (SELECT symbol, d, 1 / (1 + exp(-greatest(-5, least(5, score)))) AS p, (lead(price) OVER (PARTITION BY symbol ORDER BY d) > price)::INT AS y FROM scored), fc AS (SELECT * FROM f WHERE p IS NOT NULL AND y IS NOT NULL)"""


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    up = (F.lead("price").over(by_symbol()) > F.col("price")).cast("int")
    df = regressions(prices(spark, d)).withColumn("y", up)
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.col("score")))))
    return df.withColumn("p", p).where("p IS NOT NULL AND y IS NOT NULL").select("symbol", "d", "p", "y")


@query("brier_logloss", f"WITH {FORECAST_SQL} SELECT symbol, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier, round(-avg(y * ln(greatest(least(p, 1 - 1e-7), 1e-7)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-7), 1e-7))), 6) AS log_loss, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS hit_rate FROM fc GROUP BY 1")
def brier(spark: SparkSession, d: str) -> DataFrame:
    c = F.greatest(F.least("p", F.lit(1 - 1e-7)), F.lit(1e-7))
    loss = -F.avg(F.col("y") * F.ln(c) + (1 - F.col("y")) * F.ln(1 - c))
    hit = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")
    return forecasts(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2.0)), 6).alias("brier"), F.round(loss, 6).alias("log_loss"), F.round(F.avg(hit), 6).alias("hit_rate"))


@query("calibration_bins", f"""WITH {FORECAST_SQL}, e AS (SELECT symbol, quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS q FROM fc GROUP BY 1),
b AS (SELECT symbol, p, y, (p > q[1])::INT + (p > q[2])::INT + (p > q[3])::INT + (p > q[4])::INT AS bin FROM fc JOIN e USING (symbol))
SELECT symbol, bin::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM b GROUP BY 1, 2""")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts of a symbol in five bins of equal numbers, what they said and what came."""
    edges = F.percentile("p", F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).over(Window.partitionBy("symbol"))
    b = forecasts(spark, d).withColumn("q", edges).withColumn("bin", F.size(F.filter("q", lambda x: F.col("p") > x)).cast("long"))
    return b.groupBy("symbol", "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg("y"), 6).alias("observed"))


@query("ewm_std_21", f"""WITH RECURSIVE {PRICES_SQL}, x AS (SELECT symbol, d, ln(price) AS x, t FROM prices),
f AS (SELECT symbol, t, d, x AS m, 0.0::DOUBLE AS c, 1.0::DOUBLE AS s FROM x WHERE t = 1 UNION ALL SELECT x.symbol, x.t, x.d, f.m + {2 / 22} * (x.x - f.m),
  (1 - {2 / 22}) * (f.c + pow({2 / 22} * (x.x - f.m), 2)) + {2 / 22} * pow((1 - {2 / 22}) * (x.x - f.m), 2), pow(1 - {2 / 22}, 2) * f.s + pow({2 / 22}, 2) FROM f JOIN x ON x.symbol = f.symbol AND x.t = f.t + 1)
SELECT symbol, d, CASE WHEN t >= 21 THEN round(sqrt(c / (1 - s)), 6) END AS ewm_std FROM f""")
def ewm_std(spark: SparkSession, d: str) -> DataFrame:
    """The rolling deviation of every day, as a fold over one symbol's days; the first 20 days have none."""
    a = 2 / 22
    days = prices(spark, d).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("d", F.ln("price").alias("x")))).alias("v"))

    def step(s, v):
        off = v - s["m"]
        c = (1 - a) * (s["c"] + F.pow(a * off, F.lit(2.0))) + a * F.pow((1 - a) * off, F.lit(2.0))
        return F.struct((s["m"] + a * off).alias("m"), c.alias("c"), ((1 - a) ** 2 * s["s"] + a * a).alias("s"), (s["n"] + 1).alias("n"))

    zero = F.struct(F.get("v.x", F.lit(0)).alias("m"), F.lit(0.0).alias("c"), F.lit(1.0).alias("s"), F.lit(1).alias("n"))
    folded = F.aggregate(F.slice("v.x", 2, F.size("v")), F.array(zero), lambda ss, v: F.concat(ss, F.array(step(F.element_at(ss, -1), v))))
    rows = days.select("symbol", F.inline(F.arrays_zip(F.col("v.d").alias("d"), folded.alias("s"))))
    return rows.select("symbol", "d", F.round(F.when(F.col("s.n") >= LENGTH, F.sqrt(F.col("s.c") / (1 - F.col("s.s")))), 6).alias("ewm_std"))


@query("direct_horizon_features", f"""WITH {PRICES_SQL} SELECT symbol, d, round(ln(price / lag(price) OVER w), 6) AS r1, round(ln(price / avg(price) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), 6) AS vs_mean,
 round(ln(lead(price, 1) OVER w / price), 6) AS h1, round(ln(lead(price, 5) OVER w / price), 6) AS h5 FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY d)""")
def horizon(spark: SparkSession, d: str) -> DataFrame:
    w = by_symbol()
    p = F.col("price")
    ln6 = lambda c, n: F.round(F.ln(c), 6).alias(n)
    return prices(spark, d).select("symbol", "d", ln6(p / F.lag("price").over(w), "r1"), ln6(p / F.avg("price").over(w.rowsBetween(-19, 0)), "vs_mean"), ln6(F.lead("price", 1).over(w) / p, "h1"), ln6(F.lead("price", 5).over(w) / p, "h5"))


@query("beta_binomial_adjust", """WITH h AS (SELECT user_id, list((value > 100)::INT ORDER BY ts, event_id) AS hits, avg((value > 100)::INT) AS p FROM events GROUP BY 1),
w AS (SELECT user_id, p, hits, greatest(2, least(63, ceil(1 / greatest(p, 0.001))::INT)) AS n FROM h)
SELECT user_id, round((20 * p + list_sum(hits[-least(n, len(hits)):])) / (20 + least(n, len(hits))), 6) AS adjusted FROM w""")
def beta_binomial(spark: SparkSession, d: str) -> DataFrame:
    """Only the last 63 hits of a user can count, so no more are collected; the rate comes from a plain average."""
    ev = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") > 100).cast("int").alias("h"))
    last = top_per_group(ev, ["user_id"], [F.desc("ts"), F.desc("event_id")], 63)
    last = last.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "h")))["h"].alias("hits"))
    h = ev.groupBy("user_id").agg(F.avg("h").alias("p")).join(last.withColumnRenamed("user_id", "u"), F.col("user_id").eqNullSafe(F.col("u")))
    n = F.least(F.size("hits"), F.greatest(F.lit(2), F.least(F.lit(63), F.ceil(1 / F.greatest("p", F.lit(0.001))).cast("int"))))
    h = h.withColumn("n", n).withColumn("s", F.aggregate(F.slice("hits", F.size("hits") - F.col("n") + 1, F.col("n")), F.lit(0), lambda a, x: a + x))
    return h.select("user_id", F.round((20 * F.col("p") + F.col("s")) / (20 + F.col("n")), 6).alias("adjusted"))
