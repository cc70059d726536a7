"""Direct-horizon regressions: features of a session predict the log return some sessions ahead, one fit per symbol and horizon.

Least squares from aggregated moments (one pass, no Python); the validation fits the first 80 % less the horizon, so no target of
the training rows reaches into the test rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table

HORIZONS = (1, 2, 3, 4, 5)
SPAN, LEAST_CANDLES, LEAST_ROWS = 20, 100, 60
FEATURES = ("f1", "f2", "f3")

#: Slopes of three features by Cramer's rule from their (co)variances ``s..`` and their covariances ``g.`` with the target.
DET = "(s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s23 * s13) + s13 * (s12 * s23 - s22 * s13))"
SLOPES = {
    "b1": f"(g1 * (s22 * s33 - s23 * s23) - s12 * (g2 * s33 - s23 * g3) + s13 * (g2 * s23 - s22 * g3)) / nullif({DET}, 0)",
    "b2": f"(s11 * (g2 * s33 - s23 * g3) - g1 * (s12 * s33 - s23 * s13) + s13 * (s12 * g3 - g2 * s13)) / nullif({DET}, 0)",
    "b3": f"(s11 * (s22 * g3 - g2 * s23) - s12 * (s12 * g3 - g2 * s13) + g1 * (s12 * s23 - s22 * s13)) / nullif({DET}, 0)",
}
PAIRS = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a <= b]


def with_features(candles: DataFrame) -> DataFrame:
    """candles (symbol, d, high, low, close, volume) with i (from 1), n, momentum f1, relative volume f2 and gap to the rolling VWAP f3."""
    w = Window.partitionBy("symbol").orderBy("d")
    span = w.rowsBetween(-(SPAN - 1), 0)
    v, c = F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(0.0)), F.col("close")
    df = candles.where(" AND ".join(f"{c} > 0 AND {c} < double('inf')" for c in ("high", "low", "close"))).withColumns({"v": v, "typical": (F.col("high") + F.col("low") + c) / 3})
    total = F.sum("v").over(span)
    vwap = F.when(total > 0, F.sum(F.col("typical") * F.col("v")).over(span) / F.nullif(total, F.lit(0.0))).otherwise(F.avg("typical").over(span))
    return df.select(
        "symbol", "d", "close", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n"), F.ln(c / F.lag(c).over(w)).alias("f1"),
        F.ln(F.greatest("v", F.lit(1.0)) / F.greatest(F.avg("v").over(span), F.lit(1.0))).alias("f2"), F.ln(c / vwap).alias("f3"),
        *[F.ln(F.lead(c, h).over(w) / c).alias(f"y{h}") for h in HORIZONS],
    )


def fits(df: DataFrame, used) -> DataFrame:
    """Slopes and intercept per symbol and horizon over the rows where ``used`` holds, and their number."""
    at = {k: F.when(used, F.col(k)) for k in (*FEATURES, "y")}
    moments = [F.covar_pop(at[f"f{a}"], at[f"f{b}"]).alias(f"s{a}{b}") for a, b in PAIRS]
    moments += [F.covar_pop(at[f], at["y"]).alias(f"g{f[1]}") for f in FEATURES]
    m = df.groupBy("symbol", "h").agg(*moments, *[F.avg(c).alias(f"m{k}") for k, c in at.items()], F.count(at["y"]).alias("rows"))
    m = m.select("*", *[F.expr(e).alias(k) for k, e in SLOPES.items()])
    return m.select("symbol", "h", "b1", "b2", "b3", F.expr("my - b1 * mf1 - b2 * mf2 - b3 * mf3").alias("b0"), "rows")


def horizon_regressions(candles: DataFrame) -> DataFrame:
    """Per symbol and horizon: rows of the fit, predicted log return (within 0.5 either way) and price, R2 and mean absolute percent error of the validation.

    Symbols of fewer than 100 candles and fits of fewer than 60 rows give no row, nor does a feature without variance; a validation with
    fewer than 40 training or 10 test rows is null.
    """
    wide = with_features(candles).where((F.col("n") >= LEAST_CANDLES) & (F.col("i") > SPAN))
    ahead = F.inline(F.array(*[F.struct(F.lit(h).cast("long").alias("h"), F.col(f"y{h}").alias("y")) for h in HORIZONS]))
    df = wide.select("symbol", "i", "n", "close", *FEATURES, ahead)
    r, rows = F.col("i") - SPAN, F.col("n") - F.col("h") - SPAN
    df = df.withColumn("split", F.greatest(F.lit(40).cast("long"), F.floor(rows * 4 / 5)))
    valid = (F.col("split") - F.col("h") >= 40) & (rows - F.col("split") >= 10)
    train, test = valid & (r <= F.col("split") - F.col("h")), valid & (r > F.col("split")) & F.col("y").isNotNull()
    predicted = F.expr("b0 + b1 * f1 + b2 * f2 + b3 * f3")
    tested = df.where(test).join(fits(df, train).drop("rows"), ["symbol", "h"]).withColumn("p", predicted)
    error, off = F.pow(F.col("y") - F.col("p"), 2.0), F.abs(F.exp("p") - F.exp("y"))
    spread = F.var_pop("y") * F.count("y")
    scores = tested.groupBy("symbol", "h").agg(F.when(spread > 1e-12, 1 - F.sum(error) / spread).alias("r2"), (F.avg(off) * 100).alias("mae"))
    latest = df.where("i = n").select("symbol", "h", "close", *FEATURES)
    all_rows = fits(df, F.col("y").isNotNull()).where((F.col("rows") >= LEAST_ROWS) & F.col("b1").isNotNull())
    out = all_rows.join(latest, ["symbol", "h"]).join(scores, ["symbol", "h"], "left")
    out = out.withColumn("p", F.greatest(F.lit(-0.5), F.least(F.lit(0.5), predicted)))
    return out.select("symbol", "h", "rows", F.col("p").alias("predicted"), (F.col("close") * F.exp("p")).alias("price"), "r2", "mae")


def _fits_sql(name: str, used: str) -> str:
    moments = [f"covar_pop(f{a}, f{b}) AS s{a}{b}" for a, b in PAIRS] + [f"covar_pop({f}, y) AS g{f[1]}" for f in FEATURES] + [f"avg({k}) AS m{k}" for k in (*FEATURES, "y")]
    slopes = ", ".join(f"{e} AS {k}" for k, e in SLOPES.items())
    return f"""{name}_m AS (SELECT symbol, h, {", ".join(moments)}, count(*) AS "rows" FROM x WHERE y IS NOT NULL AND {used} GROUP BY 1, 2),
{name}_b AS (SELECT *, {slopes} FROM {name}_m), {name} AS (SELECT *, my - b1 * mf1 - b2 * mf2 - b3 * mf3 AS b0 FROM {name}_b)"""


HORIZON_SQL = f"""WITH c AS (SELECT o_orderpriority AS symbol, o_orderdate::DATE AS d, max(o_totalprice) AS high, min(o_totalprice) AS low, avg(o_totalprice) AS close, count(*)::DOUBLE AS v FROM orders GROUP BY 1, 2),
t AS (SELECT *, (high + low + close) / 3 AS typical, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM c),
f AS (SELECT *, ln(close / lag(close) OVER w) AS f1, ln(greatest(v, 1) / greatest(avg(v) OVER k, 1)) AS f2, ln(close / (sum(typical * v) OVER k / sum(v) OVER k)) AS f3
 FROM t WINDOW w AS (PARTITION BY symbol ORDER BY d), k AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN {SPAN - 1} PRECEDING AND CURRENT ROW)),
x0 AS ({" UNION ALL ".join(f"SELECT *, {h}::BIGINT AS h, ln(lead(close, {h}) OVER (PARTITION BY symbol ORDER BY d) / close) AS y FROM f" for h in HORIZONS)}),
x AS (SELECT *, i - {SPAN} AS r, n - h - {SPAN} AS rs, greatest(40, ((n - h - {SPAN}) * 4) // 5) AS split FROM x0 WHERE i > {SPAN} AND n >= {LEAST_CANDLES}),
{_fits_sql("whole", "true")}, {_fits_sql("train", "r <= split - h AND split - h >= 40 AND rs - split >= 10")},
p AS (SELECT x.symbol, x.h, y, b0 + b1 * f1 + b2 * f2 + b3 * f3 AS p FROM x JOIN train USING (symbol, h) WHERE r > split AND y IS NOT NULL),
scores AS (SELECT symbol, h, CASE WHEN var_pop(y) * count(*) > 1e-12 THEN 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) END AS r2, avg(abs(exp(p) - exp(y))) * 100 AS mae FROM p GROUP BY 1, 2),
z AS (SELECT x.symbol, x.h, "rows", close, greatest(-0.5, least(0.5, b0 + b1 * f1 + b2 * f2 + b3 * f3)) AS p FROM x JOIN whole USING (symbol, h) WHERE i = n AND "rows" >= {LEAST_ROWS} AND b1 IS NOT NULL)
SELECT symbol, h, "rows", round(p, 6) AS predicted, round(close * exp(p), 3) AS price, round(r2, 6) AS r2, round(mae, 5) AS mae FROM z LEFT JOIN scores USING (symbol, h)"""


@query("horizon_regression", HORIZON_SQL)
def horizon_regression(spark: SparkSession, d: str) -> DataFrame:
    """Daily candles of each order priority."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("d"))
    p = F.col("o_totalprice")
    candles = o.agg(F.max(p).alias("high"), F.min(p).alias("low"), F.avg(p).alias("close"), F.count(p).cast("double").alias("volume"))
    out = horizon_regressions(candles)
    return out.select("symbol", "h", "rows", F.round("predicted", 6).alias("predicted"), F.round("price", 3).alias("price"), F.round("r2", 6).alias("r2"), F.round("mae", 5).alias("mae"))
