"""Paper-trade ledgers: marks, exits, thinning, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import latest_per_key
from ..registry import query
from ..sources.tables import nearest_second, table

MARKS_SQL = """raw AS (SELECT l_orderkey AS trade, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
  l_extendedprice / l_quantity AS price, l_discount AS p, (l_tax - 0.04) * 50 AS z FROM lineitem),
marks AS (SELECT *, first_value(price) OVER w AS entry, first_value(z) OVER w AS z0 FROM raw WINDOW w AS (PARTITION BY trade ORDER BY seq)),
reasons AS (SELECT *, CASE WHEN p > 0.08 THEN 'p_value' WHEN z0 > 0 AND z <= 0.1 THEN 'z_cross' WHEN z0 < 0 AND z >= -0.1 THEN 'z_cross' END AS reason FROM marks WHERE seq > 1)"""


def marks(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as the ordered marks of a trade; the first line is the entry."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    m = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("trade"), F.row_number().over(order).cast("long").alias("seq"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_discount").alias("p"), ((F.col("l_tax") - 0.04) * 50).alias("z")
    )
    w = Window.partitionBy("trade").orderBy("seq")
    return m.withColumns({"entry": F.first("price").over(w), "z0": F.first("z").over(w)})


def with_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The exit rule: the p-value first, else the z-score crosses the band around zero."""
    z, z0 = F.col("z"), F.col("z0")
    crossed = ((z0 > 0) & (z <= 0.1)) | ((z0 < 0) & (z >= -0.1))
    return marks(spark, d).where("seq > 1").withColumn("reason", F.when(F.col("p") > 0.08, "p_value").when(crossed, "z_cross"))


@query("trade_first_exit", f"WITH {MARKS_SQL} SELECT trade, min(seq) AS exit_seq, arg_min(reason, seq) AS reason, round(arg_min(price / entry - 1, seq) * 100, 6) AS pnl_percent FROM reasons WHERE reason IS NOT NULL GROUP BY 1")
def first_exit(spark: SparkSession, d: str) -> DataFrame:
    out = with_reasons(spark, d).where("reason IS NOT NULL").groupBy("trade")
    return out.agg(F.min("seq").alias("exit_seq"), F.min_by("reason", "seq").alias("reason"), F.round(F.min_by(F.col("price") / F.col("entry") - 1, "seq") * 100, 6).alias("pnl_percent"))


@query("marks_before_exit", f"WITH {MARKS_SQL}, e AS (SELECT trade, min(seq) FILTER (reason IS NOT NULL) AS x FROM reasons GROUP BY 1) SELECT trade, count(*) AS kept FROM reasons JOIN e USING (trade) WHERE x IS NULL OR seq <= x GROUP BY 1")
def before_exit(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("trade").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.max(F.col("reason").isNotNull()).over(w)
    return with_reasons(spark, d).withColumn("closed", F.coalesce(closed, F.lit(False))).where("NOT closed").groupBy("trade").agg(F.count(F.lit(1)).alias("kept"))


@query("latest_mark", f"WITH {MARKS_SQL} SELECT trade, max(seq) AS seq, arg_max(price, seq) AS price FROM marks GROUP BY 1")
def latest_mark(spark: SparkSession, d: str) -> DataFrame:
    return latest_per_key(marks(spark, d).select("trade", "seq", "price"), ["trade"], "seq").select("trade", "seq", "price")


@query("portfolio_rollup", f"""WITH {MARKS_SQL}, l AS (SELECT trade, arg_max(price, seq) / any_value(entry) - 1 AS unrealised, any_value(entry) AS entry FROM marks GROUP BY 1),
r AS (SELECT trade, arg_min(price / entry - 1, seq) AS realised FROM reasons WHERE reason IS NOT NULL GROUP BY 1)
SELECT count(*) AS trades, count(realised) AS closed, round(sum(coalesce(realised, unrealised, 0) * entry), 4) AS pnl, round(sum(coalesce(realised, unrealised, 0) * entry) / sum(entry) * 100, 6) AS return_percent FROM l LEFT JOIN r USING (trade)""")
def rollup(spark: SparkSession, d: str) -> DataFrame:
    last = marks(spark, d).groupBy("trade").agg((F.max_by("price", "seq") / F.min_by("entry", "seq") - 1).alias("unrealised"), F.min_by("entry", "seq").alias("entry"))
    done = with_reasons(spark, d).where("reason IS NOT NULL").groupBy("trade").agg(F.min_by(F.col("price") / F.col("entry") - 1, "seq").alias("realised"))
    pnl = F.coalesce("realised", "unrealised", F.lit(0.0)) * F.col("entry")
    return last.join(done, "trade", "left").agg(F.count(F.lit(1)).alias("trades"), F.count("realised").alias("closed"), F.round(F.sum(pnl), 4).alias("pnl"), F.round(F.sum(pnl) / F.sum("entry") * 100, 6).alias("return_percent"))


@query("entry_qualification", f"WITH {MARKS_SQL} SELECT trade FROM marks WHERE seq = 1 AND p <= 0.02 AND z <= -1 AND price > 100")
def qualification(spark: SparkSession, d: str) -> DataFrame:
    return marks(spark, d).where("seq = 1 AND p <= 0.02 AND z <= -1 AND price > 100").select("trade")


@query("thin_marks_45h", """WITH e AS (SELECT user_id, list(epoch(ts)::BIGINT ORDER BY ts, event_id) AS t FROM events GROUP BY 1)
SELECT user_id, list_reduce(t, lambda a, x: CASE WHEN x - a // 1000000 >= 162000 THEN x * 1000000 + a % 1000000 + 1 ELSE a END, 0::BIGINT) % 1000000 AS kept FROM e""")
def thinning(spark: SparkSession, d: str) -> DataFrame:
    """Marks less than 45 hours after the last kept one are dropped: a fold, as a row's fate depends on earlier kept rows.

    Equal seconds count once, so a user's array grows with the time covered and not with the rows.
    """
    seconds = nearest_second(F.col("ts"))
    e = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set(seconds)).alias("t"))
    zero = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))

    def step(a, x):
        keep = x - a["last"] >= 162000
        return F.struct(F.when(keep, x).otherwise(a["last"]).alias("last"), (a["n"] + keep.cast("long")).alias("n"))

    return e.select("user_id", (F.aggregate("t", zero, step, lambda a: a["n"])).alias("kept"))
