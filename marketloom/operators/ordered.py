"""Ordered operators: top rows of groups, latest rows, as-of joins, folds of exponentially weighted series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; ``order`` should end with a unique key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row per key, the largest by ``order`` (aggregated before the shuffle, no sort)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def latest_with_ties(df: DataFrame, key: str, order: str) -> DataFrame:
    """All rows that hold their key's largest ``order``."""
    top = df.groupBy(key).agg(F.max(order).alias("_top")).withColumnRenamed(key, "_key")
    return df.join(top, (df[key] == F.col("_key")) & (df[order] == F.col("_top"))).drop("_key", "_top")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, values: Sequence[str], block_seconds: int = 86_400) -> DataFrame:
    """For each left row the last right row of its key at or before its time (of several at that time, the largest ``values``).

    A union and a window per key and block of time; the last row of earlier blocks is carried in from one row per block, so a
    key with a large share of all rows is spread over its blocks.  Null keys and times match nothing.
    """
    packed = F.struct(*values)
    kind = right.select(packed.alias("v")).schema["v"].dataType
    a = left.withColumns({"_v": F.lit(None).cast(kind), "_side": F.lit(1)})
    b = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, ts, packed.alias("_v"), F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumn("_block", F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / block_seconds))
    ends = both.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_at"))
    ends = ends.agg(F.max_by("_v", F.when(F.col("_side") == 0, F.struct(ts, "_v"))).alias("_end"))
    before = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_key", "_at", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    w = Window.partitionBy(key, "_block").orderBy(ts, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    found = found.join(carried, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_at")), "left")
    last = F.coalesce("_v", "_carried")
    return found.withColumns({f"asof_{v}": last[v] for v in values}).drop("_side", "_v", "_block", "_key", "_at", "_carried")


def series(df: DataFrame, key: str, order: Sequence[str], **columns: Column) -> DataFrame:
    """One row per key with the named columns as arrays in order; a key's series is one row, so keep it to a symbol's candles."""
    s = F.struct(*order, *[c.alias(n) for n, c in columns.items()])
    grouped = df.groupBy(key).agg(F.sort_array(F.collect_list(s)).alias("_s"))
    return grouped.select(key, *[F.col(f"_s.{n}").alias(n) for n in columns])


def ewm_last(values: Column, alpha: float) -> Column:
    """Last value of y0 = x0, y += alpha * (x - y) over an array."""
    return F.aggregate(F.slice(values, 2, F.size(values)), F.get(values, F.lit(0)), lambda y, x: y + alpha * (x - y))


def ewm_all(values: Column, alpha: float) -> Column:
    """All values of the same recursion."""
    first = F.array(F.get(values, F.lit(0)))
    return F.aggregate(
        F.slice(values, 2, F.size(values)),
        first,
        lambda ys, x: F.concat(ys, F.array(F.element_at(ys, -1) + alpha * (x - F.element_at(ys, -1)))),
    )
