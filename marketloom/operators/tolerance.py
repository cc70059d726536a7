"""Joins of numbers that are equal within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, tolerance: float) -> DataFrame:
    """All pairs of rows with equal ``keys`` and abs(x - y) <= tolerance; x is a column of ``left``, y one of ``right``.

    Numbers fall into buckets as wide as two tolerances, so a partner lies in the number's own bucket or in the nearer neighbour: the left side is
    sent to those two, the right side to its own, and the exact test follows.  A pair is found once.  Null, NaN and infinite numbers, and null keys, match
    nothing; repeated rows give repeated pairs; an empty side gives no pairs.  Columns of both sides must differ in name but for the keys.
    """
    width = 2 * tolerance
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    place = F.col(x).cast("double") / width
    own = F.floor(place)
    near = own + F.when(place - own < 0.5, -1).otherwise(1)
    ours = left.where(known(x)).withColumn("_bucket", F.explode(F.array(own, near)))
    theirs = right.where(known(y)).withColumn("_bucket", F.floor(F.col(y).cast("double") / width))
    met = ours.join(theirs, [*keys, "_bucket"]).drop("_bucket")
    return met.where(F.abs(F.col(x) - F.col(y)) <= tolerance)


def first_within(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, tolerance: float, ident: str, value: str) -> DataFrame:
    """Each row of ``left`` (told apart by ``ident``) with the ``value`` of its first partner in the order of (y, value), null without one."""
    best = within(left, right, keys, x, y, tolerance).groupBy(ident).agg(F.min(F.struct(y, value)).alias("_m"))
    found = best.select(F.col(ident).alias("_ident"), F.col(f"_m.{y}").alias(y), F.col(f"_m.{value}").alias(value))
    return left.join(found, F.col(ident) == F.col("_ident"), "left").drop("_ident")
