"""Curves through the points of many groups: weighted decreasing fits and monotone cubic interpolation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: A weight counts as this much at least.
LEAST_WEIGHT = 1e-6


def pooled_decreasing(values: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Weighted least-squares decreasing fit of each slice: neighbours that rise are pooled, each at most once, so time is linear."""
    out = np.empty(len(values))
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        means, masses, ends = [], [], []
        for i, (v, w) in enumerate(zip(values[begin:end].tolist(), weights[begin:end].tolist(), strict=True), begin + 1):
            while means and means[-1] < v:
                mass = masses.pop()
                v, w = (means.pop() * mass + v * w) / (mass + w), mass + w
                ends.pop()
            means.append(v)
            masses.append(w)
            ends.append(i)
        if end > begin:
            out[begin:end] = np.repeat(means, np.diff(ends, prepend=begin))
    return out


@F.arrow_udf(ArrayType(DoubleType()))
def _decreasing(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for values, weights in batches:
        offsets = np.append(0, np.cumsum(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int32)
        mass = np.maximum(weights.flatten().to_numpy(zero_copy_only=False), LEAST_WEIGHT)
        fitted = pooled_decreasing(values.flatten().to_numpy(zero_copy_only=False), mass, offsets)
        yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.clip(fitted, 0.0, 1.0)))


def decreasing_fit(values: Column, weights: Column) -> Column:
    """The decreasing fit, within 0 and 1, of an array of numbers under an array of weights of the same length (no nulls in them)."""
    return _decreasing(values, weights)


def _endpoint(h1: Column, h2: Column, s1: Column, s2: Column) -> Column:
    t = ((2 * h1 + h2) * s1 - h1 * s2) / (h1 + h2)
    return F.when(F.signum(t) != F.signum(s1), 0.0).when((F.signum(s1) != F.signum(s2)) & (F.abs(t) > F.abs(3 * s1)), 3 * s1).otherwise(t)


def monotone_segments(points: DataFrame, key: str) -> DataFrame:
    """(key, x0, x1, y0, y1, m0, m1): the pieces of a monotone cubic through the points (key, x, y) of each group.

    Tangents are weighted harmonic means of neighbouring slopes, zero at turns; ends take one-sided estimates that keep the
    shape.  Points with a null are left out, a repeated x counts once at its largest y; a group of one point has no piece.
    """
    c = F.col
    w = Window.partitionBy(key).orderBy("x")
    p = points.where("x IS NOT NULL AND y IS NOT NULL").groupBy(key, "x").agg(F.max("y").alias("y"))
    p = p.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w)})
    p = p.withColumns({"h": c("x1") - c("x"), "s": (c("y1") - c("y")) / (c("x1") - c("x"))})
    p = p.withColumns({f"{n}{side}": f(n, k).over(w) for n in ("h", "s") for side, f, k in (("_b", F.lag, 1), ("_bb", F.lag, 2), ("_a", F.lead, 1))})
    one, two = 2 * c("h") + c("h_b"), c("h") + 2 * c("h_b")
    turn = (c("s_b") == 0) | (c("s") == 0) | (c("s_b") * c("s") < 0)
    inside = F.when(turn, 0.0).otherwise((one + two) / (one / F.nullif("s_b", F.lit(0.0)) + two / F.nullif("s", F.lit(0.0))))
    first = F.when(c("s_a").isNull(), c("s")).otherwise(_endpoint(c("h"), c("h_a"), c("s"), c("s_a")))
    last = F.when(c("s_bb").isNull(), c("s_b")).otherwise(_endpoint(c("h_b"), c("h_bb"), c("s_b"), c("s_bb")))
    p = p.withColumn("m", F.when(c("s_b").isNull(), first).when(c("s").isNull(), last).otherwise(inside))
    p = p.withColumn("m1", F.lead("m").over(w))
    return p.where("x1 IS NOT NULL").select(key, c("x").alias("x0"), "x1", c("y").alias("y0"), "y1", c("m").alias("m0"), "m1")


def cubic_at(x: Column) -> Column:
    """The value at x of a piece of ``monotone_segments``, kept between the piece's ends."""
    c = F.col
    width = c("x1") - c("x0")
    u = (x - c("x0")) / width
    value = (2 * u * u * u - 3 * u * u + 1) * c("y0") + (u * u * u - 2 * u * u + u) * width * c("m0") + (3 * u * u - 2 * u * u * u) * c("y1") + (u * u * u - u * u) * width * c("m1")
    return F.least(F.greatest(c("y0"), c("y1")), F.greatest(F.least(c("y0"), c("y1")), value))


def monotone_curve(points: DataFrame, key: str, *, least: int = 200, most: int = 1600) -> DataFrame:
    """(key, i, x, y): each group's curve at evenly spaced x, about one a unit, between ``least`` and ``most`` steps.

    Every piece makes the samples that lie in it, so a long curve is many rows of one window but no Python.  A group of one point gives that point.
    """
    segments = monotone_segments(points, key)
    w = Window.partitionBy(key)
    s = segments.withColumns({"low": F.min("x0").over(w), "span": F.max("x1").over(w) - F.min("x0").over(w)})
    s = s.withColumn("steps", F.least(F.lit(most), F.greatest(F.lit(least), F.ceil("span"))))
    place = lambda x: (F.col(x) - F.col("low")) / F.col("span") * F.col("steps")
    s = s.withColumn("i", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(place("x0")) - 1), F.least(F.col("steps"), F.ceil(place("x1")) + 1))))
    s = s.withColumn("x", F.col("low") + F.col("span") * F.col("i") / F.col("steps"))
    top = F.col("x1") == F.max("x1").over(w)
    inside = ((F.col("x") > F.col("x0")) | (F.col("i") == 0) & (F.col("x0") == F.col("low"))) & ((F.col("x") <= F.col("x1")) | top)
    rows = s.withColumn("inside", inside).where("inside").select(key, F.col("i").cast("long").alias("i"), "x", cubic_at(F.col("x")).alias("y"))
    alone = points.where("x IS NOT NULL AND y IS NOT NULL").groupBy(key).agg(F.min("x").alias("x"), F.max("x").alias("m"), F.max("y").alias("y")).where("x = m")
    return rows.union(alone.select(key, F.lit(0).cast("long").alias("i"), "x", "y"))
