"""Connected components of a link table by alternating large-star and small-star steps.

Each step is two shuffles on node keys; the minimum of a node is aggregated before the join, and a
node with very many links is split by adaptive execution's skew join.  Lineage is cut after each
round in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut_lineage


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")
    ).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.join(least, both.u == least.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    met = edges.join(least, edges.u == least.k).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))


def connected_components(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """``links`` has columns u and v (long); returns (node, root) with the least node of each component as root.

    Links of a node to itself, repeated links and null ends are ignored; roots have a row of their own.
    """
    edges = cut_lineage(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        edges = cut_lineage(_small_star(_large_star(edges).distinct()).distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
