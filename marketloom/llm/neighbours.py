"""Approximate nearest neighbours by a hash-prefix forest (operator 10).

Every vector has a long bit string per tree: the signs of its products with that tree's random
directions.  A tree is the sorted array of its strings.  A query descends each tree to the longest
prefix that it shares with a string there, and then ascends all trees at once, one bit at a time;
the strings that share the shorter prefix are the next candidates, and are scored exactly.  A
neighbour at angle a shares a prefix of x bits with the query in a tree with probability
(1 - a / pi) ** x.  The ascent ends when the k-th best angle so far would have been missed by all trees with
probability ``MISS`` at most; at the root all vectors have been candidates.  So nothing is capped, and
vectors without near neighbours are searched further up.

Equal vectors are one class with the ``k`` + 1 least ids of its rows, which are all that can be found; classes are searched
for each class that asks.  Classes are dealt to shards of about ``SHARD_ROWS`` by the first bits of one more hash string (a cell; crowded cells
are split by a hash).  A query first goes to its own cell.  A neighbour at angle a lies in a cell that differs in more than d
of b bits with the probability that a binomial variable (b, a / pi) exceeds d, so the k-th best angle tells which cells
the query goes to in the second and last round: near neighbours need few cells, structureless vectors nearly all.

Defined results: vectors that are null, zero, of another length than most, or with null or
non-finite components take no part, nor do null ids; of rows with equal ids each asks and each is a candidate of the
others; components are scaled by powers of two, so that very large and very small ones count exactly; ties go
to the smaller id; with fewer than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import worker_memory
from .tables import cut_lineage

TREES, LENGTH = 128, 24
MISS = 0.03
#: Vectors of a cell, about, and cells at most (their counts reach the driver, their masks every executor).
SHARD_ROWS, MOST_BITS = 8192, 16
SEED = 20240229
FOUND = "q1 long, q2 long, c1 long, c2 long, least long, score double"


class Forest:
    """Sorted hash strings of one shard's vectors, in each tree; ``least`` orders equal scores."""

    def __init__(self, keys: np.ndarray, least: np.ndarray, vectors: np.ndarray):
        self.keys, self.least, self.vectors = keys, least, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        rng = np.random.default_rng(SEED)
        self.planes = rng.standard_normal((vectors.shape[1], TREES * LENGTH), np.float32)
        strings = self.strings(vectors)
        self.order = np.argsort(strings, axis=0).astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, axis=0)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """The hash string of each vector (row) in each tree (column)."""
        out = np.empty((len(vectors), TREES), np.int64)
        weights = 1 << np.arange(LENGTH - 1, -1, -1)
        for a in range(0, len(vectors), 4096):
            signs = vectors[a : a + 4096].astype(np.float32) @ self.planes > 0
            out[a : a + 4096] = signs.reshape(-1, TREES, LENGTH) @ weights
        return out

    def ranges(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries' strings: [query, tree, prefix length] begin and end of the strings that share the prefix."""
        shape = (len(strings), TREES, LENGTH + 1)
        low, high = np.empty(shape, np.int32), np.empty(shape, np.int32)
        for t in range(TREES):
            for x in range(LENGTH + 1):
                head = strings[:, t] >> (LENGTH - x) << (LENGTH - x)
                low[:, t, x] = np.searchsorted(self.sorted[:, t], head)
                high[:, t, x] = np.searchsorted(self.sorted[:, t], head + (1 << (LENGTH - x)))
        return low, high

    def nearest(self, query: np.ndarray, known: float, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of the k best candidates of one query; ``known`` is the k-th best score elsewhere."""
        n = len(self.keys)
        seen = np.zeros(n, bool)
        rows, scores = np.empty(0, np.int64), np.empty(0)
        norm = math.sqrt(float((query * query).sum()))
        level = int(((high > low).any(axis=0)).nonzero()[0].max(initial=0))  # the longest prefix met in any tree
        for x in range(level, -1, -1):
            if x:
                spans = [self.order[a:b, t] for t, (a, b) in enumerate(zip(low[:, x].tolist(), high[:, x].tolist(), strict=True)) if b > a]
                fresh = np.zeros(n, bool)
                fresh[np.concatenate(spans)] = True
                fresh &= ~seen
            else:
                fresh = ~seen
            new = np.flatnonzero(fresh)
            seen |= fresh
            if len(new):
                got = (self.vectors[new] @ query) / (self.norms[new] * norm)
                rows, scores = np.append(rows, new), np.append(scores, got)
                if len(rows) > k:
                    floor = np.partition(scores, -k)[-k] - 1e-12
                    rows, scores = rows[scores >= floor], scores[scores >= floor]
            bar = max(known, float(np.partition(scores, -k)[-k])) if len(rows) >= k else known
            if bar > -2:
                angle = math.acos(max(-1.0, min(1.0, bar)))
                if (1 - (1 - angle / math.pi) ** x) ** TREES <= MISS:
                    break
        exact = (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * norm)
        best = np.lexsort((self.least[rows], -exact))[:k]
        return rows[best], exact[best]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to one half or more, below one."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def cells_of(vectors: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` signs of products with random directions of their own, as a number."""
    planes = np.random.default_rng(SEED + 1).standard_normal((vectors.shape[1], MOST_BITS))[:, :bits]
    return (vectors @ planes > 0) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64)) if bits else np.zeros(len(vectors), np.int64)


def reach(angle: float, bits: int) -> int:
    """The least d for which a neighbour at ``angle`` differs in more than d of ``bits`` with probability ``MISS`` at most."""
    p, tail = angle / math.pi, 1.0
    for d in range(bits + 1):
        tail -= math.comb(bits, d) * p**d * (1 - p) ** (bits - d)
        if tail <= MISS:
            return d
    return bits


def taking_part(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory.enter("neighbours")
        shard, forest = None, None
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            kinds = batch.column("kind").to_numpy()
            cut = np.flatnonzero((np.diff(shards, prepend=-1) != 0) | (np.diff(kinds, prepend=-1) != 0)).tolist()
            for a, b in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if shards[a] != shard:
                    shard, forest, held = shards[a], None, []
                if kinds[a] == 0:
                    held.append(part)
                    continue
                if forest is None:
                    if not held:
                        continue
                    t = pa.Table.from_batches(held)
                    keys = np.stack([t.column("c1").to_numpy(), t.column("c2").to_numpy()], axis=1)
                    forest, held = Forest(keys, t.column("least").to_numpy(), _matrix(t.column("v").combine_chunks())), []
                keys = np.stack([part.column("c1").to_numpy(), part.column("c2").to_numpy()], axis=1)
                known, vectors = part.column("known").to_numpy(), _matrix(part.column("v"))
                for i in range(0, len(keys), 256):
                    some = slice(i, i + 256)
                    low, high = forest.ranges(forest.strings(vectors[some]))
                    found = [forest.nearest(*q, k) for q in zip(vectors[some], known[some], low, high, strict=True)]
                    at, score = np.concatenate([r for r, _ in found]), np.concatenate([s for _, s in found])
                    own = np.repeat(keys[some], [len(r) for r, _ in found], axis=0)
                    columns = [own[:, 0], own[:, 1], forest.keys[at, 0], forest.keys[at, 1], forest.least[at], score]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q1", "q2", "c1", "c2", "least", "score"])

    return search


def _matrix(v: pa.ListArray) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def _with_cells(bits: int):
    """For mapInArrow: scaled vectors, and the cell of each."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = scaled(_matrix(batch.column("v")))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("c1", "c2", "least", "asks")), flat, pa.array(cells_of(v, bits).astype(np.int64))],
                    ["c1", "c2", "least", "asks", "v", "cell"],
                )

    return place


def nearest_neighbours(
    vectors: DataFrame, queries: Column, *, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` for which ``queries`` holds, against all rows."""
    slim = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("q"))
    slim = slim.where(F.col("vec_id").isNotNull() & taking_part(F.col("v")))
    sizes = slim.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = sizes["dim"] if sizes else 0
    slim = slim.where(F.size("v") == dim).withColumns({"c1": F.xxhash64("v"), "c2": F.xxhash64(F.lit(7), "v"), "q": F.coalesce("q", F.lit(False))})

    # classes of equal vectors: the least k + 1 ids of each (limited before the shuffle), and whether a row of it asks
    order = F.row_number().over(Window.partitionBy("c1", "c2").orderBy("vec_id"))
    ids = slim.select("c1", "c2", "vec_id").withColumn("i", order).where(F.col("i") <= k + 1).drop("i")
    ids = cut_lineage(ids.groupBy("c1", "c2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    classes = slim.groupBy("c1", "c2").agg(F.min("vec_id").alias("least"), F.max("q").alias("asks"), F.first("v").alias("v"))
    classes = cut_lineage(classes)
    n = classes.count()
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, n / shard_rows)))))
    placed = cut_lineage(classes.mapInArrow(_with_cells(bits), "c1 long, c2 long, least long, asks boolean, v array<double>, cell long"))

    # shards: a cell, or parts of a crowded one; at most 2 ** MOST_BITS counts come to the driver
    counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [-(-counts.get(c, 0) // (2 * shard_rows)) or (1 if c in counts else 0) for c in range(1 << bits)]
    begins = np.append(0, np.cumsum(parts)).tolist()
    session = vectors.sparkSession
    cells = session.createDataFrame([(c, begins[c], p) for c, p in enumerate(parts) if p], "cell long, begin int, parts int")
    cells, shards = F.broadcast(cells), max(1, begins[-1])
    stored = placed.join(cells, "cell").select(
        (F.col("begin") + F.pmod("c1", F.col("parts"))).cast("int").alias("shard"), F.lit(0).alias("kind"), "c1", "c2", "least", "v", F.lit(-9.0).alias("known")
    )
    schema = "shard int, kind int, c1 long, c2 long, least long, v array<double>, known double"

    def found_in(asked: DataFrame) -> DataFrame:
        """The best k + 1 classes of each query in the cells it is sent to."""
        sent = asked.join(cells, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        sent = sent.select((F.col("begin") + F.col("part")).cast("int").alias("shard"), F.lit(1).alias("kind"), "c1", "c2", "least", "v", "known")
        dealt = stored.union(sent).to(StructType.fromDDL(schema)).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "c1", "c2")
        return dealt.mapInArrow(_search(k + 1), FOUND)

    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "least", "c1", "c2")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    asked = placed.where("asks").withColumn("known", F.lit(-9.0))
    first = cut_lineage(top(found_in(asked)).drop("rank"))
    if bits:
        ends = [math.cos(math.pi * (i + 1) / 180) for i in range(180)]  # the angle, rounded up to a degree
        far = F.array(*[F.lit(reach(math.pi * (i + 1) / 180, bits)) for i in range(180)])
        bar = first.groupBy("q1", "q2").agg(F.min("score").alias("bar"), F.count(F.lit(1)).alias("m"))
        degree = F.size(F.filter(F.array(*map(F.lit, ends)), lambda x: x > F.col("bar")))
        wide = F.when(F.col("m") > k, F.get(far, F.least(degree, F.lit(179)))).otherwise(bits)
        known = F.when(F.col("m") > k, F.col("bar")).otherwise(-9.0)
        bar = bar.select(F.col("q1").alias("c1"), F.col("q2").alias("c2"), wide.alias("wide"), known.alias("bar"))
        masks = session.range(1, 1 << bits).select(F.col("id").alias("mask"), F.bit_count("id").alias("d"))
        more = asked.join(bar, ["c1", "c2"], "left").withColumn("d", F.explode(F.sequence(F.lit(1), F.coalesce("wide", F.lit(bits)))))
        more = more.where("d > 0").join(F.broadcast(masks), "d")
        more = more.select((F.col("cell").bitwiseXOR(F.col("mask"))).alias("cell"), "c1", "c2", "least", "v", F.coalesce("bar", F.lit(-9.0)).alias("known"))
        first = cut_lineage(top(first.union(found_in(more))).drop("rank"))

    # back to rows: each class found stands for its least ids; a query row leaves itself out
    rows = first.join(ids, ["c1", "c2"]).select("q1", "q2", "score", F.explode("ids").alias("vec_id"), F.expr("c1 = q1 AND c2 = q2").alias("own"))
    near = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k + 1)
    lists = rows.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score", "own"))).alias("l"))
    asking = slim.where("q").select(F.col("vec_id").alias("query_id"), F.col("c1").alias("q1"), F.col("c2").alias("q2"))
    met = asking.join(lists, ["q1", "q2"])
    itself = F.get(F.filter("l", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), F.lit(0))["rank"]
    others = F.slice(F.filter("l", lambda x: ~x["rank"].eqNullSafe(F.col("me"))), 1, k)
    out = met.withColumn("me", itself).select("query_id", F.posexplode(others).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", "x.score")
