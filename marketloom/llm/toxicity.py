"""Toxicity by a character n-gram linear classifier with naive Bayes log-count ratios (operator 2).

Training takes labelled documents of each class in the order of a hash of their ids, at most ``MAX_ROWS``; if their texts
are more than ``MAX_CHARS`` together, the longest go until the rest is not, but never the last of a class.  For each hashed n-gram the documents of each class that contain it are counted; its log-count ratio is
r = log((p + 1) / (P + 2)) - log((q + 1) / (Q + 2)), where P and Q are the rows drawn.  A feature is the presence of an n-gram, scaled by
r; n-grams whose ratio can't be told from zero (less than ``SIGMAS`` standard errors) have none.  A logistic regression
with an L2 penalty is fitted on these features, with rows weighted so that the classes count as they do among all labelled rows.
The driver fits it from one 32-bit integer for each feature of each sampled document; a document has no more features than
three times its characters, so ``MAX_CHARS`` bounds what the driver holds.

Defined results: null and empty texts score by the intercept alone; without labelled rows of both
classes every score is the share of toxic rows (0 without any); a document with several labels is toxic if any
says so; labels with nulls and labels without a document are left out; rows are scored one by one and other columns
pass through (one that is called like the result as ``_<name>``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import worker_memory
from .ngrams import batches
from .tables import cut_lineage, with_result

LENGTHS = (3, 4, 5)
BITS = 20
MAX_ROWS = 8000
#: Characters of all sampled texts of a class together.
MAX_CHARS = 24_000_000
SIGMAS = 3.0
#: Features that a step of the fit looks at together.
CHUNK = 2_000_000
PENALTY = 1e-4


def features(texts: list[str | None], wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, text of each feature, bucket of each feature), present once per text; ``wanted`` buckets only."""
    for a, b, batch in batches(texts):
        texts_of, buckets = [], []
        for n in LENGTHS:
            gram, owner = batch.grams(n)
            bucket = (gram >> np.uint64(64 - BITS)).astype(np.int64)
            if wanted is not None:
                keep = wanted[bucket]
                bucket, owner = bucket[keep], owner[keep]
            both = np.unique(owner << BITS | bucket)
            texts_of.append(both >> BITS)
            buckets.append(both & (1 << BITS) - 1)
        both = np.unique(np.concatenate(texts_of) << BITS | np.concatenate(buckets))
        yield a, both >> BITS, both & (1 << BITS) - 1


class Classifier:
    """Sparse weights over buckets, and an intercept."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, intercept: float):
        self.intercept = intercept
        self.wanted = np.zeros(1 << BITS, bool)
        self.wanted[buckets] = True
        self.weight = np.zeros(1 << BITS)
        self.weight[buckets] = weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        for a, owner, bucket in features(texts, self.wanted):
            if len(owner):
                sums = np.bincount(owner, self.weight[bucket])
                out[a : a + len(sums)] += sums
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit_logistic(
    begin: np.ndarray, col: np.ndarray, ratio: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 400
) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by accelerated gradient steps, restarted when they overshoot.

    Row i has the features ``col[begin[i] : begin[i + 1]]``, each with its column's value of ``ratio``.
    """
    n, width = len(y), len(ratio)
    weight = weight / weight.sum()
    size = np.diff(begin)
    cuts = [0]
    while cuts[-1] < n:  # rows of about CHUNK features
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(begin, begin[cuts[-1]] + CHUNK, "right")) - 1))
    parts = [(a, b, col[begin[a] : begin[b]], size[a:b], np.flatnonzero(size[a:b])) for a, b in zip(cuts, cuts[1:])]

    def sums(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        for a, b, own, _, some in parts:
            if len(own):
                out[a:b][some] = np.add.reduceat(values[own], begin[a:b][some] - begin[a])
        return out

    def spread(error: np.ndarray) -> np.ndarray:
        out = np.zeros(width)
        for a, b, own, sizes, _ in parts:
            out += np.bincount(own, np.repeat(error[a:b], sizes), minlength=width)
        return out * ratio

    step = 1 / (0.25 * (weight * (sums(ratio * ratio) + 1)).sum() + PENALTY)
    theta, ahead = np.zeros(width + 1), np.zeros(width + 1)
    t = 1.0
    for _ in range(rounds):
        z = sums(ratio * ahead[:-1]) + ahead[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        slope = np.append(spread(error) + PENALTY * ahead[:-1], error.sum())
        before, theta = theta, ahead - step * slope
        if slope @ (theta - before) > 0:
            t = 1.0
        t, u = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = theta + (u - 1) / t * (theta - before)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Classifier:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic)."""
    named = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    each = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(named, "doc_id", "left_semi")
    sizes = {int(r["toxic"]): r["n"] for r in each.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    none = np.zeros(0, np.int64)
    share = pos / max(1, pos + neg)
    prior = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    if not pos or not neg:
        return Classifier(none, none, prior)
    ranked = [each.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for c in (0, 1)]
    chosen = ranked[0].union(ranked[1])  # at most 2 * max_rows ids
    sized = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(F.broadcast(chosen), "doc_id")
    upto = Window.partitionBy("toxic").orderBy("n", F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sized = sized.groupBy("doc_id", "toxic").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))  # at most 2 * max_rows rows
    sized = sized.withColumns({"upto": F.sum("n").over(upto), "at": F.count(F.lit(1)).over(upto)})
    drawn = cut_lineage(sized.where((F.col("upto") <= max_chars) | (F.col("at") == 1)).select("doc_id", "toxic", "rows"))
    rows_of = {int(r["toxic"]): r["n"] for r in drawn.groupBy("toxic").agg(F.sum("rows").alias("n")).collect()}
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn.select("doc_id", "toxic")), "doc_id").select("toxic", "text")

    @worker_memory.tidied
    def presence(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            toxic = rb.column("toxic").to_numpy(zero_copy_only=False)
            for a, owner, bucket in features(rb.column("text").to_pylist()):
                yes = toxic[a + owner] == 1
                got, place = np.unique(bucket, return_inverse=True)
                p = np.bincount(place, yes, minlength=len(got)).astype(np.int64)
                n = np.bincount(place, minlength=len(got))
                yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(p), pa.array(n - p)], ["bucket", "p", "q"])

    counts = sample.mapInArrow(presence, "bucket long, p long, q long")
    big_p, big_q = rows_of[1], rows_of[0]
    rate = lambda c, size: (F.col(c) + 1) / F.lit(float(size + 2))
    told = (
        counts.groupBy("bucket")
        .agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
        .withColumn("r", F.log(rate("p", big_p)) - F.log(rate("q", big_q)))
        .withColumn("e", F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("q") + 1)))
        .where(F.abs("r") >= SIGMAS * F.col("e"))
        .select("bucket", "r")
        .toPandas()  # at most 2 ** BITS rows
        .sort_values("bucket")
    )
    buckets, ratio = told.bucket.to_numpy(), told.r.to_numpy()
    if not len(buckets):
        return Classifier(none, none, prior)
    wanted = np.zeros(1 << BITS, bool)
    wanted[buckets] = True
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    place = np.full(1 << BITS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))

    @worker_memory.tidied
    def sparse(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory.enter("toxicity")
        for rb in rows:
            owners, on = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, owner, bucket in features(rb.column("text").to_pylist(), shared.value):
                owners.append(a + owner)
                on.append(bucket)
            offsets = np.searchsorted(np.concatenate(owners), np.arange(rb.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(on).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rb.column("toxic"), lists], ["toxic", "on"])

    kept = sample.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(sparse, "toxic int, on array<int>")
    rows = kept.toArrow().combine_chunks()
    y = rows.column("toxic").to_numpy().astype(np.float64)
    lists = rows.column("on").combine_chunks()
    begin = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    col = place[lists.flatten().to_numpy()]
    weight = np.where(y == 1, pos / max(1, (y == 1).sum()), neg / max(1, (y == 0).sum()))
    theta, intercept = fit_logistic(begin, col, ratio, y, weight)
    return Classifier(buckets, theta * ratio, intercept)


def score(docs: DataFrame, model: Classifier, *, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability that it is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    @worker_memory.tidied
    def scores(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_memory.enter("toxicity")
        for texts in rows:
            yield pa.array(shared.value.scores(texts.to_pylist()))

    return with_result(docs, into, scores.asNondeterministic()(docs[text]))  # so that no filter runs it again
