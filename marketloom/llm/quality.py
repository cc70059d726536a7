"""Quality by random-indexing word vectors and a two-layer network with calibrated probabilities (operator 11).

Words are runs of letters, runs of digits and runs of one punctuation mark.  A word's index vector is sparse and random:
``NONZERO`` of ``DIM`` places, taken from the word's hash, hold +1 or -1.  Its context vector is the sum of the index vectors of
the words up to ``WINDOW`` places from it, rotated by their distance, over all documents of the table; words
share 2 ** ``BITS`` rows by hash, so the table of vectors has one size however large the corpus is.  Spark sums the rows of all tasks.

A document is pooled to the mean index vector and the mean of its words' context vectors (of length one), their norms, which
repetition raises, the mean product of the index vectors of words up to ``WINDOW`` places apart, and the logarithm of its number of words.  A two-layer network in numpy learns the labels of a
sample of at most ``MAX_ROWS`` documents per class, in the order of a hash of their ids, weighted as the classes count among all
labelled rows; a fifth of the sample is kept out of the gradient steps and decides when to stop and the temperature that divides the logits.

Defined results: null and empty texts pool to zeros and score as the network scores those; without labelled rows of both classes
every score is the share of good rows (0 without any); a document with several labels is good if any says so; labels with nulls
are left out, as are labels without a document; neighbours are not counted across the places where a text of more than ``PIECE`` bytes is looked at in
pieces (cut at white space, else between code points); rows are scored one by one, ties and repeated rows alike; other columns pass through (one that
is called like the result as ``_<name>``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import worker_memory
from .tables import with_result

DIM, NONZERO, WINDOW = 32, 4, 2
BITS = 14
MAX_ROWS = 8000
#: Bytes of text that are looked at together.
PIECE = 500_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 3e-3, 1e-4
#: Epochs without a better validation loss after which the fit ends.
PATIENCE = 10
WIDTH = 2 * DIM + WINDOW + 3
_P = 0x100000001B3
_P_INVERSE = pow(_P, -1, 1 << 64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Letters (all non-ASCII bytes among them) are 1, digits 2, white space and control characters 0, any other mark is a class of its own.
_CLASS = np.array([1 if c >= 128 or chr(c).isalpha() else 2 if chr(c).isdigit() else 0 if c <= 32 or c == 127 else c for c in range(256)], np.uint8)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def _pieces(texts: Sequence[str | None]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Texts and pieces of long texts in lists of about ``PIECE`` bytes, with the number of the text that each comes from."""
    data, owner, size = [], [], 0
    for i, text in enumerate(texts):
        rest = memoryview((text or "").encode("utf-8", "replace"))
        while len(rest):
            end = len(rest)
            if end > PIECE:
                head = bytes(rest[:PIECE])
                end = max(head.rfind(b" "), head.rfind(b"\n"))
                if end <= 0:
                    end = next(k for k in range(PIECE, 0, -1) if rest[k] & 0xC0 != 0x80)
            if data and size + end > PIECE:
                yield data, owner
                data, owner, size = [], [], 0
            data.append(bytes(rest[:end]))
            owner.append(i)
            size += end
            rest = rest[end:]
    if data:
        yield data, owner


def words(parts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of the part it is in), in order."""
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    kind = _CLASS[raw]
    differs = kind[1:] != kind[:-1]
    at = np.flatnonzero((kind != 0) & np.append(True, differs))
    ends = np.flatnonzero((kind != 0) & np.append(differs, True)) + 1
    # prefix sums of byte * p ** place, shifted back to the word's begin
    power = np.full(len(raw), _P, np.uint64)
    power[0] = 1
    sums = np.append(np.uint64(0), np.cumsum(_LOWER[raw] * np.cumprod(power)))
    power[1:] = np.uint64(_P_INVERSE)
    key = (sums[ends] - sums[at]) * np.cumprod(power)[at] + (ends - at).astype(np.uint64)
    for shift in (29, 32):
        key = key * _MIX
        key ^= key >> np.uint64(shift)
    edges = np.cumsum([len(p) + 1 for p in parts])
    return key, np.searchsorted(edges, at, "right")


def index_places(key: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(place, sign) of the nonzero entries of the words' index vectors."""
    for k in range(NONZERO):
        yield ((key >> np.uint64(8 * k)) % np.uint64(DIM)).astype(np.int64), 1 if k % 2 == 0 else -1


def context_sums(key: np.ndarray, part: np.ndarray, into: np.ndarray) -> None:
    """Add each word's neighbours to its row of ``into`` (rows by places, flat)."""
    row = (key >> np.uint64(64 - BITS)).astype(np.int64) * DIM
    for place, sign in index_places(key):
        for step in range(1, min(WINDOW, len(key) - 1) + 1):
            same = part[step:] == part[:-step]
            for own, other, turn in ((row[:-step], place[step:], step), (row[step:], place[:-step], DIM - step)):
                cell = (own + (other + turn) % DIM)[same]
                into += sign * np.bincount(cell, minlength=len(into))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The context vectors of all rows, each of length one or zero, summed over the whole of docs (text)."""
    names = [f"c{k}" for k in range(DIM)]

    @worker_memory.tidied
    def sums(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM << BITS, np.int64)
        for rb in rows:
            for parts, _ in _pieces(rb.column(0).to_pylist()):
                context_sums(*words(parts), total)
        table = total.reshape(-1, DIM)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(table[used, k]) for k in range(DIM)]], ["row", *names])

    each = docs.select("text").mapInArrow(sums, ", ".join(f"{c} long" for c in ["row", *names]))
    got = each.groupBy("row").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # 2 ** BITS rows at most
    out = np.zeros((1 << BITS, DIM), np.float32)
    if got.num_rows:
        vectors = np.stack([got.column(c).to_numpy() for c in names], axis=1).astype(np.float64)
        length = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
        out[got.column("row").to_numpy()] = vectors / np.where(length > 0, length, 1)
    return out


def pooled(texts: Sequence[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row of ``WIDTH`` features for each text."""
    n = len(texts)
    count, index, context, alike = np.zeros(n), np.zeros((n, DIM)), np.zeros((n, DIM)), np.zeros((n, WINDOW))
    for parts, owner in _pieces(texts):
        key, part = words(parts)
        if not len(key):
            continue
        of = np.array(owner)
        size = np.bincount(part, minlength=len(parts))
        some = np.flatnonzero(size)
        begin = (np.cumsum(size) - size)[some]
        np.add.at(count, of, size)
        places = list(index_places(key))
        for place, sign in places:
            got = np.bincount(part * DIM + place, minlength=len(parts) * DIM).reshape(-1, DIM)
            np.add.at(index, of, sign * got)
        for step in range(1, min(WINDOW, len(key) - 1) + 1):
            dot = sum((a * b) * (p[step:] == q[:-step]).astype(np.int64) for p, a in places for q, b in places)
            same = part[step:] == part[:-step]
            np.add.at(alike[:, step - 1], of, np.bincount(part[step:][same], dot[same], minlength=len(parts)))
        own = vectors[(key >> np.uint64(64 - BITS)).astype(np.int64)]
        np.add.at(context, of[some], np.add.reduceat(own, begin, axis=0, dtype=np.float64))
    size = np.maximum(count, 1)[:, None]
    index, context, alike = index / size, context / size, alike / size
    norms = [np.sqrt((x**2).sum(axis=1, keepdims=True)) for x in (index, context)]
    return np.hstack([index, context, *norms, alike, np.log1p(count)[:, None]])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def log_loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum())


class Network:
    """Two layers over standardised features; logits are divided by a temperature."""

    def __init__(self, middle: np.ndarray, scale: np.ndarray, layers: list[np.ndarray], temperature: float = 1.0):
        self.middle, self.scale, self.layers, self.temperature = middle, scale, layers, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.maximum((x - self.middle) / self.scale @ a + b, 0) @ c + d[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def fit_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, kept_out: np.ndarray, *, seed: int = 0) -> Network:
    """Adam steps on the weighted log loss; ``kept_out`` rows choose the epoch and the temperature."""
    rng = np.random.default_rng(seed)
    learn = ~kept_out
    middle, scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-6
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    z, target, w = (x[learn] - middle) / scale, y[learn], weight[learn] / weight[learn].mean()
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    judge = kept_out if kept_out.any() else learn
    best, best_loss, since, t = [p.copy() for p in layers], np.inf, 0, 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
            a, b, c, d = layers
            before = z[rows] @ a + b
            hidden = np.maximum(before, 0)
            error = w[rows] * (_sigmoid(hidden @ c + d[0]) - target[rows]) / len(rows)
            back = np.outer(error, c) * (before > 0)
            slopes = [z[rows].T @ back + DECAY * a, back.sum(axis=0), hidden.T @ error + DECAY * c, error.sum(keepdims=True)]
            t += 1
            for p, g, m, v in zip(layers, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        loss = log_loss(Network(middle, scale, layers).logits(x[judge]), y[judge], weight[judge])
        if loss < best_loss - 1e-5:
            best, best_loss, since = [p.copy() for p in layers], loss, 0
        elif (since := since + 1) >= PATIENCE:
            break
    model = Network(middle, scale, best)
    logits = model.logits(x[judge])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    model.temperature = float(min(grid, key=lambda u: log_loss(logits / u, y[judge], weight[judge])))
    return model


class Model:
    """Word vectors and the network over pooled documents, or a constant probability."""

    def __init__(self, vectors: np.ndarray | None, network: Network | None, constant: float = 0.0):
        self.vectors, self.network, self.constant = vectors, network, constant

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.constant)
        return self.network.scores(pooled(texts, self.vectors))


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS) -> Model:
    """Learn word vectors from all of docs (doc_id, text), and quality from a sample of labels (doc_id, quality)."""
    named = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    each = known.join(named, "doc_id", "left_semi")
    sizes = {r["quality"]: r["n"] for r in each.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = sizes.get(1, 0), sizes.get(0, 0)
    if not good or not bad:
        return Model(None, None, good / max(1, good + bad))
    ranked = [each.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for c in (0, 1)]
    chosen = ranked[0].union(ranked[1])  # at most 2 * max_rows ids
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    @worker_memory.tidied
    def pool(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory.enter("quality")
        for rb in rows:
            x = pooled(rb.column("text").to_pylist(), shared.value)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([rb.column("at"), rb.column("quality"), flat], ["at", "quality", "x"])

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("at"), "quality", "text")
    got = sample.mapInArrow(pool, "at long, quality int, x array<double>").toArrow()  # WIDTH numbers for each row of the sample
    if not got.num_rows:
        return Model(None, None, good / (good + bad))
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, WIDTH)
    at, y = got.column("at").to_numpy(), got.column("quality").to_numpy().astype(float)
    order = np.lexsort((*x.T, y, at))  # the same fit however Spark orders the rows
    x, y, at = x[order], y[order], at[order]
    if len(set(y)) < 2:
        return Model(None, None, good / (good + bad))
    weight = np.where(y == 1, good / (y == 1).sum(), bad / (y == 0).sum())
    return Model(vectors, fit_network(x, y, weight, (at.view(np.uint64) >> np.uint64(7)) % np.uint64(5) == 0))


def score(docs: DataFrame, model: Model, *, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the calibrated probability that it is good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    @worker_memory.tidied
    def scores(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_memory.enter("quality")
        for texts in rows:
            yield pa.array(shared.value.scores(texts.to_pylist()))

    return with_result(docs, into, scores.asNondeterministic()(docs[f"`{text}`"]))  # so that no filter runs it again
