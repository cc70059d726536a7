"""Benchmark decontamination by an FM-index per training shard (operator 7).

Words are the runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.  A window
is ten consecutive words of a benchmark item (an item of fewer words is one window).  The words of a
shard (a batch of documents) are numbered by the benchmark's vocabulary.  Maximal runs of vocabulary
words that are long enough for the shortest window are indexed, which are the only places where a
window can occur (4 % of the words of the test documents); all windows are found by backward search, their places by sampled suffix
positions, and overlapping or touching places are merged into removal spans.

The benchmark's distinct rows reach the executors in blocks of about ``BLOCK_BYTES`` of text (an item is never split), whose
sizes are checked first.  A benchmark of one block is broadcast and needs no shuffle.  Of a larger one, one block at a
time is collected, broadcast, searched for and destroyed; what each block hits is kept by two hashes of the text, and all
blocks' spans are merged before they count or are cut, so results don't depend on the blocks.

Defined results: null texts have no words; empty tables give no hits; repeated benchmark rows and
repeated windows count once; a null item_id is listed as the empty string; documents are judged row
by row, so repeated rows and ids don't matter; other columns pass through (one that is called like the result as ``_<name>``).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import worker_memory
from .fm_index import FMIndex
from .tables import cut_lineage, own_name, with_result

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Indexed words of a shard, about; a longer document stands alone.
SHARD_WORDS = 1_000_000

#: Lower-cases A-Z and turns all separators of words into blanks.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPAN = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
FOUND = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("items", ArrayType(StringType())),
        StructField("word_spans", SPAN),
        StructField("spans", SPAN),
    ]
)
_SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("word_spans", _SPAN_ARROW),
        ("spans", _SPAN_ARROW),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class Phrases:
    """The windows of a block of benchmark items: numbered words, and for each length the distinct windows with their items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.number: dict[bytes, int] = _Numbers()
        self.names = sorted({item for item, _ in items})
        index = {name: i for i, name in enumerate(self.names)}
        windows: dict[int, list[np.ndarray]] = defaultdict(list)
        owners: dict[int, list[np.ndarray]] = defaultdict(list)
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)], np.int32)
            if n := min(window, len(ids)):
                own = np.lib.stride_tricks.sliding_window_view(ids, n)
                windows[n].append(own)
                owners[n].append(np.full(len(own), index[item], np.int64))
        #: (length, windows, begin of each window's items, items)
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in sorted(windows):
            phrases, which = np.unique(np.concatenate(windows.pop(n)), axis=0, return_inverse=True)
            pairs = np.unique(which.reshape(-1) * len(self.names) + np.concatenate(owners.pop(n)))
            begin = np.searchsorted(pairs // len(self.names), np.arange(len(phrases) + 1))
            self.groups.append((n, phrases, begin, (pairs % len(self.names)).astype(np.int32)))
        self.shortest = self.groups[0][0] if self.groups else 0

    def occurrences(self, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a shard of texts (numbered words, words per text): words inside a window, and distinct (text, item) pairs."""
        inside = np.zeros(len(ids) + 1, np.int64)
        pairs = [np.empty((0, 2), np.int64)]
        begins = np.cumsum(lens) - lens
        known = ids > 0
        if not self.groups or not known.any():
            return inside[:-1] > 0, pairs[0]
        edge = np.zeros(len(ids), bool)
        edge[begins[begins < len(ids)]] = True  # runs end with their text
        change = np.flatnonzero(edge | np.concatenate([[True], known[1:] != known[:-1]]))
        size = np.diff(change, append=len(ids))
        keep = known[change] & (size >= self.shortest)
        first, size = change[keep], size[keep]
        if not len(first):
            return inside[:-1] > 0, pairs[0]
        run_begin = np.cumsum(size + 1) - (size + 1)
        within = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        index = FMIndex(ids[within], size, len(self.number))
        for n, phrases, begin, items in self.groups:
            low, high = index.search(phrases)
            count = high - low
            if not count.sum():
                continue
            phrase = np.repeat(np.arange(len(phrases)), count)
            rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            at = index.locate(rows)
            run = np.searchsorted(run_begin, at, "right") - 1
            word = first[run] + at - run_begin[run]
            np.add.at(inside, word, 1)
            np.add.at(inside, word + n, -1)
            text = np.searchsorted(begins, word, "right") - 1
            met = np.unique(text * len(phrases) + phrase)
            text, phrase = met // len(phrases), met % len(phrases)
            times = begin[phrase + 1] - begin[phrase]
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[phrase], times)
            pairs.append(np.stack([np.repeat(text, times), items[place]], axis=1))
        return np.cumsum(inside[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


class _Numbers(dict):
    def __missing__(self, key: bytes) -> int:
        return 0


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def char_spans(text: str, word_spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points from the first to the last word of each span."""
    places = [m.span() for m in _WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in word_spans]


def _found(text: str | None, n_words: int, items: list[str], hit: list[tuple[int, int]]) -> dict:
    chars = char_spans(text or "", hit) if hit else []
    return {
        "n_words": n_words,
        "n_hit": sum(b - a for a, b in hit),
        "items": items,
        "word_spans": [{"start": a, "end": b} for a, b in hit],
        "spans": [{"start": a, "end": b} for a, b in chars],
    }


def find_in(phrases: Phrases, texts: list[str | None]) -> list[dict]:
    """What the windows hit in each text; texts are indexed in shards of bounded size."""
    out: list[dict] = []
    shard: list[np.ndarray] = []
    total = 0

    def close() -> None:
        nonlocal shard, total
        base = len(out)
        lens = np.fromiter(map(len, shard), np.int64, len(shard))
        inside, pairs = phrases.occurrences(np.concatenate(shard), lens)
        begins = np.cumsum(lens) - lens
        bounds = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for a, b in zip(bounds[::2].tolist(), bounds[1::2].tolist(), strict=True):
            while a < b:  # a run of hit words can go on into the next text
                d = int(np.searchsorted(begins, a, "right")) - 1
                end = min(b, int(begins[d] + lens[d]))
                spans[d].append((a - int(begins[d]), end - int(begins[d])))
                a = end
        items: dict[int, list[str]] = defaultdict(list)
        for d, i in pairs.tolist():
            items[d].append(phrases.names[i])
        out.extend(_found(texts[base + d], int(n), items.get(d, []), spans.get(d, [])) for d, n in enumerate(lens))
        shard, total = [], 0

    number = phrases.number.__getitem__
    for text in texts:
        words = words_of(text)
        if shard and total + len(words) > SHARD_WORDS:
            close()
        shard.append(np.fromiter(map(number, words), np.int64, len(words)))
        total += len(words)
    if shard:
        close()
    return out


def without(text: str, spans: list[dict]) -> str:
    for s in reversed(spans):
        text = text[: s["start"]] + text[s["end"] :]
    return text


class _Blocks:
    """The benchmark in blocks; ``each`` broadcasts one after the other and destroys it when the next is asked for."""

    def __init__(self, benchmark: DataFrame, window: int):
        self.rows = benchmark.select(
            F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")
        ).distinct()
        size = self.rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
        self.number, self.window = 1 + size // BLOCK_BYTES, window

    def shared(self, k: int) -> Broadcast:
        part = self.rows if self.number == 1 else self.rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(self.number)) == k)
        phrases = Phrases([(r["i"], r["t"]) for r in part.collect()], self.window)
        return self.rows.sparkSession.sparkContext.broadcast(phrases)

    def each(self) -> Iterator[Broadcast]:
        for k in range(self.number):
            shared = self.shared(k)
            yield shared
            shared.destroy()


def _finder(shared: Broadcast):
    """A function of a text column that gives a ``FOUND`` struct."""

    @F.arrow_udf(FOUND)
    @worker_memory.tidied
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_memory.enter("decontaminate")
        for batch in batches:
            yield pa.array(find_in(shared.value, batch.to_pylist()), _FOUND_ARROW)

    return find.asNondeterministic()  # so that no filter runs it again


def _cutter(shared: Broadcast):
    """A function of a text column that gives the text with cuts repeated until no window occurs."""

    @F.arrow_udf(StringType())
    @worker_memory.tidied
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_memory.enter("decontaminate")
        for batch in batches:
            texts = batch.to_pylist()
            todo = list(range(len(texts)))
            while todo:
                found = find_in(shared.value, [texts[i] for i in todo])
                todo = [i for i, f in zip(todo, found, strict=True) if f["spans"]]
                for i, spans in zip(todo, (f["spans"] for f in found if f["spans"]), strict=True):
                    texts[i] = without(texts[i], spans)
            yield pa.array(texts, pa.string())

    return cut.asNondeterministic()


def _hits(shared: Broadcast):
    """For mapInArrow: (h1, h2, items, word_spans) of the texts that a window hits."""

    @worker_memory.tidied
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory.enter("decontaminate")
        for batch in batches:
            found = find_in(shared.value, batch.column("t").to_pylist())
            at = pa.array([i for i, f in enumerate(found) if f["n_hit"]], pa.int64())
            rows = [f for f in found if f["n_hit"]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("h1").take(at),
                    batch.column("h2").take(at),
                    pa.array([f["items"] for f in rows], pa.list_(pa.string())),
                    pa.array([f["word_spans"] for f in rows], _SPAN_ARROW),
                ],
                ["h1", "h2", "items", "word_spans"],
            )

    return hits


@F.arrow_udf(FOUND)
def _complete(texts: pa.Array, items: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, own, hit in zip(texts.to_pylist(), items.to_pylist(), spans.to_pylist(), strict=True):
        hit = merged([(s["start"], s["end"]) for s in hit or []])
        out.append(_found(text, len(words_of(text)), sorted(own or []), hit))
    return pa.array(out, _FOUND_ARROW)


@F.arrow_udf(StringType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([without(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text: str = "text", into: str = "found"
) -> DataFrame:
    """``docs`` with a struct of n_words, n_hit, items, word_spans and spans (code points, end exclusive)."""
    blocks = _Blocks(benchmark, window)
    if blocks.number == 1:
        return with_result(docs, into, _finder(blocks.shared(0))(docs[text]))
    hashes = [F.xxhash64(docs[text]), F.xxhash64(F.lit(7), docs[text])]
    texts = docs.select(docs[text].alias("t"), hashes[0].alias("h1"), hashes[1].alias("h2")).where("t IS NOT NULL")
    each = []
    for shared in blocks.each():
        hits = texts.mapInArrow(_hits(shared), "h1 long, h2 long, items array<string>, word_spans array<struct<start: long, end: long>>")
        each.append(cut_lineage(hits.dropDuplicates(["h1", "h2"])))
    every = reduce(DataFrame.unionAll, each).groupBy("h1", "h2")  # as many rows as blocks to a group, at most
    every = every.agg(
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("word_spans")).alias("word_spans")
    )
    names = [own_name(docs, n) for n in ("_h1", "_h2", "_items", "_word_spans")]
    met = docs.withColumns(dict(zip(names, hashes)))
    met = met.join(every.toDF(*[f"{n}_of" for n in names]), [met[n] == F.col(f"{n}_of") for n in names[:2]], "left")
    found = _complete.asNondeterministic()(met[text], F.col(f"{names[2]}_of"), F.col(f"{names[3]}_of"))
    return with_result(met, into, found).drop(*names, *[f"{n}_of" for n in names])


def without_contamination(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text: str = "text", keep_emptied: bool = True
) -> DataFrame:
    """``docs`` with all hit words cut out of the text, and n_chars, where there is one, counted anew.

    What stood on both sides of a cut may form a window again, so cuts are repeated until none occurs.  Rows of which a cut leaves
    nothing but white space go, unless ``keep_emptied``.
    """
    left = lambda c: F.lit(keep_emptied) | F.coalesce(F.col(c).rlike(r"\S"), F.lit(False))
    cleaned = own_name(docs, "_cleaned")
    blocks = _Blocks(benchmark, window)
    if blocks.number == 1:
        out = docs.withColumn(cleaned, _cutter(blocks.shared(0))(docs[text]))
        out = out.where(F.col(cleaned).eqNullSafe(F.col(text)) | left(cleaned))
    else:
        done, todo = [], docs.withColumn(cleaned, docs[text])
        found = own_name(docs, "_found")
        while True:
            rows = cut_lineage(contamination(todo, benchmark, window=window, text=cleaned, into=found))
            done.append(rows.where(F.col(f"{found}.n_hit") == 0).drop(found))
            hit = rows.where(F.col(f"{found}.n_hit") > 0)
            if hit.isEmpty():
                break
            todo = hit.withColumn(cleaned, _without(F.col(cleaned), F.col(f"{found}.spans"))).drop(found).where(left(cleaned))
        out = reduce(DataFrame.unionAll, done)
    new = {text: F.col(cleaned)} | ({"n_chars": F.length(cleaned).cast("long")} if "n_chars" in docs.columns else {})
    return out.withColumns(new).drop(cleaned)
