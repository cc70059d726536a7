"""Language identification by language-bitmask n-gram filters (operator 3).

Training counts the n-grams of each language over a sample of at most ``MAX_DOCS`` labelled documents
per language, those whose ids have the smallest hashes.  An n-gram belongs to a language if it makes up at least ``LEAST`` of that language's n-grams
of its length, and at least ``SHARE`` of what it makes up in the language that uses it most; so a
language has at most 1 / ``LEAST`` n-grams of a length, however large the corpus.

The filter is a bit-sliced Bloom filter: each position holds one bit per language, and the AND of
the words at an n-gram's ``HASHES`` positions is the set of languages that contain it.  For each text
the bits are counted per language.  Of n n-grams, n * f are expected to hit by chance, where f is the
filter's false-positive rate for that language; the count is corrected for that and for the share
of the language's own n-grams that the filter covers.  The largest count decides; the score is its
share of all counts.

Defined results: null texts and texts without letters give ``und`` and score 0, as does any text when there are
no learned languages; a text with letters of which no n-gram is known gives the language with the most labelled
documents and score 0; a letter is a code point of category L; ties go to the language that sorts first; rows with null lang or doc_id aren't
learned from, and of rows that share a doc_id and a lang one at most is; other columns pass through
(one that is called like the result as ``_<name>``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import worker_memory
from .ngrams import batches
from .tables import cut_lineage, with_result

LENGTHS = (2, 3, 4)
MAX_DOCS = 4000
LEAST, SHARE = 2e-5, 0.2
HASHES = 3
#: Languages of one filter word.
WORD = 64
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
FOUND = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])
_FOUND_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, length, gram, n) over the sample's columns lang and text."""

    @worker_memory.tidied
    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory.enter("language")
        for rb in rows:
            langs = np.array(rb.column("lang").to_pylist(), object)
            texts = rb.column("text").to_pylist()
            for lang in sorted(set(langs)):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for _, _, batch in batches(own):
                    for n in LENGTHS:
                        gram, times = np.unique(batch.grams(n)[0], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([lang] * len(gram), pa.string()),
                                pa.array(np.full(len(gram), n, np.int32)),
                                pa.array(gram.view(np.int64)),
                                pa.array(times),
                            ],
                            ["lang", "length", "gram", "n"],
                        )

    each = sample.select("lang", "text").mapInArrow(count, "lang string, length int, gram long, n long")
    return each.groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))


class LanguageFilter:
    """A bit-sliced Bloom filter over (gram, language) pairs, in as many planes of words as the languages need.

    ``usual`` is the language of a text that tells nothing.
    """

    def __init__(self, langs: list[str], grams: list[np.ndarray], covers: np.ndarray, usual: int = 0):
        self.langs, self.covers, self.usual = langs, covers, usual
        most = max(map(len, grams), default=0)
        self.bits = max(12, int(most * HASHES * 4 or 1).bit_length())
        kind = next(k for k, room in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if min(len(langs), WORD) <= room)
        self.planes = [np.zeros(1 << self.bits, kind) for _ in range(max(1, -(-len(langs) // WORD)))]
        fill = []
        for i, own in enumerate(grams):
            words, bit = self.planes[i // WORD], kind(1 << i % WORD)
            for at in self.positions(own):
                words[at] |= bit
            fill.append(np.count_nonzero(words & bit) / len(words))
        self.chance = np.array(fill) ** HASHES

    def positions(self, gram: np.ndarray) -> Iterator[np.ndarray]:
        step = np.uint64(64 - self.bits)
        mixed = gram
        for _ in range(HASHES):
            yield mixed >> step
            mixed = mixed * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)

    def languages_of(self, gram: np.ndarray, plane: int = 0) -> np.ndarray:
        """The bitmask of the languages of a plane that contain each n-gram."""
        found = None
        for at in self.positions(gram):
            word = self.planes[plane][at]
            found = word if found is None else found & word
        return found

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Corrected counts, a row per text and a column per language."""
        out = np.zeros((len(texts), len(self.langs)))
        for a, b, batch in batches(texts):
            hits = np.zeros((b - a, len(self.langs)))
            total = np.zeros(b - a)
            for n in LENGTHS:
                gram, owner = batch.grams(n)
                size = np.bincount(owner, minlength=b - a)
                total += size
                begin = np.cumsum(size) - size
                some = size > 0
                for plane in range(len(self.planes)) if some.any() else ():
                    mask = self.languages_of(gram, plane)
                    for i in range(plane * WORD, min((plane + 1) * WORD, len(self.langs))):
                        bit = (mask >> mask.dtype.type(i % WORD) & mask.dtype.type(1)).astype(np.int32)
                        hits[some, i] += np.add.reduceat(bit, begin[some])
            out[a:b] = (hits - total[:, None] * self.chance) / (1 - self.chance) / self.covers
        return np.maximum(out, 0)

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        counts = self.counts(texts)
        total = counts.sum(axis=1)
        lettered = np.array([bool(t and _LETTER.search(t)) for t in texts], bool)
        best = np.where(total > 0, counts.argmax(axis=1), self.usual)
        score = np.where(lettered & (total > 0), counts.max(axis=1) / np.where(total > 0, total, 1), 0.0)
        return [self.langs[i] if ok else UNKNOWN for i, ok in zip(best, lettered, strict=True)], score


def smallest_hashes(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of each language: those whose doc_id has the smallest hash, one for each doc_id."""
    at = F.xxhash64("doc_id")
    ids = rows.select("lang", at.alias("at")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at"))  # limited in each task before the shuffle
    last = ids.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("lang").agg(F.max("at").alias("last")).collect()
    if not last:
        return rows.limit(0)
    limit = F.create_map(*[F.lit(x) for r in last for x in (r["lang"], r["last"])])  # an entry for each language
    return rows.where(at <= limit[F.col("lang")]).dropDuplicates(["lang", "doc_id"])


def train(labelled: DataFrame, *, max_docs: int = MAX_DOCS) -> LanguageFilter:
    """Learn from columns doc_id, text and lang; rows with a null in them are left out."""
    rows = labelled.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageFilter([], [], np.zeros(0))
    sample = smallest_hashes(rows, max_docs)
    counts = cut_lineage(gram_counts(sample))  # it is read three times
    totals = {(r["lang"], r["length"]): r["n"] for r in counts.groupBy("lang", "length").agg(F.sum("n").alias("n")).collect()}
    usual = langs.index(max(langs, key=sizes.get))
    if not totals:
        return LanguageFilter(langs, [np.zeros(0, np.uint64)] * len(langs), np.ones(len(langs)), usual)
    size = F.create_map(*[F.lit(x) for (a, b), n in sorted(totals.items()) for x in (f"{a} {b}", float(n))])
    part = counts.withColumn("p", F.col("n") / size[F.concat_ws(" ", "lang", "length")]).where(F.col("p") >= LEAST)
    best = part.groupBy("length", "gram").agg(F.max("p").alias("most"))
    chosen = part.join(best, ["length", "gram"]).where(F.col("p") >= SHARE * F.col("most"))
    got = chosen.select("lang", "gram", "p").toPandas()
    grams = [got.gram[got.lang == lang].to_numpy().view(np.uint64) for lang in langs]
    covers = np.array([max(got.p[got.lang == lang].sum() / len(LENGTHS), 1e-6) for lang in langs])
    return LanguageFilter(langs, grams, covers, usual)


def identify(docs: DataFrame, model: LanguageFilter, *, text: str = "text", into: str = "found") -> DataFrame:
    """``docs`` with a struct of lang and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(FOUND)
    @worker_memory.tidied
    def decide(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_memory.enter("language")
        for texts in rows:
            langs, score = shared.value.decide(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score)], fields=list(_FOUND_ARROW))

    return with_result(docs, into, decide.asNondeterministic()(docs[text]))  # so that no filter runs it again
