"""Token counts by heap-and-linked-list byte-pair merging (operator 9).

Each piece of a text starts as its bytes in a doubly linked list.  A heap holds the adjacent pairs
that have a merge rank; the lowest rank (leftmost on ties) is popped, its two symbols are joined and
the pairs on both sides of the new symbol are pushed.  The count of a piece is its initial symbols
minus its merges; no identifiers are emitted.

Defined results: null text counts as empty (0 tokens); the vocabulary's special strings inside a
text count one token each, as the public library does by default; repeated rows and rows with equal
ids are counted row by row; other columns pass through
(one that is called like the result as ``_<name>``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice, pairwise

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import worker_memory
from .pretokens import batches_by_size, pieces
from .tables import with_result
from .vocab import SharedFile

#: Distinct pieces whose counts a worker remembers; then it forgets the younger half (frequent ones are met early).
MEMORY = 800_000
#: A heap entry has 20 bits for the symbol and 40 for the position; Python's integers hold the rank above them.
POSITION = (1 << 40) - 1
PLACE = 60


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if it is a visible Latin-1 character, else 256 and up."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class MergeCounter:
    """Counts tokens of pieces from ranked merges; symbols are small integers private to the counter."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        symbol = {c: i for i, c in enumerate(byte_alphabet())}
        if len(model["vocab"]) >= 1 << 20:
            raise ValueError("a vocabulary may have at most 1,048,575 symbols")
        self.merges: dict[int, int] = {}  # pair -> rank << PLACE | joined symbol
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            joined = symbol.setdefault(left + right, len(symbol))
            self.merges.setdefault(symbol[left] << 20 | symbol[right], (rank + 1) << PLACE | joined)
        special = [re_escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
        self.known: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        symbols = list(piece.encode("utf-8", "replace"))
        n = len(symbols)
        find = self.merges.get
        # a heap entry orders by rank, then position: rank << PLACE | position << 20 | joined symbol
        wanted = [0 if (e := find(a << 20 | b)) is None else e | i << 20 for i, (a, b) in enumerate(pairwise(symbols))]
        wanted.append(0)
        heap = [e for e in wanted if e]
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        count = n
        while heap:
            entry = heappop(heap)
            i = entry >> 20 & POSITION
            if wanted[i] != entry:
                continue  # one of the two symbols has been merged since
            j = after[i]
            symbols[i] = joined = entry & 0xFFFFF
            count -= 1
            wanted[i] = wanted[j] = 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (e := find(joined << 20 | symbols[k])) is not None:
                    wanted[i] = e = e | i << 20
                    heappush(heap, e)
            h = before[i]
            if h >= 0:
                if (e := find(symbols[h] << 20 | joined)) is not None:
                    wanted[h] = e = e | h << 20
                    heappush(heap, e)
                else:
                    wanted[h] = 0
        return count

    def texts(self, texts: list[str]) -> list[int]:
        plain, special = texts, [0] * len(texts)
        owner = range(len(texts))
        if self.special is not None and any(self.special.search(t) for t in texts):
            plain, owner = [], []
            for i, text in enumerate(texts):
                parts = self.special.split(text)
                special[i] = len(parts) - 1
                plain += parts
                owner += [i] * len(parts)
        known = self.known
        for i, own in zip(owner, pieces(plain), strict=True):
            try:
                special[i] += sum(map(known.__getitem__, own))
            except KeyError:
                for p in own:
                    if p not in known:
                        known[p] = self.piece(p)
                special[i] += sum(map(known.__getitem__, own))
        if len(known) > MEMORY:
            self.known = dict(islice(known.items(), MEMORY // 2))
        return special


def re_escape(text: str) -> str:
    return regex.escape(text, special_only=True)


def token_counter(spark: SparkSession, vocab_path: str):
    """A function of a text column that gives its number of tokens."""
    shared = SharedFile(spark, vocab_path)

    @F.arrow_udf(LongType())
    @worker_memory.tidied
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = shared.built(MergeCounter)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            counts: list[int] = []
            for a, b in batches_by_size(texts):
                counts += counter.texts(texts[a:b])
            yield pa.array(counts, pa.int64())

    return n_tokens.asNondeterministic()  # so that no filter runs it again


def count_tokens(docs: DataFrame, vocab_path: str, *, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with one more column, the number of tokens of ``text``."""
    counter = token_counter(docs.sparkSession, vocab_path)
    return with_result(docs, into, counter(docs[text]))


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
