"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition (operator 6).

Encoding: the words (pieces of the public pattern) of a batch of texts that are not known yet become
token-position rows, first one row per byte.  A recursive query joins neighbouring rows with the
merge table and contracts each word's leftmost pair of minimum rank until no pair of a word has a
rank.  Words of more than ``STEPS`` bytes are first cut wherever no token of the vocabulary that occurs in them reaches across, since no merge
can; their parts are coded alone and their tokens joined.  Parts that are still longer take a query that contracts all occurrences of the pair
that do not overlap in one step, where the merged token can never be part of a merge of lower rank
(the tokens are then the same), and several recursive queries of ``STEPS`` steps each, so the rows
that a query keeps stay bounded.  A word that is itself in the vocabulary is one token.

Decoding: the identifiers of a batch become (row, position, token) rows, join the vocabulary, and
an aggregation over the rows in order of position joins their bytes (one thread, so the order holds).

Defined results: null text encodes as the empty text (no identifiers); null identifiers decode to
empty bytes; an identifier outside the vocabulary raises; special tokens are never emitted; rows
are independent, so ties and repeated rows do not matter; other columns pass through (one that is called like
the result as ``_<name>``).
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, islice

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from . import worker_memory
from .pretokens import batches_by_size, pieces
from .tables import with_result
from .vocab import SharedFile

#: Words whose tokens a worker remembers; then it forgets the younger half (frequent words are met early).  Longer words than ``KEEP`` are not remembered.
MEMORY, KEEP = 200_000, 512
#: Steps of one recursive query, and token-position rows that one query starts with at most (a longer word stands alone).
STEPS, ROWS = 64, 100_000

#: Short words.  Rows know their right neighbour: its position and token, -1 at the end of a word.
CONTRACT_ONE = f"""
WITH RECURSIVE state(w, pos, tok, npos, ntok, step, done) AS (
  SELECT w, pos, tok, lead(pos, 1, -1) OVER word, lead(tok, 1, -1) OVER word, 0, false
  FROM start_rows WINDOW word AS (PARTITION BY w ORDER BY pos)
  UNION ALL
  (WITH low AS (
     SELECT s.w, min(m.id::BIGINT << 32 | s.pos) AS least, arg_min(s.npos, m.id::BIGINT << 32 | s.pos) AS gone
     FROM state s JOIN merges m ON s.tok = m.l AND s.ntok = m.r WHERE NOT s.done AND s.step < {STEPS} GROUP BY s.w),
   best AS (
     SELECT low.w, (low.least & 4294967295)::INT AS pos, (low.least >> 32)::INT AS id, low.gone, s.npos, s.ntok
     FROM low JOIN state s ON s.w = low.w AND s.pos = low.gone)
   SELECT s.w, s.pos, CASE WHEN s.pos = b.pos THEN b.id ELSE s.tok END,
          CASE WHEN s.pos = b.pos THEN b.npos ELSE s.npos END,
          CASE WHEN s.pos = b.pos THEN b.ntok WHEN s.npos = b.pos THEN b.id ELSE s.ntok END, s.step + 1, b.w IS NULL
   FROM state s LEFT JOIN best b ON s.w = b.w
   WHERE NOT s.done AND s.step < {STEPS} AND (b.w IS NULL OR s.pos <> b.gone))
)
SELECT w, pos, tok, done FROM state WHERE done OR step = {STEPS} ORDER BY w, pos
"""

#: Rows that the steps of one query over long words keep together, about: longer words take fewer steps a query.
KEPT_ROWS = 2_000_000

#: Long words: all occurrences of a word's pair of minimum rank in one step, where that is safe; takes the number of steps.
CONTRACT_ALL = """
WITH RECURSIVE state(w, pos, tok, step, done) AS (
  SELECT w, pos, tok, 0, false FROM start_rows
  UNION ALL
  (WITH live AS (
     SELECT w, pos, tok, step, lead(tok) OVER word AS nxt, lead(pos) OVER word AS npos
     FROM state WHERE NOT done AND step < $steps WINDOW word AS (PARTITION BY w ORDER BY pos)),
   pairs AS (SELECT l.w, l.pos, l.npos, m.id, m.together FROM live l JOIN merges m ON l.tok = m.l AND l.nxt = m.r),
   low AS (SELECT w, min(id) AS id FROM pairs GROUP BY w),
   hits AS (SELECT p.*, lag(p.npos) OVER (PARTITION BY p.w ORDER BY p.pos) AS before
            FROM pairs p JOIN low USING (w, id)),
   runs AS (SELECT *, sum(CASE WHEN before = pos THEN 0 ELSE 1 END) OVER (PARTITION BY w ORDER BY pos) AS run FROM hits),
   ranked AS (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY pos) AS k FROM runs),
   chosen AS (SELECT w, pos, npos, id FROM ranked WHERE k % 2 = 1 AND (together OR run = 1 AND k = 1))
   SELECT l.w, l.pos, coalesce(c.id, l.tok), l.step + 1, low.id IS NULL
   FROM live l LEFT JOIN low ON l.w = low.w LEFT JOIN chosen c ON l.w = c.w AND l.pos = c.pos
   WHERE NOT EXISTS (SELECT 1 FROM chosen g WHERE g.w = l.w AND g.npos = l.pos))
)
SELECT w, pos, tok, done FROM state WHERE done OR step = $steps ORDER BY w, pos
"""

DECODE = """
SELECT r, string_agg(s, '') AS s, count(s) AS n
FROM (SELECT c.r, v.s FROM coded c LEFT JOIN vocab v ON v.id = c.tok ORDER BY c.pos) GROUP BY r
"""


class Codec:
    """The ranks of a vocabulary file in a DuckDB connection of this process."""

    def __init__(self, data: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        self.put("v", id=pa.array(list(ranks.values()), pa.int32()), s=pa.array([t.decode("latin-1") for t in ranks]))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM v")
        self.known: dict[str | bytes, bytes] = {}  # the tokens of a word as 32-bit integers

    @cached_property
    def merges(self) -> int:
        """Makes the merge table, when first needed; gives its size."""
        left, right, made = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        l, r, m = (np.array(x, np.int32) for x in (left, right, made))
        low = np.full(max(self.ranks.values()) + 1, np.iinfo(np.int32).max)
        np.minimum.at(low, l, m)
        np.minimum.at(low, r, m)
        self.put("m", l=pa.array(l), r=pa.array(r), id=pa.array(m), together=pa.array(low[m] > m))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.unregister("m")
        return len(m)

    def put(self, name: str, **columns: pa.Array) -> None:
        self.db.register(name, pa.table(columns))

    def contract(self, words: list[bytes]) -> list[bytes]:
        """The tokens of each word as 32-bit integers, by merges alone."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        w = np.repeat(np.arange(len(words), dtype=np.int32), lens)
        pos = (np.arange(len(w)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        out = [b""] * len(words)
        assert self.merges
        long = lens.max(initial=0) > STEPS
        while len(w):
            self.put("start_rows", w=pa.array(w), pos=pa.array(pos), tok=pa.array(tok))
            steps = {"steps": max(1, min(STEPS, KEPT_ROWS // len(w)))}
            got = (self.db.execute(CONTRACT_ALL, steps) if long else self.db.execute(CONTRACT_ONE)).fetchnumpy()
            w, pos, tok, done = (np.asarray(got[c]) for c in ("w", "pos", "tok", "done"))
            cut = np.flatnonzero(np.diff(w, prepend=-1))
            ends, values = np.append(cut[1:], len(w)) * 4, tok.astype(np.int32).tobytes()
            for i, ok, a, b in zip(w[cut].tolist(), done[cut].tolist(), (cut * 4).tolist(), ends.tolist(), strict=True):
                if ok:
                    out[i] = values[a:b]
            w, pos, tok = w[~done], pos[~done], tok[~done]
        return out

    @cached_property
    def begins(self) -> frozenset[bytes]:
        """What a token of two bytes or more begins with, itself included."""
        return frozenset(t[:k] for t in self.ranks for k in range(2, len(t) + 1))

    def parts(self, data: bytes) -> list[bytes]:
        """A word cut at all places that no token occurring in it reaches across."""
        begins, ranks, out, begin, reach = self.begins, self.ranks, [], 0, 0
        for i in range(len(data)):
            if i >= reach and i > begin:
                out.append(data[begin:i])
                begin = i
            k = i + 2
            while k <= len(data) and (head := data[i:k]) in begins:
                if head in ranks:
                    reach = max(reach, k)
                k += 1
            reach = max(reach, i + 1)
        out.append(data[begin:])
        return out

    def learn(self, words: set[str]) -> None:
        new: list[tuple[str | bytes, bytes]] = []
        long: dict[str, list[bytes]] = {}
        for word in words:
            data = word.encode("utf-8", "replace")
            if (rank := self.ranks.get(data)) is not None:
                self.known[word] = rank.to_bytes(4, sys.byteorder)
            elif len(data) > STEPS:
                long[word] = self.parts(data)
            else:
                new.append((word, data))
        new += [(p, p) for p in {p for parts in long.values() for p in parts}]
        self.contract_all(new)
        for word, parts in long.items():
            self.known[word] = b"".join([self.known[p] for p in parts])
        for p in {p for parts in long.values() for p in parts}:
            del self.known[p]

    def contract_all(self, new: list[tuple[str | bytes, bytes]]) -> None:
        """Learn the tokens of words, under their names, by merges alone."""
        new.sort(key=lambda x: len(x[1]))  # words of like length need about as many steps
        begin = rows = 0
        for i in range(len(new) + 1):
            if i == len(new) or i > begin and (rows + len(new[i][1]) > ROWS or len(new[i - 1][1]) <= STEPS < len(new[i][1])):
                part = new[begin:i]
                if part:
                    self.known.update(zip((x for x, _ in part), self.contract([b for _, b in part]), strict=True))
                begin, rows = i, 0
            if i < len(new):
                rows += len(new[i][1])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers of all texts, how many each text has)."""
        known, split = self.known, list(pieces(texts))
        if fresh := set(chain.from_iterable(split)).difference(known):
            self.learn(fresh)
        parts = [b"".join(map(known.__getitem__, own)) for own in split]
        for word in [w for w in fresh if len(w) > KEEP]:
            del known[word]
        if len(known) > MEMORY:
            self.known = dict(islice(known.items(), MEMORY // 2))
        return np.frombuffer(b"".join(parts), np.int32), np.fromiter(map(len, parts), np.int64, len(parts)) // 4

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        out = [b""] * len(ids)
        counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        begin = 0
        upto, flat = np.cumsum(counts), ids.flatten()
        while begin < len(ids):  # about 150,000 tokens at a time; a longer row stands alone
            base = int(upto[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, base + 150_000, "right")))
            rows = np.repeat(np.arange(begin, end, dtype=np.int32), counts[begin:end])
            tok = flat.slice(base, len(rows))
            self.put("coded", r=pa.array(rows), pos=pa.array(np.arange(len(rows), dtype=np.int32)), tok=tok)
            for r, text, n in self.db.execute(DECODE).fetchall():
                if n != counts[r]:
                    raise ValueError("an identifier is not in the vocabulary")
                out[r] = text.encode("latin-1")
            begin = end
        return out


def _coded(codec: Codec, texts: pa.Array) -> Iterator[pa.ListArray]:
    """The identifiers of the texts, in slices of bounded size."""
    for begin in range(0, len(texts), 512):
        part = [t or "" for t in texts.slice(begin, 512).to_pylist()]
        for a, b in batches_by_size(part, 500_000):
            ids, counts = codec.encode(part[a:b])
            yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids))


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def bpe_encoder(spark: SparkSession, vocab_path: str):
    """A function of a text column that gives its identifiers."""
    shared = SharedFile(spark, vocab_path)

    @F.arrow_udf(ArrayType(IntegerType()))
    @worker_memory.tidied
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = shared.built(Codec)
        for batch in batches:
            yield _joined(list(_coded(codec, batch)), pa.list_(pa.int32()))

    return encode.asNondeterministic()  # so that no filter runs it again


def bpe_decoder(spark: SparkSession, vocab_path: str):
    """A function of a column of identifiers that gives the bytes they stand for."""
    shared = SharedFile(spark, vocab_path)

    @F.arrow_udf(BinaryType())
    @worker_memory.tidied
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = shared.built(Codec)
        for batch in batches:
            yield pa.array(codec.decode(batch), pa.binary())

    return decode.asNondeterministic()


def bpe_round_trip(spark: SparkSession, vocab_path: str):
    """A function of a text column that gives a struct of ids and of the bytes they decode to, in one pass of Python."""
    shared = SharedFile(spark, vocab_path)
    both = StructType([StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())])

    @F.arrow_udf(both)
    @worker_memory.tidied
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = shared.built(Codec)
        for batch in batches:
            ids, decoded = [], []
            for part in _coded(codec, batch):
                ids.append(part)
                decoded.append(pa.array(codec.decode(part), pa.binary()))
            columns = [_joined(ids, pa.list_(pa.int32())), _joined(decoded, pa.binary())]
            yield pa.StructArray.from_arrays(columns, names=["ids", "decoded"])

    return code.asNondeterministic()


def encode(docs: DataFrame, vocab_path: str, *, text: str = "text", into: str = "ids") -> DataFrame:
    return with_result(docs, into, bpe_encoder(docs.sparkSession, vocab_path)(docs[text]))


def decode(docs: DataFrame, vocab_path: str, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    return with_result(docs, into, bpe_decoder(docs.sparkSession, vocab_path)(docs[ids]))


def round_trip(docs: DataFrame, vocab_path: str, *, text: str = "text", into: str = "coded") -> DataFrame:
    """``docs`` with a struct of ids and decoded."""
    return with_result(docs, into, bpe_round_trip(docs.sparkSession, vocab_path)(docs[text]))
