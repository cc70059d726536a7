from __future__ import annotations

import base64
import hashlib

import public_tokenizers as public
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketloom.llm import bpe, token_counts
from marketloom.llm.pretokens import pieces
from marketloom.llm.queries import op6_byte_bpe, op9_token_counts

SMALL = "/root/testdata/sf0.001"
JSON, RANKS = public.path("byte_bpe_50k.json"), public.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", "a" * 3000, " " * 2000 + "x", "don't'll I'VE 's", "<|endoftext|>a<|endoftext|>", "中文字符" * 50, "\x00\x1c\x85 \n\n\tx", "👍🏽é" * 20]
texts = st.lists(st.text(alphabet=st.sampled_from(list("'stremld vé1²!\n\t\xa0\x1c​中😀aA")), max_size=20), min_size=1, max_size=6)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_pieces_equal_the_pattern(ts):
    assert list(pieces(ts)) == [regex.findall(public.PATTERN, t) for t in ts]


def test_counts_equal_the_library():
    counter = token_counts.MergeCounter(open(JSON, "rb").read())
    library = Tokenizer.from_file(JSON)
    assert counter.texts(ODD) == [len(e.ids) for e in library.encode_batch(ODD, add_special_tokens=False)]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=40, deadline=None)
@given(texts)
def test_codec_equals_the_library(ts):
    codec = _codec()
    ids, counts = codec.encode(ts)
    expected = [reference_cached().encode_ordinary(t) for t in ts]
    assert ids.tolist() == [i for e in expected for i in e]
    assert counts.tolist() == [len(e) for e in expected]


_CACHE: dict = {}


def _codec() -> bpe.Codec:
    return _CACHE.setdefault("codec", None) or _CACHE.update(codec=bpe.Codec(open(RANKS, "rb").read())) or _CACHE["codec"]


def reference_cached():
    return _CACHE.setdefault("reference", None) or _CACHE.update(reference=reference()) or _CACHE["reference"]


def test_long_words_take_the_same_merges():
    codec = _codec()
    for text in ODD + ["abcabdabe" * 100, "ab" * 700]:
        assert codec.encode([text])[0].tolist() == reference_cached().encode_ordinary(text)


def test_operators_on_edge_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "héllo wörld", None), (3, "", "y"), (4, ODD[1], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens_ string")
    counted = token_counts.count_tokens(docs, JSON).collect()
    assert sorted(r.n_tokens for r in counted)[:3] == [0, 0, 0] and len(counted) == 5
    coded = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert [bytes(r.decoded).decode() for r in coded] == [r.text or "" for r in coded]
    both = bpe.round_trip(docs, RANKS).select("text", "coded.*").collect()
    assert [(r.ids, bytes(r.decoded)) for r in both] == [(r.ids, bytes(r.decoded)) for r in coded]
    assert bpe.round_trip(docs.limit(0), RANKS).collect() == []
    assert token_counts.count_tokens(docs.limit(0), JSON).collect() == []


def test_queries_equal_the_libraries(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    library = Tokenizer.from_file(JSON)
    got = {r.doc_id: r for r in op9_token_counts(spark, SMALL).collect()}
    coded = {r.doc_id: r for r in op6_byte_bpe(spark, SMALL).collect()}
    for doc in docs:
        n = len(library.encode(doc.text, add_special_tokens=False).ids)
        assert (got[doc.doc_id].n_tokens, got[doc.doc_id].n_bytes, got[doc.doc_id].over_limit) == (n, len(doc.text.encode()), n > 1024)
        ids = reference_cached().encode_ordinary(doc.text)
        row = coded[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(doc.text.encode()).hexdigest()


def test_unknown_identifier_raises(spark):
    import pytest

    rows = spark.createDataFrame([([10**6],)], "ids array<int>")
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(rows, RANKS).select(F.sum(F.length("decoded"))).collect()


def test_long_words_are_cut_only_where_no_token_reaches():
    import base64
    import random
    import time

    import public_tokenizers
    import tiktoken

    data = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    codec = bpe.Codec(data)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}, special_tokens={})
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(a) for _ in range(n)) for a, n in ((letters, 65), (letters, 3000), (letters + letters.upper(), 2000), ("etaoinshr", 2000), ("éñçab", 700))]
    words += ["a" * 700, "ab" * 200, "thetion" * 60, "=" * 900, "中文字" * 90]
    for word in words:
        parts = codec.parts(word.encode())
        assert b"".join(parts) == word.encode() and all(parts)
        edges = {sum(map(len, parts[:k])) for k in range(1, len(parts))}
        raw = word.encode()
        for a in range(len(raw)):
            for b in range(a + 2, min(len(raw), a + 24) + 1):
                assert raw[a:b] not in codec.ranks or not any(a < e < b for e in edges)
        assert codec.encode([word])[0].tolist() == plain.encode_ordinary(word)
    assert not any(len(w) > bpe.KEEP for w in codec.known)
    long = "".join(rng.choice(letters) for _ in range(100_000))
    begin = time.perf_counter()
    assert codec.encode([long])[0].tolist() == plain.encode_ordinary(long)
    assert time.perf_counter() - begin < 10
