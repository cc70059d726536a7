from __future__ import annotations

import hashlib
import random

import numpy as np

from marketloom.llm import decontaminate as dc
from marketloom.llm.fm_index import FMIndex, WaveletMatrix
from marketloom.llm.queries import op7_decontaminate

SMALL = "/root/testdata/sf0.001"


def brute(items, texts, window):
    owners = {}
    for item, text in items:
        words = dc.words_of(text)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            owners.setdefault(tuple(words[k : k + window]), set()).add(item)
    for text in texts:
        words, hit, found = dc.words_of(text), set(), set()
        for n in {len(p) for p in owners}:
            for k in range(len(words) - n + 1):
                if own := owners.get(tuple(words[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        yield len(words), len(hit), sorted(found)


def short(found):
    return found["n_words"], found["n_hit"], found["items"]


def test_wavelet_ranks():
    rng = np.random.default_rng(0)
    seq = rng.integers(0, 37, 500)
    tree = WaveletMatrix(seq, 6)
    symbol, at = rng.integers(0, 37, 300), rng.integers(0, 501, 300)
    assert tree.rank(symbol, at).tolist() == [int((seq[:p] == s).sum()) for s, p in zip(symbol, at, strict=True)]


def test_index_finds_all_places():
    rng = np.random.default_rng(1)
    runs = [rng.integers(1, 4, n) for n in (1, 30, 2, 50)]
    index = FMIndex(np.concatenate(runs), np.array([len(r) for r in runs]), 3, sample=5)
    text = np.concatenate([np.append(r, 0) for r in runs])
    for n in (1, 2, 3):
        patterns = np.array(np.meshgrid(*[[1, 2, 3]] * n)).T.reshape(-1, n)
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            places = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == places


def test_index_of_few_and_sparse_symbols():
    rng = np.random.default_rng(2)
    for trial in range(30):
        run = rng.integers(1, 5000, rng.integers(1, 40))
        index = FMIndex(run, np.array([len(run)]), 5000)
        for n in (1, 2, min(10, len(run))):
            patterns = np.lib.stride_tricks.sliding_window_view(run, min(n, len(run)))
            low, high = index.search(patterns)
            assert (high > low).all()
            assert {int(x) for a, b in zip(low, high, strict=True) for x in index.locate(np.arange(a, b))} == set(range(len(patterns)))


def test_a_lone_passage_is_found_whatever_its_words_numbers():
    rng = random.Random(1)
    items = [(str(i), " ".join(f"w{rng.randrange(3000)}" for _ in range(30))) for i in range(60)]
    for i in range(0, 60, 7):
        found = dc.find_in(dc.Phrases(items, 10), [items[i][1]])[0]
        assert found["n_hit"] == 30 and str(i) in found["items"]


def test_hits_equal_brute_force(monkeypatch):
    rng = random.Random(5)
    for trial in range(200):
        monkeypatch.setattr(dc, "SHARD_WORDS", rng.choice([5, 30, 1000]))
        window = rng.randint(1, 4)
        make = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
        items = [(str(i), make(rng.randint(0, 6))) for i in range(rng.randint(0, 4))]
        texts = [make(rng.randint(0, 25)) + rng.choice(["", " zz ", " A?b "]) for _ in range(rng.randint(1, 6))] + [None]
        found = dc.find_in(dc.Phrases(items, window), texts)
        assert [short(f) for f in found] == list(brute(items, texts, window))


def test_operator_edges_and_blocks(spark, monkeypatch):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Intro. {passage.upper()}; outro"), (1, None), (2, ""), (3, "nothing here"), (3, "nothing here"), (None, f"{passage} {passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'own' AS item_id", "text AS _cleaned")
    bench = spark.createDataFrame([(7, passage), (7, passage), (8, "outro"), (None, None), (9, "")], "item_id long, text string")
    one = {(r.doc_id, r.text): r.found for r in dc.contamination(docs, bench).collect()}
    assert one[rows[0]].n_hit == 12 and one[rows[0]]["items"] == ["7", "8"]
    assert rows[0][1][one[rows[0]].spans[0].start : one[rows[0]].spans[0].end] == passage.upper() + "; outro"
    assert one[(None, rows[5][1])].n_hit == 22 and one[(3, "nothing here")].n_hit == 0 and one[(1, None)].n_words == 0
    whole = sorted(dc.without_contamination(docs, bench).collect(), key=repr)
    assert {(r.doc_id, r.text) for r in whole} == {(1, "Intro. "), (1, None), (2, ""), (3, "nothing here"), (None, "")}
    left = {(r.doc_id, r.text) for r in dc.without_contamination(docs, bench, keep_emptied=False).collect()}
    assert left == {(1, "Intro. "), (1, None), (2, ""), (3, "nothing here")}
    for size in (30, 70, 100):
        monkeypatch.setattr(dc, "BLOCK_BYTES", size)
        assert {(r.doc_id, r.text): r.found for r in dc.contamination(docs, bench).collect()} == one
        assert sorted(dc.without_contamination(docs, bench).collect(), key=repr) == whole
    assert {(r.doc_id, r.text) for r in dc.without_contamination(docs, bench, keep_emptied=False).collect()} == left
    monkeypatch.setattr(dc, "BLOCK_BYTES", 1 << 20)
    assert dc.contamination(docs.limit(0), bench).collect() == []
    assert all(r.found.n_hit == 0 for r in dc.contamination(docs, bench.limit(0)).collect())


def test_cuts_repeat_until_nothing_occurs(spark):
    docs = spark.createDataFrame([(1, "a b a b c d c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    left = dc.without_contamination(docs, bench, window=4).collect()[0].text
    assert all(n == 0 for _, n, _ in brute([("1", "a b c d")], [left], 4))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in op7_decontaminate(spark, SMALL).collect()}
    for doc, (n, hit, found) in zip(docs, brute(items, [d.text for d in docs], 10), strict=True):
        r = got[doc.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
