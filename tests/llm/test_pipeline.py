"""The stages of the pipeline: edge rows, and each stage on the small tables against its operator or brute force."""

from __future__ import annotations

import re

import corpus_pipeline as cp
import public_tokenizers
import pytest
import tiktoken

from marketloom.llm import decontaminate as dc
from test_duplicates import plain_components, plain_fingerprint

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, _found int, _key int, _coded int, row int"


@pytest.fixture(scope="module")
def edges(spark):
    passage = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    passage = b" ".join(dc.words_of(passage)).decode()
    long = " ".join(f"word{i % 977} of a very long text" for i in range(20_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en"),
        (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en"),
        (2, "the quick brown fox jumps over the lazy dog near the river bank today", None),
        (3, None, "en"),
        (4, "", "en"),
        (5, " \n\t ", "en"),
        (6, "12345 !!", "en"),
        (7, passage, "en"),
        (8, f"before it {passage} after it", "en"),
        (None, "un texte sans numéro de ligne, écrit à la main", "fr"),
        (9, "write to jo.doe@mail.example.org or call +49 (30) 1234 5678 today", "en"),
        (10, long, "en"),
        (11, "日本語のテキスト", None),
    ]
    made = [(i, t, g, "s", len(t or ""), "own", 5, 6, 7, k) for k, (i, t, g) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA), passage


def rows(df):
    return sorted((r.row for r in df.collect()))


def stage(name):
    return dict(cp.STAGES)[name]


def test_stage_names_and_columns(spark, edges):
    docs, _ = edges
    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_dedup", "decontamination", "pii", "byte_bpe"]
    for name, f in cp.STAGES[:-1]:
        assert f(spark, docs, SMALL).columns == docs.columns, name
        assert f(spark, docs.limit(0), SMALL).collect() == [], name
    assert cp.encode_texts(spark, docs.limit(0), SMALL).collect() == []


def test_language_stage(spark, edges):
    kept = stage("language_id")(spark, edges[0], SMALL)
    assert rows(kept) == [0, 1, 2, 7, 8, 9, 10, 11, 12]  # neither null nor letter-free
    assert {r.lang for r in kept.collect()} <= {"en", "fr"}


def test_dedup_stage(spark, edges):
    kept = stage("simhash_dedup")(spark, edges[0], SMALL).collect()
    got = {(r.doc_id, r.text) for r in kept}
    assert len(kept) == len(got)
    assert [r.doc_id for r in kept if r.text and r.text.startswith("the quick")] == [1]
    assert [r.doc_id for r in kept if not (r.text or "").strip()] == [3]  # word-free texts are one group
    assert {6, 7, 8, 9, 10, 11, None} <= {r.doc_id for r in kept}


def test_decontamination_stage(spark, edges):
    docs, passage = edges
    kept = {r.row: r for r in stage("decontamination")(spark, docs, SMALL).collect()}
    assert set(range(13)) - set(kept) == {7}  # nothing is left of it
    before, after = kept[8].text[:10], kept[8].text[-9:]
    assert (before, after) == ("before it ", " after it") and kept[8].n_chars == len(kept[8].text)
    original = {r.row: r.text for r in docs.collect()}
    assert all(kept[k].text == original[k] for k in kept if k != 8)


def test_pii_stage(spark, edges):
    docs, _ = edges
    kept = {r.row: r for r in stage("pii")(spark, docs, SMALL).collect()}
    assert sorted(kept) == list(range(13))
    assert kept[10].text == "write to [EMAIL] or call [PHONE] today" and kept[10].n_chars == len(kept[10].text)
    original = {r.row: r.text for r in docs.collect()}
    assert all(kept[k].text == original[k] for k in kept if k != 10)


def test_encoding_stage(spark, edges):
    docs, _ = edges
    out = stage("byte_bpe")(spark, docs, SMALL)
    assert out.columns == [*[c if c != "ids" else "_ids" for c in docs.columns], "ids", "n_tokens"]
    coded = {r.row: r for r in out.collect()}
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in docs.collect():
        got = coded[r.row]
        assert got.ids == plain.encode_ordinary(r.text or "") and got.n_tokens == len(got.ids)
        assert got.text == (r.text or "") and got._ids == "own"


def test_whole_run_against_brute_force(spark):
    """Which documents stay follows from brute force; no benchmark window and no plain e-mail address is left."""
    out = {r.doc_id: r for r in cp.run(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    lettered = [d for d in docs if re.search(r"[^\W\d_]", d.text or "")]
    fps = [plain_fingerprint(d.text) for d in lettered]
    first = {}
    for d, root in zip(lettered, plain_components(fps), strict=True):
        first[root] = min(first.get(root, d.doc_id), d.doc_id)
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        words = dc.words_of(r.text)
        windows |= {tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9))}
    stayed = {i for i in first.values() if i in out}
    assert set(out) == stayed
    for i in set(first.values()) - stayed:  # cut to nothing
        text = next(d.text for d in docs if d.doc_id == i)
        assert any(tuple(dc.words_of(text)[k : k + 10]) in windows for k in range(len(dc.words_of(text))))
    for r in out.values():
        words = dc.words_of(r.text)
        assert not any(tuple(words[k : k + 10]) in windows for k in range(len(words)))
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)
        assert r.n_chars == len(r.text) and r.n_tokens == len(r.ids)
