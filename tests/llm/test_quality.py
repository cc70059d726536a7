from __future__ import annotations

import re
import zlib

import numpy as np
import pytest

from marketloom.llm import quality
from marketloom.llm.queries import op11_quality

DOC, LABEL = "doc_id long, text string", "doc_id long, quality int"




def plain_words(text: str) -> list[bytes]:
    return [m.group().lower() for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|([!-/:-@\[-`{-~])\1*", text.encode())]


def plain_index(word: bytes) -> np.ndarray:
    key, _ = quality.words([word])
    out = np.zeros(quality.DIM)
    for place, sign in quality.index_places(key):
        out[place[0]] += sign
    return out


def test_words_equal_a_plain_split():
    texts = ["One two ONE 12a $$$ $% x--y\n\tend.", "", "é é!", "one"]
    key, part = quality.words([t.encode() for t in texts])
    split = [plain_words(t) for t in texts]
    assert np.bincount(part, minlength=4).tolist() == [len(s) for s in split]
    flat = [w for s in split for w in s]
    for i, a in enumerate(flat):
        for j, b in enumerate(flat):
            assert (key[i] == key[j]) == (a == b)


def test_context_sums_equal_plain_loops():
    parts = [b"a b c a d", b"b", b"", b"c a"]
    key, part = quality.words(parts)
    total = np.zeros(quality.DIM << quality.BITS, np.int64)
    quality.context_sums(key, part, total)
    want = np.zeros((1 << quality.BITS, quality.DIM))
    for p in parts:
        ws = p.split()
        for i, own in enumerate(ws):
            row = int(quality.words([own])[0][0] >> np.uint64(64 - quality.BITS))
            for j, other in enumerate(ws):
                if 0 < abs(i - j) <= quality.WINDOW:
                    want[row] += np.roll(plain_index(other), j - i)
    assert (total.reshape(-1, quality.DIM) == want).all()


def test_pooling_equals_plain_means():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(1 << quality.BITS, quality.DIM)).astype(np.float32)
    texts = ["a b a", None, "", "c", "a a a a $$"]
    got = quality.pooled(texts, vectors)
    for text, row in zip(texts, got, strict=True):
        ws = plain_words(text) if text else []
        n = max(1, len(ws))
        index = sum((plain_index(w) for w in ws), np.zeros(quality.DIM)) / n
        context = sum((vectors[int(quality.words([w])[0][0] >> np.uint64(64 - quality.BITS))].astype(float) for w in ws), np.zeros(quality.DIM)) / n
        alike = [sum(plain_index(a) @ plain_index(b) for a, b in zip(ws, ws[k:])) / n for k in range(1, quality.WINDOW + 1)]
        assert row == pytest.approx([*index, *context, np.linalg.norm(index), np.linalg.norm(context), *alike, np.log1p(len(ws))])


def test_long_texts_are_read_whole():
    vectors = np.ones((1 << quality.BITS, quality.DIM), np.float32)
    before, quality.PIECE = quality.PIECE, 50
    try:
        text = "some words é " * 40 + "x" * 120 + "é" * 60
        small = quality.pooled([text, "q", text], vectors)
        assert sum(len(b"".join(p)) for p, _ in quality._pieces([text])) == len(text.encode())
        for p, _ in quality._pieces([text]):
            for b in p:
                b.decode()  # never cut inside a code point
    finally:
        quality.PIECE = before
    whole = quality.pooled([text, "q", text], vectors)
    assert (small[0] == small[2]).all()
    assert abs(np.expm1(small[0, -1]) - np.expm1(whole[0, -1])) <= 5  # only the words without white space are cut


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 5))
    truth = 1 / (1 + np.exp(-(2 * x[:, 0] * x[:, 1] + x[:, 2])))  # no linear function tells this
    y = (rng.random(6000) < truth).astype(float)
    kept_out = np.arange(6000) % 5 == 0
    model = quality.fit_network(x, y, np.ones(6000), kept_out)
    fresh = rng.normal(size=(4000, 5))
    want = 1 / (1 + np.exp(-(2 * fresh[:, 0] * fresh[:, 1] + fresh[:, 2])))
    assert np.abs(model.scores(fresh) - want).mean() < 0.08
    logits = model.logits(x[kept_out])
    loss = lambda t: quality.log_loss(logits / t, y[kept_out], np.ones(kept_out.sum()))
    assert loss(model.temperature) <= min(loss(model.temperature * 1.1), loss(model.temperature / 1.1), loss(1.0)) + 1e-9


def test_vectors_count_the_whole_table(spark):
    docs = [(i, "a b c" if i % 2 else "b d") for i in range(50)] + [(None, None), (7, "")]
    got = quality.word_vectors(spark.createDataFrame(docs, DOC).repartition(7))
    total = np.zeros(quality.DIM << quality.BITS, np.int64)
    quality.context_sums(*quality.words([(t or "").encode() for _, t in docs]), total)
    want = total.reshape(-1, quality.DIM).astype(float)
    size = np.linalg.norm(want, axis=1, keepdims=True)
    assert got == pytest.approx(want / np.where(size > 0, size, 1), abs=1e-6)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(i, None if i == 0 else "" if i == 1 else "good plain words here" if i % 2 else "$$$ $$$ bad *** bad", i) for i in range(80)], DOC + ", Score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2, 60)] + [(None, 1), (3, None), (3, 0), (999, 0)], LABEL)
    model = quality.train(docs, labels)
    scored = quality.score(docs, model)
    assert scored.columns == ["doc_id", "text", "_Score", "score"]
    rows = {r.doc_id: r.score for r in scored.collect()}
    assert len(rows) == 80 and all(0 <= s <= 1 for s in rows.values())
    assert rows[0] == rows[1] and rows[3] > 0.5 > rows[4] and rows[61] == rows[63]
    assert quality.score(docs.limit(0), model).collect() == []
    only_good = quality.train(docs, labels.where("quality = 1"))
    assert {r.score for r in quality.score(docs, only_good).collect()} == {1.0}
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.0}
    assert {r.score for r in quality.score(docs, quality.train(docs.limit(0), labels)).collect()} == {0.0}  # no label has a document


def test_held_out_documents(spark):
    """Learned from four folds of five, the scores tell the good documents of the fifth from the others."""
    where = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    rows = op11_quality(spark, where).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [h for h in held if h[2]], [h for h in held if not h[2]]
    assert len(good) > 500 and len(bad) > 50
    assert np.mean([[a > b for b, _, _ in bad] for a, _, _ in good]) > 0.99
    assert np.mean([p for _, p, _ in good]) > 0.99 and np.mean([p for _, p, _ in bad]) < 0.1
    for low, high in ((0.0, 0.5), (0.9, 1.01)):  # calibrated: the mean score is the share of good documents
        part = [(s, y) for s, _, y in held if low <= s < high]
        assert abs(np.mean([s - y for s, y in part])) < 0.1
