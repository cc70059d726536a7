from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketloom.llm import fill_middle
from marketloom.llm.fill_middle import Checkpoints, fill_in_middle, restored

PLAIN_UNITS = {"char": r"(?s).", "word": r"(?s)[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", "line": r"[^\n]*\n|[^\n]+"}


def plain_cut(text: str, unit: str, k: int) -> str:
    """The first k units, by a list of all of them."""
    return "".join(re.findall(PLAIN_UNITS[unit], text)[:k])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é😀\n\t", max_size=60), st.sampled_from(["char", "word", "line"]), st.integers(1, 7))
def test_cuts_equal_those_of_a_list_of_all_units(text, unit, step):
    index = Checkpoints(text.encode(), unit, step)
    units = re.findall(PLAIN_UNITS[unit], text)
    assert "".join(units) == text and index.n == len(units)
    for k in range(len(units) + 1):
        head = "".join(units[:k])
        assert index.cut(k) == (len(head.encode()), len(head))


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_long_texts_cross_blocks_and_checkpoints(unit):
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(["a", "ñ", "😀", " ", "\n", "word"], 150_000))
    index = Checkpoints(text.encode(), unit)
    assert len(index.units) == -(-index.n // fill_middle.STEP)  # sparse
    for k in [0, 1, 511, 512, 513, index.n // 2, index.n - 1, index.n]:
        head = plain_cut(text, unit, k)
        assert index.cut(k) == (len(head.encode()), len(head))
    with pytest.raises(ValueError):
        index.cut(index.n + 1)


def brute(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", n, None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return "spm", n, len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return "psm", n, len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_rows_equal_brute_force_and_restore_exactly(spark):
    texts = [None, "", "x", "<P>", "a<M>b", "<", "<<S", "é😀" * 700, "P>S>M>", "long " * 30_000, " \n", "tie", "tie"]
    docs = [(i if i % 17 else None, t, f"kept {i}") for i, t in enumerate(texts * 12)]
    made = fill_in_middle(spark.createDataFrame(docs, "doc_id long, text string, FIM string"))
    assert made.columns == ["doc_id", "text", "_FIM", "fim"]
    rows = made.withColumn("back", restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert sorted(r._FIM for r in rows) == sorted(d[2] for d in docs)
    forms = set()
    for r in rows:
        f = r.fim
        assert (f.form, f.n, f.prefix_chars, f.middle_chars, f.output) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "")
        forms.add(f.form)
    assert forms == {"plain", "psm", "spm"}


def test_other_units_and_shares(spark):
    docs = spark.createDataFrame([(i, "one two three\nfour five\n" * 3) for i in range(60)], "doc_id long, text string")
    rows = fill_in_middle(docs, unit="word", plain_percent=0, spm_percent=100, seed=7).collect()
    assert {r.fim.form for r in rows} == {"spm"} and {r.fim.n for r in rows} == {16}
    words = re.findall(PLAIN_UNITS["word"], rows[0].text)
    starts = {len("".join(words[:k])) for k in range(len(words) + 1)}
    assert all(r.fim.prefix_chars in starts and r.fim.prefix_chars + r.fim.middle_chars in starts for r in rows)
    assert {r.fim.form for r in fill_in_middle(docs, plain_percent=100).collect()} == {"plain"}
    assert fill_in_middle(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        fill_in_middle(docs, unit="page")
