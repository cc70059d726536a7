from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import filter_audit

DOCS, LABELS = "doc_id long, text string, lang string, mask string, part long", "doc_id long, quality int, toxic int, part string"


def brute(docs, labels):
    """Every filter of every order applied to every document."""
    least: dict[str, int] = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    quality, toxic = {}, {}
    for i, q, x, *_ in labels:
        quality[i], toxic[i] = max(q or 0, quality.get(i, 0)), max(x or 0, toxic.get(i, 0))
    rows = []
    for i, t, lang, *_ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None,
            "E": i is not None and i > least[t],
        }
        rows.append((lang or "", fails, i is not None and quality.get(i) == 1, i is not None and toxic.get(i) == 1))
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, own in enumerate(order, 1):
                goes = [r for r in left if r[1][own]]
                failing = sum(r[1][own] for r in rows if r[0] == part)
                only = sum(r[1][own] and sum(r[1].values()) == 1 for r in rows if r[0] == part)
                left = [r for r in left if not r[1][own]]
                out[part, order, step] = [len(left), len(goes), failing - len(goes), only, sum(r[2] for r in goes), sum(r[3] for r in goes)]
                total[part, own] = total.get((part, own), 0) + len(goes)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def reported(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def test_report_equals_every_order_applied(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcXY"), 3))
    texts = [None, "", "A", "one two", "x # y", " ".join(word() for _ in range(250)), "same " * 230, "é😀 " * 210, "Up $ " * 240]
    texts += [" ".join(f"w{k}{j}" for k in range(220)) for j in range(3)]
    docs = [(None if i % 13 == 0 else i // 2 if i % 7 == 0 else i, texts[int(rng.integers(len(texts)))], [None, "", "en", "de"][i % 4], "m", i) for i in range(160)]
    docs += docs[:9]  # repeated rows
    labels = [(i, int(rng.integers(2)), None if i % 9 == 0 else int(rng.integers(2)), "p") for i in range(0, 150, 2)] + [(None, 1, 1, "p"), (4, 1, 0, "p"), (900, 1, 1, "p")]
    got = reported(filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)))
    want = brute(docs, labels)
    assert {k[0] for k in got} == {"", "en", "de"} and len(got) == 3 * 600
    assert got == want


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, "x", "en", "m", 1)], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
    got = reported(filter_audit.audit(docs, labels))
    assert len(got) == 600 and got["en", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and got["en", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0)


def test_zeta_sums_all_subsets(spark):
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 100, 32).tolist()
    df = spark.createDataFrame([(counts,)], "c array<long>")
    for k in range(5):
        df = df.withColumn("c", filter_audit.subset_zeta(F.col("c"), 1 << k))
    assert df.first().c == [sum(counts[s] for s in range(32) if s & t == s) for t in range(32)]


def test_other_rules(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "", 0), (2, "a b", "en", "", 0), (3, "q", "fr", "", 0)], DOCS)
    rules = {"L": lambda text, words: F.length(text) < 2}
    got = reported(filter_audit.audit(docs, spark.createDataFrame([(2, 1, 0, "")], LABELS), rules))
    assert got["en", "LE", 2] == (1, 1, 0, 1, 1, 0, 2) and got["fr", "EL", 2] == (0, 1, 0, 1, 0, 0, 2) and len(got) == 8


@pytest.mark.parametrize("column", ["doc_id", "text", "lang"])
def test_a_column_of_nulls(spark, column):
    docs = [(1, "a", "en", "", 0), (2, "a", "en", "", 0), (3, "B", "de", "", 0)]
    k = ["doc_id", "text", "lang"].index(column)
    docs = [tuple(None if j == k else v for j, v in enumerate(d)) for d in docs]
    got = reported(filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, 1, 1, "")], LABELS)))
    assert got == brute(docs, [(1, 1, 1, "")])
