from __future__ import annotations

import re

import numpy as np
import xxhash

from marketloom.llm import simhash
from marketloom.llm.components import connected_components
from marketloom.llm.queries import op1_simhash

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def expected(docs):
    fps = [plain_fingerprint(t) for _, t in docs]
    roots = plain_components(fps)
    least = {}
    for (i, _), r in zip(docs, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(docs, fps, roots, strict=True)]


def key(rows):
    return sorted(rows, key=repr)


def found(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = simhash.near_duplicates(df).select("doc_id", simhash.in_hex(simhash.F.col("fp")), "component_id").collect()
    return [tuple(r) for r in got]


def test_near_pairs_equal_brute_force():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = base[rng.integers(0, 400, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    values = np.unique(np.concatenate([base, near, np.arange(300, dtype=np.uint64)]))
    close = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    got = {p for i, j in simhash.near_pairs(values, values) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == set(zip(*[x.tolist() for x in np.nonzero(np.triu(close, 1))], strict=True))
    a, b = np.ascontiguousarray(values[::2]), np.ascontiguousarray(values[1::2])
    got = {p for i, j in simhash.near_pairs(a, b) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == set(zip(*[x.tolist() for x in np.nonzero(close[::2, 1::2])], strict=True))


def test_top_leaves_lose_no_pair(spark):
    rng = np.random.default_rng(1)
    values = np.unique(np.concatenate([rng.integers(0, 2**64, 300, dtype=np.uint64), np.arange(900, dtype=np.uint64)]))
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    starts, depths = simhash.top_leaves(fps, cap=40)
    assert depths.max() > 50  # the dense low values need deep leaves
    leaf = np.searchsorted(starts, values, "right") - 1
    partners = {i: set(simhash.partner_leaves(starts, depths, i)) for i in set(leaf.tolist())}
    close = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    for i, j in zip(*np.nonzero(close), strict=True):
        assert leaf[j] in partners[leaf[i]]


def test_rows_equal_brute_force(spark):
    words = [f"w{i}" for i in range(60)]
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice(words, 80))) for i in range(30)]
    docs += [(100 + i, docs[i % 5][1] + " tail" * (i % 3)) for i in range(20)]
    docs += [(7, docs[7][1]), (None, docs[8][1]), (None, "alone"), (200, None), (201, ""), (202, " \t\n"), (203, "One TWO"), (204, "one two")]
    assert key(found(spark, docs)) == key(expected(docs))
    assert found(spark, docs[:1]) == expected(docs[:1])
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_chains_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (5, 4), (None, 3)], "u long, v long")
    got = dict(map(tuple, connected_components(links).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_one_of_each_stays(spark):
    rows = [(5, "a b c d e f", "x"), (3, "a b c d e f", "y"), (3, "a b c d e f", "y"), (9, "quite another text here", "z"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    assert sorted((r.doc_id for r in simhash.keep_one_of_each(docs).collect()), key=repr) == [3, 9, None]


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert key(tuple(r) for r in op1_simhash(spark, SMALL).collect()) == key(expected(docs))
