"""Personal data, chats, archives, neighbours."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from marketloom.llm import chat, neighbours, pii, warc
from marketloom.llm.queries import op5_pii, op10_neighbours

SMALL = "/root/testdata/sf0.001"
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute_spans(text):
    spans = [(m.start(), n, m.end()) for n, (k, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if good(k, m[0])]
    return sorted(spans)


HARD = [
    None,
    "",
    "mail a.b%c@x-y.co.uk, c@d and e@f.g@h.i 😀 é a@b.c%x@d.e",
    "ip 1.2.3.4.5.6.7.8 256.1.1.1 0.0.0.255 001.002.003.0000255 1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112; 4111  1111111111111; 0810992847249404",
    "call +1 (741) 555-3069, +44 20 7946 0958. or +1-2 +999999999999999999",
    "+1 " * 50 + "7",
    "9" * 30000,
    "a" * 50000 + "@",
    "(" * 20000 + "+1((((((" * 200,
    "1.1.1.1 " * 700 + "x@y.zz " * 300,
]


def test_base_spans_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)] + [(2, HARD[2])], "doc_id long, text string")
    for r in pii.find_pii(docs).collect():
        assert [tuple(s) for s in r.base_pii] == brute_spans(r.text), (r.text or "")[:60]


def test_contexts_find_unseen_identifiers(spark):
    seeds = [(i, f"note {i} send mail to user{i}@site{i}.org please") for i in range(20)]
    hidden = [(50, "then send mail to joe77 please"), (51, "nobody saw joe77 there"), (52, "call joe78 there"), (53, None)]
    docs = spark.createDataFrame(seeds + hidden, "doc_id long, text string").withColumn("_h1", F.lit("own"))
    got = {r.doc_id: [tuple(s) for s in r.pii] for r in pii.find_pii(docs).collect()}
    assert got[50] == [(18, 0, 23)] and got[51] == [(11, 0, 16)] and got[52] == [] and got[53] == []
    red = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert red[50] == "then send mail to [EMAIL] please" and red[3] == "note 3 send mail to [EMAIL] please" and red[53] is None
    assert pii.find_pii(docs.limit(0)).collect() == []


def test_pii_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in op5_pii(spark, SMALL).collect():
        spans = brute_spans(texts[r.doc_id])
        said = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in spans) for n in range(4)]
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_running_sums_of_long_arrays(spark):
    got = spark.range(1).select(pii.running_sums(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: x.cast("long"))).alias("s")).first().s
    assert got == np.cumsum(np.arange(1, 1001)).tolist()


def test_chats(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (4, 0, "user", "ho")]
    turns += [(4, 0, "user", "ho"), (None, 0, "user", "hi"), (5, None, None, None), (5, 1, "user", "<|im_end|>")]
    turns += [(9, i, "user", "ho" if i == 0 else f"t{i}") for i in range(700)] + [(8, i, "user", "ho" if i == 0 else f"t{i}") for i in range(300)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("own"))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(got) == {2, 5, 9}  # 1, 4 and 8 are prefixes, 3 equals 2
    assert got[2].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nyo<|im_end|>\n"
    assert got[5].rendered == "<|im_start|>unknown\n<|im_end|>\n<|im_start|>user\n<\\|im_end|><|im_end|>\n"
    assert got[9].n_turns == 700
    assert chat.format_chats(df.limit(0)).collect() == []


def test_archives_round_trip(spark):
    body = "<html>" + "x" * 50
    rows = [(i, f"http://a/{i}", f"{body}{i % 40}" + "lorem ipsum dolor " * (i % 60)) for i in range(300)]
    rows += [(900, None, None), (901, "u\r\nv", ""), (None, "n", "only"), (902, "d", "dup"), (903, "d", "dup"), (903, "d", "dup"), (950, "l", "é" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    manifest = warc.write_archives(pages, warc.archive_folder(spark))
    got = warc.read_archives(manifest, payloads=True).collect()
    assert len(got) == len(rows) and manifest.agg(F.sum("records")).first()[0] == len(rows)
    last = {}
    for page, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if page is None else page)
    want = sorted(
        (page if page is not None else -1, len((html or "").encode()), base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode(), None if page is None or last[html or ""] == page else last[html or ""])
        for page, _, html in rows
    )
    assert sorted(((r.page_id if r.page_id is not None else -1), r.payload_bytes, r.payload_digest, r.refers_to) for r in got) == want
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in got)
    html = {r[0]: r[2] for r in rows}
    assert all(bytes(r.payload).decode() == (html[r.page_id] or "") for r in got if r.record_type == "response")
    empty = warc.write_archives(pages.limit(0), warc.archive_folder(spark))
    assert warc.read_archives(empty).collect() == []


def test_archive_has_its_dictionary_in_front(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " + "some words in common " * 20) for i in range(800)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(pages, f"file://{tmp_path}/w").first().path.removeprefix("file://")
    data = open(path, "rb").read()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    size = int.from_bytes(data[4:8], "little")
    import zstandard

    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
    assert first.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_neighbours_equal_brute_force_nearly(spark):
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((1200, 16)).astype(np.float32)
    vectors[100:160] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 3), (5004, [None] * 16), (None, [1.0] * 16), (7, rows[7][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("shard", F.lit("own"))
    got = neighbours.nearest_neighbours(df, F.col("vec_id") % 50 == 0, shard_rows=400).collect()
    wide = vectors.astype(np.float64)
    norms = np.sqrt((wide * wide).sum(axis=1))
    hits = total = 0
    for q in range(0, 1200, 50):
        score = wide @ wide[q] / (norms * norms[q])
        score[q] = -9
        best = np.lexsort((np.arange(1200), -np.round(score, 12)))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(score[v] - s) < 1e-12 for _, v, s in mine)
        hits, total = hits + len({v for _, v, _ in mine} & set(best.tolist())), total + 5
    assert hits / total >= 0.9
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == [100, 101, 102, 103, 104]
    assert neighbours.nearest_neighbours(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    two = neighbours.nearest_neighbours(df.where("vec_id IN (0, 3)"), F.col("vec_id") == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in two] == [(0, 1, 3)]


def test_rows_with_equal_ids_and_extreme_components(spark):
    """Other rows of the query's id are candidates; norms neither overflow nor vanish."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.1]), (0, [1.0, 0.0]), (1, [1e-200, 1e-201]), (2, [1e200, 3e200]), (3, [0.0, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(df, F.col("vec_id") == 0).orderBy("query_id", "rank").collect()
    assert len(got) == 15 and all(abs(r.score) < 1 + 1e-12 for r in got)
    lists = sorted(tuple((r.vec_id, round(r.score, 9)) for r in got if r.rank == n) for n in (1, 2, 3, 4, 5))
    near, far = round(1 / 1.01**0.5, 9), round(10**-0.5, 9)
    first = [(r.vec_id, round(r.score, 9)) for r in got if r.rank == 1]
    assert sorted(first) == sorted([(0, 1.0), (0, 1.0), (1, 1.0)]) and (2, far) in {x for t in lists for x in t}
    assert (0, near) in {x for t in lists for x in t} and (3, 0.0) in {x for t in lists for x in t}


def test_reach_covers_the_binomial():
    assert neighbours.reach(0.0, 8) == 0 and neighbours.reach(np.pi, 8) == 8
    assert [neighbours.reach(a, 8) for a in (0.1, 0.5, 1.0)] == sorted(neighbours.reach(a, 8) for a in (0.1, 0.5, 1.0))


def test_neighbour_query_has_its_recall(spark):
    where = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{where}/embeddings.parquet").collect()]
    ids, wide = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    norms = np.sqrt((wide * wide).sum(axis=1))
    got = {}
    for r in op10_neighbours(spark, where).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    asked = [i for i in ids.tolist() if i % 50 == 0]
    assert sorted(got) == asked
    hits = 0
    for q in asked:
        score = wide @ wide[ids == q][0] / (norms * norms[ids == q])
        score[ids == q] = -9
        best = ids[np.lexsort((ids, -score))[:5]]
        hits += len(set(best.tolist()) & set(got[q]))
        assert all(abs(score[ids == v][0] - s) < 1e-12 for v, s in got[q].items())
    assert hits / (5 * len(asked)) >= 0.9


def test_every_archive_with_enough_data_has_a_dictionary():
    import random

    rng = random.Random(0)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    page = lambda n: " ".join(rng.choice(words) for _ in range(n)).encode()
    for held in ([page(600_000)], [page(900)], [page(100)] * 20, [page(200), b""], [page(400_000), page(3)]):
        trained = warc.train_dictionary(held)
        assert trained is not None and len(trained.as_bytes()) <= warc.DICTIONARY_BYTES
    assert warc.train_dictionary([b"short"]) is None and warc.train_dictionary([]) is None


def test_types_of_copies_without_ids(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (None, "n", "x"), (None, "n", "x"), (None, "n", "alone"), (None, "n", "alone"), (5, "b", None), (4, "b", ""), (7, "c", "y"), (7, "c", "y"), (2, "a", "x")]
    got = warc.classified(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, bytes(r.payload), r.refers_to) for r in got), key=repr) == sorted(
        [(1, b"x", 2), (2, b"x", None), (2, b"x", None), (None, b"x", 2), (None, b"x", 2), (None, b"alone", None), (None, b"alone", None), (5, b"", None), (4, b"", 5), (7, b"y", None), (7, b"y", None)], key=repr
    )
