"""Queries cover all rows of their tables: fixtures that reach beyond the first few keys."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import random

import pytest

import marketloom.queries  # noqa: F401
from marketloom.queries import pairs
from marketloom.registry import QUERIES

N = 13  # suppliers of the fixture
MONTHS = [dt.date(1992 + k // 12, k % 12 + 1, 5) for k in range(66)]


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    """Line items of 13 suppliers in each of 66 months."""
    d = str(tmp_path_factory.mktemp("suppliers"))
    rows = [(s, m, 1000.0 + 37 * s + (s * s * k) % 101 + (7 * k) % 13, float(1 + k % 5)) for s in range(1, N + 1) for k, m in enumerate(MONTHS)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate date, l_extendedprice double, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.mark.parametrize("name", "pair_regression pair_half_life pair_adf_t pair_kss bh_fdr pair_targets diff_correlation".split())
def test_pair_screens_test_all_pairs(spark, suppliers, name):
    got = {(r.a, r.b) for r in QUERIES[name](spark, suppliers).collect()}
    assert got == {(a, b) for a in range(1, N + 1) for b in range(a + 1, N + 1)}


@pytest.mark.parametrize("name", "indexed_series median_traded_value rolling_validation".split())
def test_ticker_queries_cover_all_tickers(spark, suppliers, name):
    assert {r.ticker for r in QUERIES[name](spark, suppliers).collect()} == set(range(1, N + 1))


def test_cross_market_counts_all_tickers(spark, suppliers):
    assert QUERIES["cross_market_summary"](spark, suppliers).first().n == N


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """60 suppliers, 450 orders from 1,900 on, and 601 parts of sizes 1 to 45."""
    d = str(tmp_path_factory.mktemp("whole"))
    days = [dt.date(1992 + k // 12, k % 12 + 1, 5) for k in range(60)]
    items = [(1900 + s, 1 + k % 5, s + 1, s, day, 100.0 + s, 1.0 + k % 5, 0.01 * (k % 9)) for s in range(1, 61) for k, day in enumerate(days)]
    kinds = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_extendedprice double, l_quantity double, l_discount double"
    spark.createDataFrame(items, kinds).write.parquet(f"{d}/lineitem.parquet")
    parts = [(k, f"Brand#{k % 3}", 1 + k % 45, 900.0 + k) for k in range(1, 602)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{d}/part.parquet")
    orders = [(1900 + k, dt.date(1992, 1, 1) + dt.timedelta(days=k), 100.0 + k % 7) for k in range(450)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate date, o_totalprice double").write.parquet(f"{d}/orders.parquet")
    return d


@pytest.mark.parametrize(
    ("name", "key", "n"),
    [
        ("payoff_grid", "trade", 60),
        ("strategy_extremes", "trade", 60),
        ("strategy_mark", "trade", 60),
        ("hedge_lots", "a", 600),
        ("fpca_forecast", "symbol", 60),
        ("strike_lookup_rounded", "id", 601),
        ("two_leg_quotes", "ticker", 59),
        ("business_days_ahead", "o_orderkey", 450),
        ("tenor_interpolation", "symbol", 60),
        ("expiry_common_nearest", "left_id", 59),
        ("isotonic_exceedance", "x", 45),
        ("ewm_std_21", "symbol", 60),
        ("backtest_metrics", "symbol", 60),
        ("backtest_grid", "symbol", 60),
    ],
)
def test_no_key_is_left_out(spark, whole, name, key, n):
    assert len({r[key] for r in QUERIES[name](spark, whole).select(key).collect()}) == n


def test_ewm_std_of_every_day_equals_its_definition(spark, whole):
    """Each supplier by itself."""
    pd = pytest.importorskip("pandas")
    got = {}
    for r in QUERIES["ewm_std_21"](spark, whole).orderBy("d").collect():
        got.setdefault(r.symbol, []).append(r.ewm_std)
    assert len(got) == 60
    for s, found in got.items():
        x = pd.Series([math.log(100 * ((100.0 + s) / (1.0 + k % 5) / 1000) ** 0.05) for k in range(60)])
        want = x.ewm(span=21, adjust=False, min_periods=21).std().tolist()
        assert found[:20] == [None] * 20 and found[20:] == pytest.approx(want[20:], abs=2e-6)


def test_walks_of_every_symbol_begin_after_504_returns(spark, tmp_path):
    rng = random.Random(2)
    days = [dt.date(1992, 1, 1) + dt.timedelta(days=k) for k in range(520)]
    items = [(s, day, 100.0 * rng.uniform(0.5, 2), 1.0) for s in (1, 2, 3) for day in (days if s < 3 else days[:505])]
    spark.createDataFrame(items, "l_suppkey long, l_shipdate date, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {}
    for r in QUERIES["yeo_johnson_walk"](spark, str(tmp_path)).collect():
        assert 0 < r.p < 1
        got.setdefault(r.symbol, []).append(r.d)
    assert {s: sorted(v) for s, v in got.items()} == {str(s): days[505:] for s in (1, 2)}


def test_texts_of_any_script_are_clipped_and_keyed(spark, tmp_path):
    """Every document, split where Python's str.split() splits."""
    spaces = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())
    texts = ["plain words", "two\nlines\tand\r\nmore", "Größe ÄÖ", "слово " * 30, "\u3000東京\u00a0都 ", spaces.join(map(str, range(30))), "", spaces, *(f"a{c}b" for c in spaces)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    clip = {i: hashlib.md5((" ".join(t.split()[:24]) + "…" * (len(t.split()) > 24)).encode()).hexdigest() for i, t in enumerate(texts)}
    key = {i: hashlib.sha256(" ".join(t.lower().split()).encode()).hexdigest()[:32] for i, t in enumerate(texts)}
    assert {r.doc_id: r.clip for r in QUERIES["clip_words"](spark, str(tmp_path)).collect()} == clip
    assert {r.doc_id: r.cache_key for r in QUERIES["query_cache_key"](spark, str(tmp_path)).collect()} == key


def distance(s: str, t: str) -> int:
    row = list(range(len(t) + 1))
    for i, c in enumerate(s, 1):
        last, row[0] = row[0], i
        for j, e in enumerate(t, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
    return row[-1]


def test_near_titles_equal_brute_force(spark, tmp_path):
    rng = random.Random(3)
    titles = ["market report for the week", "a market report for the week", "Xarket report for the week", "short", "shorty", "größere märkte im mai", "größere märkte im maj"]
    for _ in range(40):
        t = "".join(rng.choice("abcd ") for _ in range(rng.randrange(8, 40))).strip() or "x"
        titles.append(t)
        for _ in range(3):
            for _ in range(rng.randrange(1, 6)):
                at = rng.randrange(len(t))
                t = t[:at] + rng.choice(["", "b", "cd"]) + t[at + rng.randrange(2) :] or "x"
            titles.append(t.strip() or "x")
    pages = [(i, f"<title>{t}</title>") for i, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    first = {}
    for i, t in enumerate(titles):
        first.setdefault(t.lower(), i)
    want = {tuple(sorted((i, j))) for s, i in first.items() for t, j in first.items() if i < j and 1 - distance(s, t) / max(len(s), len(t)) >= 0.88}
    got = [(r.a, r.b) for r in QUERIES["title_near_copies"](spark, str(tmp_path)).collect()]
    assert (0, 2) in want and len(got) == len(set(got)) and set(got) == want


def test_prior_closes_reach_back_251(spark, tmp_path):
    rows = [(k, u, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k // 10), float(k)) for u, n in ((1, 60), (2, 300)) for k in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: (r.n, r["mean"]) for r in QUERIES["prior_closes_251"](spark, str(tmp_path)).collect()}
    assert got == {1: (60, 29.5), 2: (251, (49 + 299) / 2)}


def test_top_pairs_of_a_threshold_are_not_five(spark, suppliers):
    near = {(r.a, r.b) for r in QUERIES["pair_adf_t"](spark, suppliers).collect() if r.p <= 0.5}
    assert 20 < len(near) <= 200
    assert {(r.a, r.b) for r in QUERIES["threshold_topn_union"](spark, suppliers).collect()} == near


def test_top_pairs_of_a_threshold_are_told_apart_below_1e_16(spark, monkeypatch):
    # statistics whose p are 2e-16 to 2e-17, later pairs the smaller, and some under the SQL's bound of -8.4, where all p are 0
    t = {(1, b): -10.0 - 0.4 * b / 300 for b in range(2, 302)} | {(0, b): -10.5 - b / 4 for b in range(1, 31)}
    df = spark.createDataFrame([(a, b, x) for (a, b), x in t.items()], "a long, b long, adf_t double")
    monkeypatch.setattr(pairs, "screened", lambda *_: df)
    x = {k: 2.92 + 1.5012 * v + 0.039796 * v * v for k, v in t.items()}
    p = {k: 0.0 if v < -8.4 else 0.5 * math.erfc(-v / math.sqrt(2)) for k, v in x.items()}
    assert {(r.a, r.b) for r in pairs.topn_union(spark, "").collect()} == set(sorted(p, key=lambda k: (p[k], k))[:200])
    assert {(r.a, r.b): r.p for r in pairs.engle_granger(spark, "").collect()} == pytest.approx(p, rel=1e-11, abs=0)
