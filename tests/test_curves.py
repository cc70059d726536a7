from __future__ import annotations

import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketloom.operators import curves
from marketloom.operators import distribution as dist

QUOTE = "symbol string, strike double, is_call boolean, iv double, volume double, oi double, bid double, ask double, spot double, t double, r double"


def min_max(v, w):
    n = len(v)
    mean = lambda j, k: sum(a * b for a, b in zip(v[j : k + 1], w[j : k + 1])) / sum(w[j : k + 1])
    return [min(max(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-1, 2), st.floats(0.01, 5)), max_size=9))
def test_pooled_fit_equals_the_min_max_form(points):
    v, w = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    got = curves.pooled_decreasing(v, w, np.array([0, len(v)]))
    assert got == pytest.approx(min_max(v.tolist(), w.tolist()), abs=1e-9)


def test_pooled_fit_is_linear():
    rng = np.random.default_rng(0)
    took = []
    for n in (10_000, 80_000):
        for v in (rng.random(n), np.arange(n, dtype=float), -np.arange(n, dtype=float)):
            begin = time.perf_counter()
            got = curves.pooled_decreasing(v, np.ones(n), np.array([0, n]))
            took.append(time.perf_counter() - begin)
            assert (np.diff(got) <= 1e-9).all() and got.sum() == pytest.approx(v.sum())
    assert max(took[3:]) < 40 * max(max(took[:3]), 0.01)


def test_decreasing_fit_clamps_and_keeps_lengths(spark):
    rows = [(1, [0.2, 0.9, 1.4], [1.0, 1.0, 2.0]), (2, [], []), (3, [-0.5], [0.0]), (4, [0.3, 0.3], [0.0, 5.0]), (5, [0.9, 0.1, 0.5], [1.0, 1.0, 3.0])]
    got = {r.k: r.f for r in spark.createDataFrame(rows, "k int, v array<double>, w array<double>").select("k", curves.decreasing_fit(F.col("v"), F.col("w")).alias("f")).collect()}
    assert got == {1: pytest.approx([0.975] * 3), 2: [], 3: [0.0], 4: pytest.approx([0.3, 0.3]), 5: pytest.approx([0.9, 0.4, 0.4])}


def plain_tangents(x, y):
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return [s[0], s[0]]

    def end(h1, h2, s1, s2):
        t = ((2 * h1 + h2) * s1 - h1 * s2) / (h1 + h2)
        if np.sign(t) != np.sign(s1):
            return 0.0
        return 3 * s1 if np.sign(s1) != np.sign(s2) and abs(t) > abs(3 * s1) else t

    m = [end(h[0], h[1], s[0], s[1])]
    for i in range(1, len(x) - 1):
        a, b = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
        m.append(0.0 if s[i - 1] * s[i] <= 0 else (a + b) / (a / s[i - 1] + b / s[i]))
    return [*m, end(h[-1], h[-2], s[-1], s[-2])]


def test_monotone_curve(spark):
    rng = np.random.default_rng(5)
    shapes = {f"d{k}": (np.sort(rng.choice(400, 12, replace=False)).astype(float), np.sort(rng.random(12))[::-1]) for k in range(6)}
    shapes["two"] = (np.array([0.0, 4.0]), np.array([1.0, 0.0]))
    shapes["flat"] = (np.arange(5.0), np.array([1, 1, 0.5, 0.5, 0.0]))
    shapes["wave"] = (np.array([0.0, 1, 2, 3, 9]), np.array([0.0, 3, -1, 2, 2.5]))
    shapes["wide"] = (np.array([0.0, 700, 2500]), np.array([1.0, 0.2, 0.1]))
    rows = [(k, float(a), float(b)) for k, (x, y) in shapes.items() for a, b in zip(x, y)]
    rows += [("one", 3.0, 0.4), ("null", None, 0.1), ("null", 1.0, None), ("two", 0.0, 0.5), (None, 1.0, 1.0), (None, 2.0, 0.0)]
    points = spark.createDataFrame(rows, "symbol string, x double, y double")
    segments = {}
    for r in curves.monotone_segments(points, "symbol").collect():
        segments.setdefault(r.symbol, []).append(r)
    for k, (x, y) in shapes.items():
        own = sorted(segments[k], key=lambda r: r.x0)
        assert [r.m0 for r in own] + [own[-1].m1] == pytest.approx(plain_tangents(x, y)), k
    got = {}
    for r in curves.monotone_curve(points, "symbol").collect():
        got.setdefault(r.symbol, []).append((r.i, r.x, r.y))
    assert got["one"] == [(0, 3.0, 0.4)] and "null" not in got and len(got[None]) == 201
    for k, (x, y) in shapes.items():
        samples = sorted(got[k])
        steps = min(1600, max(200, math.ceil(x[-1] - x[0])))
        assert [i for i, _, _ in samples] == list(range(steps + 1))
        assert samples[0][2] == pytest.approx(y[0]) and samples[-1][2] == pytest.approx(y[-1])
        for _, at, v in samples:
            j = min(len(x) - 2, max(0, int(np.searchsorted(x, at)) - 1))
            assert min(y[j], y[j + 1]) - 1e-12 <= v <= max(y[j], y[j + 1]) + 1e-12
        if k[0] == "d":
            assert (np.diff([v for _, _, v in samples]) <= 1e-12).all()
    assert curves.monotone_curve(points.limit(0), "symbol").collect() == []


def test_distribution_edge_rows(spark):
    def leg(s, k, call, iv=20.0, volume=5.0, oi=5.0, bid=1.0, ask=1.1, spot=100.0, t=0.25):
        return (s, float(k), call, iv, volume, oi, bid, ask, spot, t, 0.05)

    rows = [leg("ok", k, k >= 100, iv=18.0 + k % 7) for k in range(80, 125, 5)] * 2  # repeated quotes count once
    rows += [leg("ok", 60, False, iv=None), leg("ok", 65, False, iv=None), leg("ok", 65, True, iv=30.0)]  # the other leg steps in
    rows += [leg("ok", 70, False, volume=0.0, oi=None), leg("ok", 72, False, bid=1.0, ask=3.0), leg("ok", 74, False, bid=3.0, ask=1.0), leg("ok", None or 76, False, iv=250.0)]
    rows += [leg("few", k, True) for k in (100, 105)] + [leg("dead", k, True, volume=0.0, oi=0.0) for k in (90, 100, 105, 110)]
    rows += [leg("none", k, True, spot=None) for k in (90, 100, 105, 110)] + [leg("late", k, True, t=0.0) for k in (90, 100, 105, 110)]
    df = spark.createDataFrame(rows, QUOTE)
    got = {r.symbol: r for r in dist.distributions(df).collect()}
    ok = got["ok"]
    assert ok.available and ok.strikes == [65.0, 74.0, *[float(k) for k in range(80, 125, 5)]]
    assert ok.total_strikes == 15 and ok.strikes_used == 11
    assert all(a >= b for a, b in zip(ok.above, ok.above[1:])) and 0 <= ok.above[-1] <= ok.above[0] <= 1
    assert ok.range_80_low <= ok.range_50_low <= ok.median_price <= ok.range_50_high <= ok.range_80_high
    assert ok.iv_coverage == pytest.approx(100 * 13 / 15) and ok.active_coverage == pytest.approx(100 * 12 / 15)
    for k in ("few", "dead", "none", "late"):
        assert not got[k].available and got[k].quality_label == "unavailable" and got[k].median_price is None
    parts = dist.ranges(dist.distributions(df)).collect()
    assert {r.symbol for r in parts} == {"ok"} and len(parts) == 12
    assert sum(r.probability for r in parts) == pytest.approx(1, abs=1e-5) and sum(r.likeliest for r in parts) == 1
    assert [r.low for r in parts if r.i == 0] == [None] and [r.high for r in parts if r.i == 11] == [None]
    assert dist.distributions(df.limit(0)).collect() == [] and dist.ranges(dist.distributions(df.limit(0))).collect() == []
