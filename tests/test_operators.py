"""Operators and models against small fixtures, known numbers and invariants."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketloom.functions import options as opt
from marketloom.functions import text as tx
from marketloom.functions.numeric import cosine, norm_cdf, positive
from marketloom.models import fits
from marketloom.operators.fdr import benjamini_hochberg
from marketloom.operators.ordered import as_of, ewm_all, latest_per_key, series
from marketloom.plans.conditions import Condition, apply_filters, cap_bounds
from marketloom.queries.backtest import backtest, regressions
from marketloom.queries.options import isotonic_decreasing
from marketloom.sources.tables import require_columns


def test_fdr_of_known_values(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "k int, p double")
    got = {r.k: r.q for r in benjamini_hochberg(df, "p").collect()}
    assert got == pytest.approx({1: 0.03, 2: 0.04, 3: 0.04})


def test_fdr_of_many_values(spark):
    p = np.random.default_rng(0).random(500) ** 3
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "k int, p double")
    order = np.argsort(p)
    raw = p[order] * 500 / np.arange(1, 501)
    want = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    got = {r.k: r.q for r in benjamini_hochberg(df, "p").collect()}
    assert [got[i] for i in order] == pytest.approx(want.tolist())


def test_fdr_of_equal_and_missing_values(spark):
    p = [0.0, 0.0, 1.0, 1.0, 1.0, 0.5, 0.5, None, float("nan"), 0.01]
    got = [r.q for r in benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "k int, p double"), "p").orderBy("k").collect()]
    assert got[7:9] == [None, None]  # no tests: eight are left
    assert got[:7] + got[9:] == pytest.approx([0, 0, 1, 1, 1, 0.8, 0.8, 8 * 0.01 / 3])
    assert benjamini_hochberg(spark.createDataFrame([], "k int, p double"), "p").collect() == []


def test_pair_statistics_edges(spark):
    """Nulls, short, constant and repeated series; pairs meet in one unit only."""
    from marketloom.operators import pair_blocks

    rng = np.random.default_rng(4)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(40)]
    rows = [(f"T{i}", day, float(x)) for i in range(7) for day, x in zip(days, rng.standard_normal(40).cumsum())]
    rows += [("flat", day, 1.0) for day in days] + [("short", days[0], 1.0), ("none", days[0], None)] + rows[:40]
    df = spark.createDataFrame(rows, "ticker string, d date, x double")
    whole = {(r.a, r.b): r for r in pair_blocks.pair_statistics(df, formation=30, window=5).collect()}
    names = sorted([f"T{i}" for i in range(7)] + ["flat"])
    assert sorted(whole) == [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    x = {n: np.array([r[2] for r in rows if r[0] == n][:40])[-30:] for n in names}
    for (a, b), r in whole.items():
        if "flat" not in (a, b):
            assert (r.beta, r.cor) == pytest.approx((np.polyfit(x[b], x[a], 1)[0], np.corrcoef(x[a], x[b])[0, 1]))
    assert whole[("T0", "flat")].beta is None and whole[("T0", "flat")].adf_t is None
    before, pair_blocks.BLOCK = pair_blocks.BLOCK, 2
    try:
        cut = {(r.a, r.b): r for r in pair_blocks.pair_statistics(df, formation=30, window=5).collect()}
    finally:
        pair_blocks.BLOCK = before
    assert cut == whole
    assert pair_blocks.pair_statistics(df.limit(0), formation=30).collect() == []


def test_isotonic_of_known_values(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.8, 0.6, 0.7, 0.2])], "k int, x int, y double")
    got = [r.fitted for r in isotonic_decreasing(df, "k", "x", "y").orderBy("x").collect()]
    assert got == pytest.approx([0.8, 0.65, 0.65, 0.2])


def test_greeks_of_known_values(spark):
    one = spark.range(1).select(*[F.lit(v).alias(n) for n, v in (("s", 100.0), ("k", 100.0), ("t", 1.0), ("r", 0.05), ("v", 0.2))])
    args = [F.col(c) for c in "sktrv"]
    row = one.select(*[c.alias(n) for n, c in opt.greeks(*args, F.lit(True)).items()]).first()
    assert (row.delta, row.gamma, row.vega, row.rho) == pytest.approx((0.636831, 0.018762, 0.37524, 0.532325), abs=1e-5)
    back = one.select(opt.implied_vol(opt.price(*args, F.lit(False)), *args[:4], F.lit(False)).alias("v"), norm_cdf(F.lit(1.0)).alias("n")).first()
    assert back.v == pytest.approx(0.2, abs=1e-6) and back.n == pytest.approx(0.5 * (1 + math.erf(1 / math.sqrt(2))), abs=1e-14)


def test_filters_keep_what_is_not_verified(spark):
    df = spark.createDataFrame([("a", "Tech", 100.0), ("b", None, 100.0), ("c", "Bank", None), ("d", "Tech", 900.0)], "ticker string, sector string, market_cap double")
    plan = [Condition("sector", "eq", "tech"), Condition("market_cap", "around", 100)]
    assert sorted(r.ticker for r in apply_filters(df, plan).collect()) == ["a", "b"]
    assert cap_bounds(Condition("market_cap", "between", (5, 2))) == (2, 5) and cap_bounds(Condition("market_cap", "gte", 5)) == (5, None)


def test_latest_and_as_of(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 1, None)], "k int, t int, v string")
    assert {(r.k, r.v) for r in latest_per_key(df, ["k"], "t").collect()} == {(1, "b"), (2, None)}
    left = spark.createDataFrame([(1, 2), (1, 3), (3, 1)], "k int, t int")
    assert {(r.k, r.t, r.asof_v) for r in as_of(left, df, "k", "t", ["v"]).collect()} == {(1, 2, "a"), (1, 3, "b"), (3, 1, None)}


def test_as_of_over_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    left = sorted({(int(k), int(t)) for k, t in zip(rng.integers(0, 3, 80), rng.integers(0, 500, 80), strict=True)})
    right = [(int(k), int(t), int(v)) for k, t, v in zip(rng.integers(0, 3, 60), rng.integers(0, 500, 60), rng.integers(0, 9, 60), strict=True)]
    right += [(0, 250, None), (None, 3, 5), (1, None, 5)]
    l = spark.createDataFrame([*left, (None, 9), (1, None)], "k int, t int")
    r = spark.createDataFrame(right, "k int, t int, v int")
    # of several at one time the largest counts, null least
    rank = lambda x: (x[1], -1 if x[2] is None else x[2])
    want = {(k, t): max((x for x in right if x[0] == k and x[1] is not None and x[1] <= t), key=rank, default=(0, 0, None))[2] for k, t in left}
    for width in (10, 86_400):
        got = {(x.k, x.t): x.asof_v for x in as_of(l, r, "k", "t", ["v"], block_seconds=width).collect()}
        assert got == want | {(None, 9): None, (1, None): None}


def test_iron_structures_lose_at_most_what_they_state(spark):
    from marketloom.queries.options import iron_strategies

    rows = iron_strategies(spark, "/root/testdata/sf0.001").collect()
    assert {r.kind for r in rows} <= {"iron_butterfly", "iron_condor"} and rows
    for r in rows:
        assert r.k1 < r.k2 <= r.k3 < r.k4
        pay = lambda x: r.credit - max(r.k2 - x, 0) - max(x - r.k3, 0) + max(r.k1 - x, 0) + max(x - r.k4, 0)  # noqa: B023, E731
        assert min(map(pay, (r.k1, r.k2, r.k3, r.k4))) == pytest.approx(-r.max_loss, abs=1e-3)
        assert pay(r.k2) == pytest.approx(r.credit)


def test_ewm_equals_pandas(spark):
    pd = pytest.importorskip("pandas")
    x = [1.0, 4.0, 2.0, 8.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k int, t int, v double")
    got = series(df, "k", ["t"], v=F.col("v")).select(ewm_all(F.col("v"), 0.3).alias("e")).first().e
    assert got == pytest.approx(pd.Series(x).ewm(alpha=0.3, adjust=False).mean().tolist())


def test_no_look_ahead_and_two_close_lag(spark):
    prices = [100.0 + i + (i % 3) for i in range(60)]
    df = lambda ps: spark.createDataFrame([("A", i, i + 1, p) for i, p in enumerate(ps)], "symbol string, d int, t int, price double")
    one = [tuple(r) for r in backtest(regressions(df(prices))).select("d", "position", "equity").orderBy("d").collect()]
    two = [tuple(r) for r in backtest(regressions(df([*prices[:-1], 1.0]))).select("d", "position", "equity").orderBy("d").collect()]
    assert one[:-1] == two[:-1] and one[-1] != two[-1]
    assert [p for _, p, _ in one].index(1.0) == 20 + 2  # the first full window ends at row 20


def test_text_functions(spark):
    url = "HTTPS://WWW.Ex.com/a/?utm_source=x&b=1&ref=z#top"
    html = "<p>a&amp;b</p><script>x<1</script> <!-- c --> d"
    row = spark.range(1).select(tx.canonical_url(F.lit(url)).alias("u"), tx.domain(F.lit(url)).alias("d"), tx.html_text(F.lit(html)).alias("h"), tx.count_of(F.lit("aXaXa"), "Xa").alias("n")).first()
    assert (row.u, row.d, row.h, row.n) == ("https://www.ex.com/a?b=1", "ex.com", "a&b d", 2)
    vals = spark.createDataFrame([("1.5",), ("-1",), ("x",), (None,), ("inf",)], "s string").select(positive(F.col("s")).alias("p")).collect()
    assert [v.p for v in vals] == [1.5, None, None, None, None]
    assert spark.range(1).select(cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("c")).first().c is None


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing columns: b"):
        require_columns(spark.range(1).toDF("a"), {"a", "b"})


def test_garch_bands_are_ordered_and_repeat():
    rng = np.random.default_rng(41)
    close = 100 * np.exp(np.cumsum(rng.standard_t(5, 300) * 0.01))
    bands = fits.garch_bands("X", close, 5, 400)
    q = bands.filter(like="q").to_numpy()
    assert (np.diff(q, axis=1) >= 0).all() and bands.p_above.between(0, 1).all()
    assert bands.equals(fits.garch_bands("X", close, 5, 400))
    assert (q[4, -1] - q[4, 0]) > (q[0, -1] - q[0, 0])


def test_fpca_recovers_a_low_rank_history():
    t = np.arange(50)[:, None]
    x = 20 + np.sin(t / 5) * np.linspace(1, 2, 20) + 0.5 * np.cos(t / 7) * np.linspace(-1, 1, 20)
    ahead, shares = fits.fpca_next(x, 3)
    assert shares.sum() > 0.999 and np.abs(ahead - x[-1]).max() < 1


@settings(max_examples=50, deadline=None)
@given(st.floats(-1.5, 3.5))
def test_yeo_johnson_is_monotone(lam):
    x = np.linspace(-3, 3, 61)
    assert (np.diff(fits.yeo_johnson(x, lam)) > 0).all()
    assert fits.yeo_johnson(x, 1.0) == pytest.approx(x)


def test_tail_walk_looks_only_back():
    x = np.random.default_rng(7).standard_normal(200)
    a, b = fits.tail_walk(x, least=60), fits.tail_walk(np.append(x[:-1], 50.0), least=60)
    assert np.isnan(a[:60]).all() and np.array_equal(a[60:], b[60:]) and ((a[60:] > 0) & (a[60:] < 1)).all()
