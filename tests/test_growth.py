"""What keeps steps from growing faster than their input: shapes of plans and shuffles, with the same results."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions import options as opt
from marketloom.operators import pair_blocks
from marketloom.queries import admin, sources
from marketloom.registry import QUERIES


def test_quotes_are_inverted_by_the_batch(spark):
    """Not by an uncompiled fold; the results are those of a plain bisection, null where nothing is told."""
    rows = [(100.0, 90.0 + k, 0.05 + 0.01 * k, 0.03, 0.1 + 0.02 * k, k % 2 == 0) for k in range(30)]
    cdf = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))

    def price(s, k, t, r, v, call):
        a = (math.log(s / k) + (r + v * v / 2) * t) / (v * math.sqrt(t))
        g = 1 if call else -1
        return g * (s * cdf(g * a) - k * math.exp(-r * t) * cdf(g * (a - v * math.sqrt(t))))

    quotes = [(price(*row), *row[:4], row[5], row[4]) for row in rows]
    quotes += [(-1.0, 100.0, 100.0, 1.0, 0.0, True, None), (None, 100.0, 100.0, 1.0, 0.0, True, None), (float("nan"), 100.0, 100.0, 1.0, 0.0, True, None), (101.0, 100.0, 100.0, 1.0, 0.0, True, None), (5.0, 100.0, 100.0, 0.0, 0.0, True, None)]
    df = spark.createDataFrame(quotes, "p double, s double, k double, t double, r double, call boolean, want double")
    got = df.select("want", opt.implied_vol(*[F.col(c) for c in ("p", "s", "k", "t", "r", "call")]).alias("v"))
    for row in got.collect():
        assert row.v == (None if row.want is None else pytest.approx(row.want, abs=1e-7))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan


def test_series_are_dealt_to_a_bounded_number_of_blocks(spark, monkeypatch):
    """A series is shuffled once for each block: their number stops at ``MOST_BLOCKS``, whatever the series; pairs stay whole."""
    rng = np.random.default_rng(5)
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=j), float(x)) for k in range(40) for j, x in enumerate(rng.standard_normal(12).cumsum()) if k < 38 or j > 1]
    df = spark.createDataFrame(rows, "ticker int, d date, x double")
    monkeypatch.setattr(pair_blocks, "BLOCK", 1)
    made = pair_blocks.pair_statistics(df, formation=11, least=8, window=5)
    assert "sequence(0, 15" in made._jdf.queryExecution().analyzed().toString()
    got = {(r.a, r.b): r for r in made.collect()}
    assert sorted(got) == [(a, b) for a in range(40) for b in range(a + 1, 40)]
    x = {k: np.array([r[2] for r in rows if r[0] == k]) for k in range(40)}
    for (a, b), r in got.items():
        n = min(11, len(x[a]), len(x[b]))
        assert (r.n, r.beta) == (n, pytest.approx(np.polyfit(x[b][-n:], x[a][-n:], 1)[0]))


def test_rolling_z_equals_its_frames():
    rng = np.random.default_rng(6)
    s = np.vstack([rng.standard_normal((5, 80)).cumsum(axis=1) + 1e4, np.full((1, 80), 3.1), np.r_[np.full(40, 0.1), rng.standard_normal(40)][None, :], np.r_[[1e8], rng.standard_normal(79)][None, :]])
    got = pair_blocks.rolling_z(s, 20)
    for i, row in enumerate(s):
        for j in range(80):
            frame = row[j - 19 : j + 1]
            sd = frame.std(ddof=1) if j >= 19 else 0.0
            assert (np.isnan(got[i, j])) if j < 19 or np.ptp(frame) == 0 else got[i, j] == pytest.approx((row[j] - frame.mean()) / sd, abs=1e-6)


def plan_of(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_lots_of_a_pair_stay_in_its_row(spark, tmp_path):
    """No 144 rows a pair; the best cell by fewest contracts, error and lots; null prices give one lot each."""
    price = {1: 10.0, 2: 31.0, 3: 1.0, 4: 400.0, 5: None, 6: 7.0}
    spark.createDataFrame(list(price.items()), "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["hedge_lots"](spark, str(tmp_path))
    assert "explode" not in plan_of(got)
    for r in got.collect():
        x, y = ((25 * (1 + k % 8)) * price[k] if price[k] else None for k in (r.a, r.b))
        if x is None or y is None:
            assert (r.lots_a, r.lots_b, r.error) == (1, 1, None)
            continue
        cells = [(m, n, abs(m * x - n * y) / (m * x)) for m in range(1, 13) for n in range(1, 13)]
        best = min((c for c in cells if c[2] <= 0.15), key=lambda c: (c[0] + c[1], c[2], c[0]), default=None) or min(cells, key=lambda c: (c[2], c[0] + c[1], c[0]))
        assert (r.lots_a, r.lots_b, r.error) == (*best[:2], pytest.approx(best[2], abs=1e-6))


def test_repeated_strikes_meet_once(spark, tmp_path):
    """Equal strikes of a symbol are one row in the join, so n copies don't make n * n pairs."""
    rows = [(k, "B", 30.0 + (k % 3) * 0.03) for k in range(60)] + [(60, None, 30.0), (61, "C", None)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    seen = []
    real = sources.within
    sources.within = lambda *a: seen.append(real(*a)) or seen[-1]
    try:
        got = {r.id: (r.quote, r.quotes) for r in QUERIES["strike_within_tolerance"](spark, str(tmp_path)).collect()}
    finally:
        sources.within = real
    assert seen[0].count() < 60
    for k, symbol, price in rows:
        near = [(p / 3, j) for j, s, p in rows if price is not None and s == symbol == "B" and p is not None and abs(price / 3 + k % 5 * 0.004 - p / 3) <= 0.01]
        assert got[k] == ((min(near)[1] if near else None), len(near))


def test_common_months_are_bits(spark, tmp_path, monkeypatch):
    """A supplier's months are one row, so pairs don't meet once a month; months beyond a word count too."""
    rng = np.random.default_rng(8)
    rows = [(int(s), dt.datetime(1995, 6, 1) + dt.timedelta(days=int(x))) for s in range(9) for x in rng.integers(0, 5000, 6)] + [(None, dt.datetime(1999, 1, 1)), (1, None)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(admin, "MONTHS", 20, raising=False)
    got = QUERIES["expiry_common_nearest"](spark, str(tmp_path))
    assert "bit_or" in plan_of(got)
    months = {s: {d.date().replace(day=1) for k, d in rows if k == s and d and d.year >= 1996} for s in range(9)}
    want = {(a, b): min(months[a] & months[b]) for a in range(9) for b in range(a + 1, 9) if months[a] & months[b]}
    assert {(r.left_id, r.right_id): r.expiry for r in got.collect()} == want and want


def test_days_are_dealt_to_many_small_shares(spark, tmp_path):
    """What a worker is sent at once is the days of one share, not all days of a partition."""
    rows = [(k, 1, k % 9, 1 + k % 7, 5.0, 50.0, dt.datetime(2024, 1, 1 + k % 20)) for k in range(60)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert "RepartitionByExpression" in plan_of(QUERIES["report_futures"](spark, str(tmp_path)))


def test_medians_are_kept_in_order(spark, tmp_path):
    from marketloom.queries.backtest import expanding_medians

    rng = np.random.default_rng(9)
    scores = [None if x > 1.5 else math.nan if x < -2 else float(x) for x in rng.standard_normal(300)]
    for at, got in enumerate(expanding_medians(scores, least=10)):
        known = sorted((x for x in scores[:at] if x is not None), key=lambda x: (x != x, x))
        want = None if len(known) < 10 else 0.5 * known[(len(known) - 1) // 2] + 0.5 * known[len(known) // 2]
        assert got == want or got == pytest.approx(want, nan_ok=True)


@pytest.mark.parametrize(("words", "end", "plain"), [("ADVERSE", False, "ADVERSE_RE"), ("CAUSAL", True, "CAUSAL_RE")])
def test_words_grouped_by_letter_match_the_same(words, end, plain):
    import random
    import re

    from marketloom.queries import market

    grouped, rng = re.compile(market._whole_words(getattr(market, words), end=end)), random.Random(2)
    parts = [*getattr(market, words).split("|"), "x", " ", "_", "\n", "é", ".", "de", "con", "s", "because", "9"]
    found = 0
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(5)))
        want = re.search(getattr(market, plain), text) is not None
        found += want
        assert (grouped.search(text) is not None) == want
    assert 500 < found < 4500


def test_a_fit_of_lambda_takes_one_loss_a_round(monkeypatch):
    from marketloom.models import fits

    calls, real = [], fits.yeo_johnson
    monkeypatch.setattr(fits, "yeo_johnson", lambda x, lam: calls.append(lam) or real(x, lam))
    fits.fit_lambda(np.random.default_rng(3).standard_normal(200))
    assert len(calls) <= 42


def test_variances_run_over_plain_numbers():
    from time import perf_counter

    from marketloom.models import fits

    def by_items(r, omega, alpha, beta):
        out = np.empty(len(r) + 1)
        out[0] = r.var() + 1e-12
        for i, x in enumerate(r):
            out[i + 1] = omega + alpha * x * x + beta * out[i]
        return out

    r, took = np.random.default_rng(4).standard_normal(5000), {}
    for f in (by_items, fits.garch_variances):
        times = []
        for _ in range(5):
            begin = perf_counter()
            f(r, 0.1, 0.1, 0.8)
            times.append(perf_counter() - begin)
        took[f.__name__] = min(times)
    assert np.array_equal(by_items(r, 0.1, 0.1, 0.8), fits.garch_variances(r, 0.1, 0.1, 0.8))
    assert took["garch_variances"] < 0.75 * took["by_items"]


def test_the_lab_keeps_no_tests_but_the_best_without_q(spark, monkeypatch):
    from marketloom.operators import pair_lab as lab

    rng = np.random.default_rng(12)
    base = 100 + rng.standard_normal(60).cumsum()
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=j), float(base[j] * (1 + k / 10) + rng.standard_normal())) for k in range(6) for j in range(60)]
    df = spark.createDataFrame(rows, "ticker int, d date, x double")
    kept, real = [], lab.cut_lineage
    monkeypatch.setattr(lab, "cut_lineage", lambda x: kept.append(real(x)) or kept[-1])
    sizes = {"formation": 40, "least": 30, "windows": 2, "deep": 3}
    with_q = lab.pair_lab(df, **sizes)
    assert kept[0].count() == 15 and "q" in with_q.columns
    kept.clear()
    without = lab.pair_lab(df, q=False, **sizes)
    assert len(kept) == 1 and kept[0].count() <= 3 and without.collect() == with_q.drop("q").collect()


@pytest.mark.parametrize("sizes", [[120], [100, 137, 137, 300, 131]])
def test_series_are_fitted_together_to_the_digits_of_one(sizes):
    from marketloom.models import arima_garch as ag

    rng = np.random.default_rng(14)
    rs = sorted((rng.standard_t(5, n) / 50 for n in sizes), key=len)
    armas = [ag.fit_arma(r) for r in rs]
    assert ag.fit_armas(rs) == armas
    errors = [ag.arma_errors(r, *p) * 100 for r, p in zip(rs, armas, strict=True)]
    assert ag.fit_garches_t(errors) == [ag.fit_garch_t(e) for e in errors]


def test_forecasts_of_symbols_share_their_fits(spark):
    """One fit for a batch, dealt to a number of shares that small partitions don't lower; rows don't depend on the batch."""
    from marketloom.models import arima_garch as ag

    rng = np.random.default_rng(15)
    closes = [100 * np.exp(rng.standard_t(5, 100 + k % 3).cumsum() / 50) for k in range(5)]
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=j), float(x)) for k, c in enumerate(closes) for j, x in enumerate(c)]
    made = ag.arima_garch_forecast(spark.createDataFrame(rows, "symbol int, d date, close double"), days=2, paths=50)
    plan = plan_of(made)
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "RepartitionByExpression [symbol#" in plan
    got = {r.symbol: (r.ar, r.ma, r.omega, r.freedom) for r in made.collect() if r.day == 2}
    for k, c in enumerate(closes):
        arma = ag.fit_arma(np.diff(np.log(c)))
        garch = ag.fit_garch_t(ag.arma_errors(np.diff(np.log(c)), *arma) * 100)
        assert got[k] == (*arma[1:], garch[0], garch[3])


def test_regressions_don_t_pass_over_their_windows(spark):
    """No sliding frame of an aggregate is left; fits are those of NumPy, with missing, equal and unknown prices."""
    from marketloom.queries import backtest as bt

    rng = np.random.default_rng(16)
    prices = {"whole": 100 * np.exp(rng.standard_normal(300).cumsum() / 50), "flat": np.full(260, 7.3), "gaps": 100 * np.exp(rng.standard_normal(280) / 9), "nan": 100 * np.exp(rng.standard_normal(90) / 9)}
    prices["flat"][5], prices["nan"][40] = 9.0, math.nan
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=k), None if s == "gaps" and k % 4 == 1 else float(x), k + 1) for s, v in prices.items() for k, x in enumerate(v)]
    made = bt.all_regressions(spark.createDataFrame(rows, "symbol string, d date, price double, t int"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "regr_" not in plan and "RowFrame, -20" not in plan and "lag(" in plan
    got = {(r.symbol, r.t, r.lookback): r for r in made.collect()}
    assert len(got) == 4 * len(rows)
    for (symbol, t, n), r in got.items():
        if t < n:
            assert (r.slope, r.r2) == (None, None)
            continue
        y = np.log(prices[symbol][t - n : t])
        x = np.arange(n)[[not (symbol == "gaps" and (t - n + k) % 4 == 1) for k in range(n)]]
        y = y[x]
        if np.isnan(y).any():
            assert math.isnan(r.slope) and math.isnan(r.r2)
        elif np.ptp(y) == 0:
            assert (r.slope, r.r2) == (0.0, 1.0)
        else:
            assert r.slope == pytest.approx(np.polyfit(x, y, 1)[0], rel=1e-6, abs=1e-12) and r.r2 == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2, rel=1e-6, abs=1e-12)


@pytest.mark.parametrize("kind", ["noise", "walks", "alike"])
def test_tiles_equal_plain_statistics(kind):
    """Products of matrices give the statistics of the spreads themselves; a pair they can't tell is unsure."""
    from marketloom.operators.pair_tiles import Tile

    rng = np.random.default_rng(7)
    x = rng.standard_normal((30, 120)) if kind == "noise" else rng.standard_normal((30, 120)).cumsum(axis=1) + 1000
    if kind == "alike":
        x = 50 + rng.standard_normal(120).cumsum() * (1 + rng.random((30, 1))) + 2 * rng.standard_normal((30, 120))
        x[3], x[4], x[6] = 5.0, x[5], 3 * x[7] + 2
    wanted = frozenset(pair_blocks.NUMBERS) | {"first_entry"}
    with np.errstate(all="ignore"):
        for names in (wanted, wanted - {"kss_t"}):
            tile = Tile(x, x, 20, names)
            pairs = np.arange(30)[:, None] < np.arange(30)
            tile.first_entries(pairs, 20)
            i, j = np.nonzero(pairs & ~tile.unsure)
            plain, _, first = pair_blocks.statistics(x[i], x[j], 20)
            assert (tile.numbers["first_entry"][i, j] == first).all()
            for n in set(tile.numbers) - {"first_entry"}:
                np.testing.assert_allclose(tile.numbers[n][i, j], plain[n], rtol=1e-8, atol=1e-9)
            assert len(i) == 435 if kind != "alike" else 435 > len(i) > 100 and tile.unsure[3, 4] and tile.unsure[4, 5] and tile.unsure[6, 7]


def test_only_dates_that_count_travel(spark):
    """Series that have all newest dates travel without older ones; one that lacks a date brings them back, with the same pairs of the others."""
    rng = np.random.default_rng(8)
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=j), float(v)) for k in range(6) for j, v in enumerate(rng.standard_normal(40 + k))]
    rows = [(k, d + dt.timedelta(days=5 - k), v) for k, d, v in rows]
    rows += [(9, d, v) for k, d, v in rows[:20]]  # too short for any pair
    whole = pair_blocks.pair_statistics(spark.createDataFrame(rows, "ticker int, d date, x double"), formation=30, window=5)
    assert "slice(x" in plan_of(whole)
    got = {(r.a, r.b): r for r in whole.collect()}
    assert sorted(got) == [(a, b) for a in range(6) for b in range(a + 1, 6)]
    lacking = [r for r in rows if r[0] != 5 or r[1] != dt.date(2024, 2, 1)]
    cut = pair_blocks.pair_statistics(spark.createDataFrame(lacking, "ticker int, d date, x double"), formation=30, window=5)
    assert "slice(x" not in plan_of(cut)
    again = {(r.a, r.b): r for r in cut.collect()}
    assert sorted(again) == sorted(got) and all(again[k] == got[k] for k in got if 5 not in k)
    x = {k: np.array([r[2] for r in lacking if r[0] == k]) for k in (0, 5)}
    days = {k: [r[1] for r in lacking if r[0] == k] for k in (0, 5)}
    common = sorted(set(days[0]) & set(days[5]))[-30:]
    a, b = (x[k][[d in common for d in days[k]]] for k in (0, 5))
    assert again[0, 5].beta == pytest.approx(np.polyfit(b, a, 1)[0])


def test_p_is_worked_out_once_below_a_filter(spark):
    from marketloom.functions.numeric import with_engle_granger_p

    df = with_engle_granger_p(spark.range(3).selectExpr("id - 3.5 AS t"), "t").where("p <= 0.5 AND p >= 0")
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("exp(") == 2
    assert df.columns == ["t", "p"] and df.count() == 2


def test_the_top_of_all_thresholds_is_the_top_of_the_widest(spark, monkeypatch):
    """No row a cut, and no sort of all pairs; pairs over the widest cut stay out."""
    from marketloom.queries import pairs

    t = {(1, b): -4.0 + b * 0.01 for b in range(2, 302)}
    df = spark.createDataFrame([(a, b, x) for (a, b), x in t.items()], "a long, b long, adf_t double")
    monkeypatch.setattr(pairs, "screened", lambda *_: df)
    top = pairs.topn_union(spark, "")
    assert "Window" not in plan_of(top) and "Explode" not in plan_of(top) and "Generate explode" not in plan_of(top)
    p = sorted((r.p, r.a, r.b) for r in pairs.engle_granger(spark, "").collect() if r.p <= 0.5)
    assert {(r.a, r.b) for r in top.collect()} == {(a, b) for _, a, b in p[:200]} and 100 < len(p)


@pytest.mark.parametrize("kind", ["uniform", "mixed", "tiny", "ties"])
def test_rounded_q_of_buckets_equals_plain_q(spark, monkeypatch, kind):
    """Buckets decide what they can; only the tests of the others are kept, and every q is the rounded plain one."""
    from marketloom.operators import fdr

    rng = np.random.default_rng(9)
    u = rng.random(3000)
    p = {"uniform": u, "mixed": np.where(u < 0.8, u * 1e-9, u), "tiny": u * 1e-12, "ties": np.round(u, 2)}[kind].tolist()
    df = spark.createDataFrame(list(enumerate([*p, None, float("nan"), 0.0, 1.0])), "k int, p double")
    kept, real = [], fdr.cut_lineage
    monkeypatch.setattr(fdr, "cut_lineage", lambda x: kept.append(real(x)) or kept[-1])
    got = {r.k: r.q for r in fdr.rounded_benjamini_hochberg(df, "p", 6).collect()}
    assert sum(x.count() for x in kept) < {"uniform": 3003, "mixed": 900, "tiny": 2, "ties": 3003}[kind]
    p = [*p, None, None, 0.0, 1.0]
    known = np.sort([x for x in p if x is not None])
    raw = known * len(known) / np.searchsorted(known, known, "right")
    q = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1.0)
    want = {k: None if x is None else float(f"{q[np.searchsorted(known, x)]:.6f}") for k, x in enumerate(p)}
    assert got == want


def test_titles_are_not_sent_by_way_of_the_driver(spark, tmp_path):
    rows = [(k, f"<title>prices of the market on day {k}</title>") for k in range(40)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["title_near_copies"](spark, str(tmp_path))
    assert len(got.collect()) == 40 * 39 // 2
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_garch_of_series_together_equals_each(spark):
    """Closes of many symbols share their simplexes and give the bands of each by itself."""
    from marketloom.models import fits

    rng = np.random.default_rng(10)
    closes = {f"s{k}": 100 * np.exp(np.cumsum(0.02 * rng.standard_normal(40 + k % 5))) for k in range(12)} | {"short": np.ones(39)}
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(days=j), float(x)) for s, c in closes.items() for j, x in enumerate(c)]
    shocks = [fits.garch_mean(c)[-1] for s, c in closes.items() if s != "short"]
    np.testing.assert_allclose(fits.fit_garches(shocks), [fits.fit_garch(x) for x in shocks], rtol=1e-3, atol=1e-6)
    got = fits.garch_forecast(spark.createDataFrame(rows, "symbol string, ts timestamp, close double"), days=2, paths=50).collect()
    assert len(got) == 24 and {r.symbol for r in got} == set(closes) - {"short"}
    for r in got:
        plain = fits.garch_bands(r.symbol, closes[r.symbol], 2, 50)
        assert list(r)[2:] == pytest.approx(plain[plain.day == r.day].iloc[0].tolist()[2:], rel=1e-5)
