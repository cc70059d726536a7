from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from marketloom.models import arima_garch as ag
from marketloom.models import surfaces as sf

DAY = dt.date(2024, 1, 1)


def waves(n, sizes, noise, seed):
    """Surfaces whose scores swing, each component at its own speed."""
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(sf.CELLS, 8)))[0].T
    t = np.arange(n)
    scores = np.stack([s * np.sin(2 * np.pi * t / p + k) for k, (s, p) in enumerate(sizes)], axis=1)
    return 30 + scores @ basis[: len(sizes)] + rng.normal(0, noise, (n, sf.CELLS))


THREE, FOUR = [(20, 9.0), (14, 5.3), (9, 3.7)], [(20, 9.0), (14, 5.3), (9, 3.7), (8, 2.9)]


def plain_next(history, k):
    """Components from the covariance, the autoregression by its normal equations."""
    middle = history.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov((history - middle).T, bias=True))
    basis = vectors[:, np.argsort(values)[::-1][:k]]
    scores = (history - middle) @ basis
    change = scores[1:] - scores[:-1]
    x = np.array([[1.0, *(v for lag in range(1, 6) for v in change[i - lag])] for i in range(5, len(change))])
    y = change[5:]
    weights = np.linalg.pinv(x) @ y
    ahead = np.array([1.0, *(v for lag in range(1, 6) for v in change[len(change) - lag])]) @ weights
    return np.clip(middle + basis @ (scores[-1] + ahead), 1, 250)


def plain_smooth(values):
    i, j = np.meshgrid(np.arange(4.0), np.arange(5.0), indexing="ij")
    x = np.column_stack([i.ravel() ** a * j.ravel() ** b for a in range(3) for b in range(3)])
    fit = x @ np.linalg.lstsq(x, values, rcond=None)[0]
    rss = ((values - fit) ** 2).sum()
    back = 1 - np.sqrt(40 / rss) if rss > 40 else 0.0
    return np.clip(fit + back * (values - fit), 1, 250), rss


def test_smoothing_equals_least_squares_and_keeps_the_budget(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (30 + rng.normal(0, 0.3 if k % 2 else 6, sf.CELLS)).tolist()) for k in range(12)]
    rows += [(50, [1000.0] * 20), (51, [0.1] * 20), (90, None), (91, [1.0] * 19), (92, [None] + [1.0] * 19), (93, [float("nan")] * 20)]
    got = {r.k: r for r in sf.smooth(spark.createDataFrame(rows, "k int, values array<double>")).collect()}
    assert set(got) == {*range(12), 50, 51}
    kept = 0
    for k, v in rows[:14]:
        want, rss = plain_smooth(np.array(v))
        assert got[k].smoothed == pytest.approx(want.tolist()) and got[k].rss == pytest.approx(rss, abs=1e-6)
        if rss > 40 and k < 12:
            assert ((np.array(v) - np.array(got[k].smoothed)) ** 2).sum() == pytest.approx(40)
            kept += 1
    assert 0 < kept < 12


def test_next_surface_equals_a_plain_fit():
    for seed, sizes in ((1, THREE), (2, FOUR)):
        history = waves(50, sizes, 0.4, seed)
        for k in (3, 4):
            ahead, explained, rebuilt = sf.next_surface(history, k)
            assert ahead == pytest.approx(plain_next(history, k), rel=1e-6)
            assert 0 < explained <= 100 and rebuilt >= 0


def test_validation_looks_at_the_past_alone():
    history = waves(48, FOUR, 0.3, 3)
    errors, naive, direction = sf.one_step_errors(history, 3)
    assert len(errors) == len(naive) == 10 and 0 <= direction <= 1
    for i, t in enumerate(range(38, 48)):
        assert errors[i] == pytest.approx(history[t] - plain_next(history[:t], 3), rel=1e-5, abs=1e-6)
        assert naive[i] == pytest.approx(history[t] - history[t - 1])
    changed = history.copy()
    changed[-1] += 100
    assert sf.one_step_errors(changed, 3)[0][:-1] == pytest.approx(errors[:-1])
    assert len(sf.one_step_errors(history[:38], 3)[0]) == 3  # from the 36th on


def test_a_fourth_component_must_earn_its_place(spark):
    assert sf.chosen_components(1.0, 0.95) == (4, pytest.approx(5)) and sf.chosen_components(1.0, 0.96)[0] == 3 and sf.chosen_components(0.0, 0.0) == (3, 0.0)
    rows = []
    for name, sizes, seed, n in (("three", THREE, 1, 60), ("four", FOUR, 2, 60), ("short", THREE, 3, 35), ("least", THREE, 4, 36)):
        rows += [(name, DAY + dt.timedelta(days=i), v.tolist()) for i, v in enumerate(waves(n, sizes, 0.25, seed))]
    rows += [("flat", DAY + dt.timedelta(days=i), [20.0] * 20) for i in range(50)] + [(None, DAY, [20.0] * 20), ("three", None, [20.0] * 20), ("four", DAY, [1.0] * 20)]
    df = spark.createDataFrame(rows, "symbol string, d date, values array<double>")
    got = {r.symbol: r for r in sf.surface_forecast(df).collect()}
    assert set(got) == {"three", "four", "least"}
    assert (got["three"].components, got["four"].components) == (3, 4)
    assert got["four"].fourth_saves_percent >= 5 > got["three"].fourth_saves_percent
    for name, sizes, seed in (("three", THREE, 1), ("four", FOUR, 2)):
        r = got[name]
        smoothed = np.array([plain_smooth(v)[0] for v in waves(60, sizes, 0.25, seed)])[-50:]
        assert r.forecast == pytest.approx(plain_next(smoothed, r.components).tolist(), rel=1e-5)
        errors = np.array([smoothed[t] - plain_next(smoothed[:t], r.components) for t in range(40, 50)])
        assert r.cell_rmse == pytest.approx(np.sqrt((errors**2).mean(axis=0)).tolist(), rel=1e-4)
        assert r.improvement_percent == pytest.approx((r.baseline_rmse - np.sqrt((errors**2).mean())) / r.baseline_rmse * 100, rel=1e-4)
        assert (r.surfaces, r.sessions) == (50, 10)
    assert (got["least"].surfaces, got["least"].sessions) == (36, 1)
    assert sf.surface_forecast(df.limit(0)).collect() == []


def simulated(n, arma, garch, seed):
    rng = np.random.default_rng(seed)
    mean, ar, ma = arma
    omega, alpha, beta, freedom = garch
    v, e, r, out = omega / (1 - alpha - beta), 0.0, mean, []
    for _ in range(n + 200):
        v = omega + alpha * e * e + beta * v
        shock = np.sqrt(v) * rng.standard_t(freedom) * np.sqrt((freedom - 2) / freedom)
        r = mean + ar * (r - mean) + ma * e / 100 + shock / 100
        e = shock
        out.append(r)
    return np.array(out[200:])


def test_parameters_of_simulated_series_come_back():
    arma, garch = (0.0005, 0.5, -0.2), (0.1, 0.12, 0.8, 6.0)
    found = []
    for seed in range(3):
        r = simulated(4000, arma, garch, seed)
        fit = ag.fit_arma(r)
        found.append([*fit, *ag.fit_garch_t(ag.arma_errors(r, *fit) * 100)])
    mean, ar, ma, omega, alpha, beta, freedom = np.mean(found, axis=0)
    assert abs(mean - 0.0005) < 0.001 and abs(ar - 0.5) < 0.12 and abs(ma + 0.2) < 0.12
    assert abs(alpha - 0.12) < 0.04 and abs(beta - 0.8) < 0.07 and 4.5 < freedom < 8.5 and abs(omega / (1 - alpha - beta) - 1.25) < 0.5


def test_likelihood_and_errors_equal_plain_forms():
    rng = np.random.default_rng(4)
    r = rng.normal(0, 0.01, 50)
    e = [r[0] - 0.001]
    for t in range(1, 50):
        e.append(r[t] - 0.001 - 0.3 * (r[t - 1] - 0.001) - 0.2 * e[-1])
    assert ag.arma_errors(r, 0.001, 0.3, 0.2) == pytest.approx(e)
    x, dx = np.linspace(-300, 300, 600_001, retstep=True)
    density = np.exp([ag.t_log_likelihood(np.array([v]), np.array([2.0]), 5.0) for v in x[::100]])
    assert density.sum() * dx * 100 == pytest.approx(1, abs=1e-3) and (density * x[::100] ** 2).sum() * dx * 100 == pytest.approx(2, abs=0.05)


def test_forecast_rows(spark):
    close = 100 * np.exp(np.cumsum(simulated(300, (0.0, 0.1, 0.1), (0.05, 0.1, 0.8, 6.0), 9)))
    rows = [("X", DAY + dt.timedelta(days=i), float(c)) for i, c in enumerate(close)] + [("short", DAY + dt.timedelta(days=i), 5.0 + i % 3) for i in range(99)]
    rows += [("flat", DAY + dt.timedelta(days=i), 5.0) for i in range(200)] + [("X", DAY, -1.0), ("X", None, 2.0), ("X", DAY + dt.timedelta(days=900), float("nan")), (None, DAY, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, d date, close double")
    got = sorted(ag.arima_garch_forecast(df, days=5, paths=2000).collect(), key=lambda r: r.day)
    assert [(r.symbol, r.day, r.closes) for r in got] == [("X", k, 300) for k in range(1, 6)]
    for r in got:
        q = [r[n] for n in ag.NAMES]
        assert q == sorted(q) and 0.2 < r.p_above < 0.8 and r.alpha + r.beta < 0.999 and r.freedom >= 2.05 and r.last_price == pytest.approx(close[-1])
    assert got[0].q95 - got[0].q05 < got[-1].q95 - got[-1].q05
    assert sorted(ag.arima_garch_forecast(df.repartition(5), days=5, paths=2000).collect(), key=lambda r: r.day) == got  # seeded
    assert ag.arima_garch_forecast(df.limit(0)).collect() == []
