"""Direct-horizon regressions against least squares in NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from marketloom.queries.horizons import horizon_regressions

SCHEMA = "symbol string, d int, high double, low double, close double, volume double"


def candles(symbol, n, seed):
    rng = np.random.default_rng(seed)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
    return [(symbol, i, float(c * 1.01), float(c * 0.98), float(c), float(v)) for i, (c, v) in enumerate(zip(close, rng.integers(0, 900, n), strict=True))]


def twin(rows, h):
    high, low, close, volume = (np.array([r[k] for r in rows]) for k in (2, 3, 4, 5))
    typical, n = (high + low + close) / 3, len(rows)
    x = []
    for i in range(20, n):
        v = volume[i - 19 : i + 1]
        x.append([np.log(close[i] / close[i - 1]), np.log(max(volume[i], 1) / max(v.mean(), 1)), np.log(close[i] / ((typical[i - 19 : i + 1] @ v) / v.sum()))])
    x = np.column_stack([np.ones(n - 20), np.array(x)])
    y = np.log(close[20 + h :] / close[20 : n - h])
    fit = lambda a, b: np.linalg.lstsq(a, b, rcond=None)[0]
    ahead = float(np.clip(x[-1] @ fit(x[: len(y)], y), -0.5, 0.5))
    split = max(40, len(y) * 4 // 5)
    if split - h < 40 or len(y) - split < 10:
        return len(y), ahead, None, None
    p = x[split : len(y)] @ fit(x[: split - h], y[: split - h])
    t = y[split:]
    return len(y), ahead, 1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum(), np.abs(np.exp(p) - np.exp(t)).mean() * 100


def test_equals_least_squares_in_numpy(spark):
    series = {"A": candles("A", 150, 1), "B": candles("B", 101, 2), "short": candles("short", 99, 3)}
    flat = [("flat", i, 1.0, 1.0, 1.0, 5.0) for i in range(150)]
    noise = [("A", 900, None, 1.0, 1.0, 1.0), ("A", 901, 1.0, 1.0, -1.0, 1.0), ("A", 902, 1.0, 1.0, float("nan"), 1.0)]
    df = spark.createDataFrame([*sum(series.values(), []), *flat, *noise], SCHEMA)
    got = {(r.symbol, r.h): r for r in horizon_regressions(df).collect()}
    assert set(got) == {(s, h) for s in "AB" for h in range(1, 6)}
    for (s, h), r in got.items():
        rows, ahead, r2, mae = twin(series[s], h)
        assert r.rows == rows and r.predicted == pytest.approx(ahead, abs=1e-9)
        assert r.price == pytest.approx(series[s][-1][4] * np.exp(ahead))
        assert (r.r2, r.mae) == ((None, None) if r2 is None else (pytest.approx(r2, abs=1e-8), pytest.approx(mae, abs=1e-8)))


def test_no_candles_no_rows(spark):
    assert horizon_regressions(spark.createDataFrame([], SCHEMA)).collect() == []
