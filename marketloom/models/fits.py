"""Fits of one bounded series: ARMA-GARCH simulation, functional components with a vector autoregression, Yeo-Johnson.

These are helpers of the grouped functions below; a series is one symbol's window (tens to a few thousand points).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


def simplex(f, start: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Nelder-Mead minimisation of a small smooth function."""
    n = len(start)
    points = [start, *[start + 0.1 * (abs(start[i]) + 0.1) * np.eye(n)[i] for i in range(n)]]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        middle = np.mean(points[:-1], axis=0)
        mirrored = 2 * middle - points[-1]
        at = f(mirrored)
        if at < values[0]:
            far = 3 * middle - 2 * points[-1]
            value = f(far)
            points[-1], values[-1] = (far, value) if value < at else (mirrored, at)
        elif at < values[-2]:
            points[-1], values[-1] = mirrored, at
        else:
            near = 0.5 * (middle + points[-1])
            value = f(near)
            if value < values[-1]:
                points[-1], values[-1] = near, value
            else:
                points = [points[0], *[0.5 * (points[0] + p) for p in points[1:]]]
                values = [values[0], *[f(p) for p in points[1:]]]
    return points[int(np.argmin(values))]


def simplexes(f, starts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """``simplex`` from each row of ``starts``, all at once and step by step the same: (points, values).

    ``f(points, which)`` gives for each row of points the value of the function numbered as its start; ``which`` ascends.
    """
    m, n = starts.shape
    every = np.arange(m)
    points = np.stack([starts, *[starts + 0.1 * (np.abs(starts[:, i : i + 1]) + 0.1) * np.eye(n)[i] for i in range(n)]], axis=1)
    values = f(points.reshape(-1, n), np.repeat(every, n + 1)).reshape(m, n + 1)
    for _ in range(rounds):
        order = np.argsort(values, axis=1)
        points, values = np.take_along_axis(points, order[:, :, None], axis=1), np.take_along_axis(values, order, axis=1)
        worst = points[:, -1].copy()
        middle = sum((points[:, i] for i in range(1, n)), points[:, 0]) / n
        mirrored = 2 * middle - worst
        at = f(mirrored, every)
        best = at < values[:, 0]
        kept = ~best & (at < values[:, -2])
        again = np.flatnonzero(~kept)
        second, value = np.where(best[:, None], 3 * middle - 2 * worst, 0.5 * (middle + worst)), np.full(m, np.nan)
        if len(again):
            value[again] = f(second[again], again)
        better = ~kept & (value < np.where(best, at, values[:, -1]))
        kept |= best & ~better
        points[:, -1] = np.where(better[:, None], second, np.where(kept[:, None], mirrored, worst))
        values[:, -1] = np.where(better, value, np.where(kept, at, values[:, -1]))
        shrunk = np.flatnonzero(~better & ~kept)
        points[shrunk, 1:] = 0.5 * (points[shrunk, :1] + points[shrunk, 1:])
        if len(shrunk):
            values[shrunk, 1:] = f(points[shrunk, 1:].reshape(-1, n), np.repeat(shrunk, n)).reshape(-1, n)
    least = values.argmin(axis=1)
    return points[every, least], values[every, least]


def garch_variances(r: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    out = [float(r.var()) + 1e-12]
    for x in (omega + alpha * r * r).tolist():  # plain floats: a recursion over an array's items is several times slower
        out.append(x + beta * out[-1])
    return np.array(out)


def fit_garch(r: np.ndarray) -> tuple[float, float, float]:
    """Quasi-likelihood GARCH(1,1) of demeaned returns; persistence below one by construction."""
    scale = r.var() + 1e-12

    def unpack(p: np.ndarray) -> tuple[float, float, float]:
        share, persistence = 1 / (1 + math.exp(-p[0])), 0.999 / (1 + math.exp(-p[1]))
        return scale * (1 - persistence), persistence * share, persistence * (1 - share)

    def loss(p: np.ndarray) -> float:
        v = garch_variances(r, *unpack(np.clip(p, -30, 30)))[:-1]
        return float((np.log(v) + r * r / v).sum())

    return unpack(np.clip(simplex(loss, np.array([-1.5, 2.0])), -30, 30))


def garch_mean(close: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(returns, demeaned ones, their AR(1) slope, what it leaves) of closes."""
    r = np.diff(np.log(close))
    lag, now = r[:-1] - r.mean(), r[1:] - r.mean()
    phi = float(np.clip((lag @ now) / max(lag @ lag, 1e-12), -0.95, 0.95))
    return r, now, phi, now - phi * lag


def garch_bands(symbol: str, close: np.ndarray, days: int, paths: int, mean: tuple | None = None, fitted: tuple[float, float, float] | None = None) -> pd.DataFrame:
    """Quantile bands of simulated closes: AR(1) mean, GARCH(1,1) variance, resampled standardised shocks."""
    r, now, phi, shock = mean or garch_mean(close)
    omega, alpha, beta = fitted or fit_garch(shock)
    variance = garch_variances(shock, omega, alpha, beta)
    z = shock / np.sqrt(variance[:-1])
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(symbol.encode()).digest()[:8], "big"))
    v, last = np.full(paths, variance[-1]), np.full(paths, now[-1] if len(now) else 0.0)
    total, rows = np.zeros(paths), []
    for day in range(1, days + 1):
        e = np.sqrt(v) * rng.choice(z, paths)
        last = phi * last + e
        v = omega + alpha * e * e + beta * v
        total += r.mean() + last
        price = close[-1] * np.exp(total)
        rows.append([symbol, day, *np.quantile(price, QUANTILES), float((price > close[-1]).mean())])
    return pd.DataFrame(rows, columns=["symbol", "day", *[f"q{int(q * 100):02d}" for q in QUANTILES], "p_above"])


def fit_garches(shocks: list[np.ndarray]) -> list[tuple[float, float, float]]:
    """``fit_garch`` of each series, all simplexes at once; series run their variances beside each other, the shorter ones on past their end, which doesn't count."""
    sizes = np.array([len(x) for x in shocks])
    inside = np.arange(sizes.max())[:, None] < sizes  # a row a date
    squares = np.zeros(inside.shape)
    for k, x in enumerate(shocks):
        squares[: len(x), k] = x * x
    scale = np.array([x.var() + 1e-12 for x in shocks])

    def unpack(p: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = np.clip(p, -30, 30)
        share, persistence = 1 / (1 + np.exp(-p[:, 0])), 0.999 / (1 + np.exp(-p[:, 1]))
        return scale * (1 - persistence), persistence * share, persistence * (1 - share)

    def loss(p: np.ndarray, which: np.ndarray) -> np.ndarray:
        omega, alpha, beta = unpack(p, scale[which])
        r = squares[:, which]
        v = np.empty(r.shape)
        v[0] = scale[which]
        pushed = omega + alpha * r
        for t in range(1, len(v)):
            v[t] = pushed[t - 1] + beta * v[t - 1]
        return np.where(inside[:, which], np.log(v) + r / v, 0.0).sum(axis=0)

    points, _ = simplexes(loss, np.tile([-1.5, 2.0], (len(shocks), 1)))
    return list(zip(*(x.tolist() for x in unpack(points, scale)), strict=True))


#: Series and values that are fitted at once, and shares that symbols are dealt to.
TOGETHER, VALUES, SHARES = 256, 200_000, 64


def garch_forecast(series: DataFrame, *, days: int = 5, paths: int = 500, least: int = 40) -> DataFrame:
    """series: symbol, ts, close.  Seeded by the symbol, so results repeat."""
    schema = "symbol string, day int, " + ", ".join(f"q{int(q * 100):02d} double" for q in QUANTILES) + ", p_above double"
    closes = series.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", F.col("close").cast("double").alias("close")))).alias("v"))
    rows = closes.where(F.size("v") >= least).select("symbol", F.col("v.close").alias("close")).repartition(SHARES, "symbol")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch.close.map(len)
            batch, sizes = batch.loc[sizes.sort_values().index], sorted(sizes)  # lengths that meet are alike
            begin = 0
            while begin < len(batch):
                end = begin + 1
                while end < len(batch) and end - begin < TOGETHER and sizes[end] * (end - begin + 1) <= VALUES:
                    end += 1
                some, begin = batch.iloc[begin:end], end
                symbols, prices = [str(s) for s in some.symbol], [np.asarray(c, float) for c in some.close]
                means = [garch_mean(c) for c in prices]
                fits = fit_garches([shock for *_, shock in means])
                yield pd.concat([garch_bands(s, c, days, paths, mean, fitted) for s, c, mean, fitted in zip(symbols, prices, means, fits, strict=True)])

    return rows.mapInPandas(fit, schema)


def fpca_next(x: np.ndarray, components: int = 3, lags: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Next surface of a history (rows are days): principal components, a VAR on their differences; and the shares explained."""
    mean = x.mean(axis=0)
    _, s, basis = np.linalg.svd(x - mean, full_matrices=False)
    basis = basis[:components]
    scores = (x - mean) @ basis.T
    step = np.diff(scores, axis=0)
    past = np.hstack([step[lags - 1 - k : len(step) - 1 - k] for k in range(lags)])
    design = np.hstack([np.ones((len(past), 1)), past])
    ridge = design.T @ design + 1e-6 * np.eye(design.shape[1])
    coef = np.linalg.solve(ridge, design.T @ step[lags:])
    ahead = np.concatenate([[1.0], *[step[-1 - k] for k in range(lags)]]) @ coef
    return mean + (scores[-1] + ahead) @ basis, (s**2 / max((s**2).sum(), 1e-12))[:components]


def fpca_forecast(surfaces: DataFrame, *, components: int = 3) -> DataFrame:
    """surfaces: symbol, d, values (array).  One forecast row per symbol."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(rows.sort_values("d")["values"].to_list())
        if len(x) < 12:
            return pd.DataFrame(columns=["symbol", "forecast", "explained"])
        ahead, shares = fpca_next(x, components)
        return pd.DataFrame({"symbol": [str(rows.symbol.iloc[0])], "forecast": [ahead.tolist()], "explained": [float(shares.sum())]})

    return surfaces.groupBy("symbol").applyInPandas(fit, "symbol string, forecast array<double>, explained double")


def yeo_johnson(x: np.ndarray, lam: float) -> np.ndarray:
    up = x >= 0
    out = np.empty_like(x)
    out[up] = np.log1p(x[up]) if abs(lam) < 1e-9 else ((x[up] + 1) ** lam - 1) / lam
    other = 2 - lam
    out[~up] = -np.log1p(-x[~up]) if abs(other) < 1e-9 else -(((1 - x[~up]) ** other) - 1) / other
    return out


def fit_lambda(x: np.ndarray, low: float = -2.0, high: float = 4.0, rounds: int = 40) -> float:
    """Maximum likelihood by golden section."""

    jacobian = float((np.sign(x) * np.log1p(np.abs(x))).sum())

    def loss(lam: float) -> float:
        return len(x) / 2 * math.log(yeo_johnson(x, lam).var() + 1e-300) - (lam - 1) * jacobian

    g = (math.sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    at_a, at_b = loss(a), loss(b)
    for _ in range(rounds):  # one of the two places is kept, so one loss is new
        if at_a < at_b:
            high, b, a = b, a, b - g * (b - low)
            at_a, at_b = loss(a), at_a
        else:
            low, a, b = a, b, a + g * (high - a)
            at_a, at_b = at_b, loss(b)
    return (low + high) / 2


def tail_walk(x: np.ndarray, least: int = 504, refit: int = 21, most: int = 756) -> np.ndarray:
    """Walk-forward P(next > 0) under a normal fit of the transformed past; NaN before ``least`` rows."""
    out = np.full(len(x), np.nan)
    lam = 1.0
    for t in range(least, len(x)):
        past = x[max(0, t - most) : t]
        if (t - least) % refit == 0:
            lam = fit_lambda(past)
        y = yeo_johnson(past, lam)
        z = (yeo_johnson(np.zeros(1), lam)[0] - y.mean()) / max(y.std(ddof=1), 1e-12)
        out[t] = 0.5 * (1 - math.erf(z / math.sqrt(2)))
    return out


def yeo_johnson_walk(series: DataFrame) -> DataFrame:
    """series: symbol, d, x.  Rows before the least history are left out."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("d")
        p = tail_walk(rows.x.to_numpy(float))
        return pd.DataFrame({"symbol": rows.symbol.astype(str), "d": rows.d, "p": p})[~np.isnan(p)]

    return series.groupBy("symbol").applyInPandas(walk, "symbol string, d date, p double")
