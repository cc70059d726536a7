"""ARIMA(1,1,1) of log closes with GARCH(1,1) variance and Student-t shocks, and simulated paths from it.

ARIMA(1,1,1) on log closes is ARMA(1,1) with a constant on log returns; it is fitted by least squares of its one-step errors.  GARCH with
standardised t shocks is fitted to these errors in percent by maximum likelihood.  Paths start from the last return, error and
variance, and are seeded by the symbol, its last day and close, so results repeat wherever a task runs.

Defined results: closes that are null, NaN, infinite or not positive are left out; of several closes of a day the last by value counts; a symbol uses its newest
``MOST`` closes; symbols with fewer than ``LEAST`` closes or constant ones give no row; an empty table gives an empty table.

Symbols are fitted a batch at a time, a day of all of them as one array (``fit_armas``, ``fit_garches_t``); ``fit_arma`` and
``fit_garch_t`` fit one series by itself to the same digits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import top_per_group
from .fits import QUANTILES, simplex, simplexes

LEAST, MOST = 100, 1300
#: Series fitted at once.
BATCH = 128
SESSIONS = 252
#: Bounds of the lag coefficients in simulations, of the persistence, and the least degrees of freedom (fixed values).
LAG_BOUND, PERSISTENCE, LEAST_FREEDOM = 0.98, 0.999, 2.05


def _bounded(x: float, most: float = 1.0) -> float:
    return most * math.tanh(x)


def _share(x: float) -> float:
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))


def arma_errors(r: np.ndarray, mean: float, ar: float, ma: float) -> np.ndarray:
    """One-step errors of an ARMA(1,1), the first taken from the mean."""
    drift = np.append(r[0] - mean, (r[1:] - mean) - ar * (r[:-1] - mean)).tolist()
    out, last = [], 0.0
    for x in drift:
        last = x - ma * last
        out.append(last)
    return np.array(out)


#: Where the fits start from; the surface of the first has a ridge at ar = -ma.
ARMA_STARTS = ((0.0, 0.0, 0.0), (0.0, 0.8, -0.5), (0.0, -0.8, 0.5))
GARCH_STARTS = ((0.0, 2.5, -2.0, 1.8), (0.0, 0.0, 0.0, 1.8))
ARMA_ROUNDS, GARCH_ROUNDS = 120, 250


def each(f, x: np.ndarray) -> np.ndarray:
    """A function of one number, of all numbers of an array."""
    return np.array([f(v) for v in x.tolist()])


def beside(series: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Series as the columns of a matrix, zeros below the shorter ones; and their lengths."""
    sizes = np.array([len(x) for x in series])
    out = np.zeros((sizes.max(), len(series)))
    for k, x in enumerate(series):
        out[: len(x), k] = x
    return out, sizes


def totals(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each column's first ``sizes`` numbers, added in the order in which the sum of one series is; ``sizes`` ascends."""
    rows, out = np.ascontiguousarray(x.T), np.empty(len(sizes))
    edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = rows[a:b, : sizes[a]].sum(axis=1)
    return out


def fit_all(loss, count: int, starts: tuple[tuple[float, ...], ...], rounds: int) -> np.ndarray:
    """The best point of each of ``count`` functions over all starts, the earlier of equals; ``loss(points, which)``."""
    n = len(starts)
    points, values = simplexes(lambda p, which: loss(p, which // n), np.tile(np.array(starts), (count, 1)), rounds)
    points, values = points.reshape(count, n, -1), values.reshape(count, n)
    at = np.zeros(count, dtype=int)
    for k in range(1, n):
        at = np.where(values[:, k] < values[np.arange(count), at], k, at)
    return points[np.arange(count), at]


def fit_armas(series: Sequence[np.ndarray]) -> list[tuple[float, float, float]]:
    """``fit_arma`` of each series; the lengths ascend."""
    r, sizes = beside(series)
    centre, scale = np.array([x.mean() for x in series]), np.array([x.std() for x in series])

    def unpack(p: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return centre[which] + scale[which] * p[:, 0], 0.999 * each(math.tanh, p[:, 1]), 0.999 * each(math.tanh, p[:, 2])

    def loss(p: np.ndarray, which: np.ndarray) -> np.ndarray:
        mean, ar, ma = unpack(p, which)
        off = np.take(r, which, axis=1)
        off -= mean
        e = off.copy()
        e[1:] -= ar * off[:-1]
        step = np.empty_like(mean)
        for last, now in zip(e[:-1], e[1:], strict=True):
            np.multiply(ma, last, out=step)
            now -= step
        return np.log(totals(e[1:] ** 2, sizes[which] - 1))

    every = np.arange(len(series))
    return list(zip(*(x.tolist() for x in unpack(fit_all(loss, len(series), ARMA_STARTS, ARMA_ROUNDS), every)), strict=True))


def fit_arma(r: np.ndarray) -> tuple[float, float, float]:
    """(mean, ar, ma), stationary and invertible."""
    centre, scale = float(r.mean()), float(r.std())

    def unpack(p: np.ndarray) -> tuple[float, float, float]:
        return centre + scale * float(p[0]), _bounded(float(p[1]), 0.999), _bounded(float(p[2]), 0.999)

    loss = lambda p: float(np.log((arma_errors(r, *unpack(p))[1:] ** 2).sum()))
    return unpack(min((simplex(loss, np.array(s), ARMA_ROUNDS) for s in ARMA_STARTS), key=loss))


def variances(e: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    out, v = [], float(e.var()) + 1e-12
    for x in (alpha * e * e + omega).tolist():
        out.append(v)
        v = x + beta * v
    return np.array(out)


def t_log_likelihood(e: np.ndarray, v: np.ndarray, freedom: float) -> float:
    """Of errors with variances v under a t of that variance."""
    constant = math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2) - 0.5 * math.log(math.pi * (freedom - 2))
    return float((constant - 0.5 * np.log(v) - (freedom + 1) / 2 * np.log1p(e * e / ((freedom - 2) * v))).sum())


def fit_garch_t(e: np.ndarray) -> tuple[float, float, float, float]:
    """(omega, alpha, beta, degrees of freedom); persistence below ``PERSISTENCE``."""
    scale = float(e.var()) + 1e-12

    def unpack(p: np.ndarray) -> tuple[float, float, float, float]:
        p = np.clip(p, -30, 30)
        persistence, share = PERSISTENCE * _share(p[1]), _share(p[2])
        return scale * math.exp(p[0]) * (1 - persistence), persistence * share, persistence * (1 - share), LEAST_FREEDOM + math.exp(min(p[3], 6.0))

    def loss(p: np.ndarray) -> float:
        omega, alpha, beta, freedom = unpack(p)
        return -t_log_likelihood(e, variances(e, omega, alpha, beta), freedom)

    return unpack(min((simplex(loss, np.array(s), GARCH_ROUNDS) for s in GARCH_STARTS), key=loss))


def fit_garches_t(series: Sequence[np.ndarray]) -> list[tuple[float, float, float, float]]:
    """``fit_garch_t`` of each series of errors; the lengths ascend."""
    e, sizes = beside(series)
    first = np.array([float(x.var()) + 1e-12 for x in series])

    def unpack(p: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p = np.clip(p, -30, 30)
        persistence, share = PERSISTENCE * (1 / (1 + each(math.exp, -p[:, 1]))), 1 / (1 + each(math.exp, -p[:, 2]))
        freedom = LEAST_FREEDOM + each(math.exp, np.minimum(p[:, 3], 6.0))
        return first[which] * each(math.exp, p[:, 0]) * (1 - persistence), persistence * share, persistence * (1 - share), freedom

    def loss(p: np.ndarray, which: np.ndarray) -> np.ndarray:
        omega, alpha, beta, freedom = unpack(p, which)
        x = np.take(e, which, axis=1)
        v = np.empty_like(x)  # in place from here on, as memory is dear to get
        v[0], shocks = first[which], v[1:]
        np.multiply(alpha, x[:-1], out=shocks)
        shocks *= x[:-1]
        shocks += omega
        step = np.empty_like(beta)
        for last, now in zip(v[:-1], v[1:], strict=True):
            np.multiply(beta, last, out=step)
            now += step
        constant = each(lambda f: math.lgamma((f + 1) / 2) - math.lgamma(f / 2) - 0.5 * math.log(math.pi * (f - 2)), freedom)
        x *= x
        x /= (freedom - 2) * v
        np.log1p(x, out=x)
        x *= (freedom + 1) / 2
        np.log(v, out=v)
        v *= 0.5
        np.subtract(constant, v, out=v)
        v -= x
        return -totals(v, sizes[which])

    every = np.arange(len(series))
    return list(zip(*(x.tolist() for x in unpack(fit_all(loss, len(series), GARCH_STARTS, GARCH_ROUNDS), every)), strict=True))


def simulate(r: np.ndarray, arma: tuple[float, float, float], garch: tuple[float, float, float, float], days: int, paths: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(cumulative log returns by day and path, mean variance by day in percent squared)."""
    mean, ar, ma = arma[0], *(max(-LAG_BOUND, min(LAG_BOUND, x)) for x in arma[1:])
    omega, alpha, beta, freedom = garch
    e = arma_errors(r, *arma) * 100
    rng = np.random.default_rng(seed)
    v, error, last = np.full(paths, variances(e, omega, alpha, beta)[-1]), np.full(paths, e[-1]), np.full(paths, r[-1])
    total, out, spread = np.zeros(paths), [], []
    for _ in range(days):
        v = np.maximum(omega + alpha * error**2 + beta * v, 1e-10)
        shock = np.sqrt(v) * rng.standard_t(freedom, paths) * math.sqrt((freedom - 2) / freedom)
        last = mean + ar * (last - mean) + ma * error / 100 + shock / 100
        error, total = shock, total + last
        out.append(total)
        spread.append(v.mean())
    return np.array(out), np.array(spread)


NAMES = [f"q{int(q * 100):02d}" for q in QUANTILES]
COLUMNS = {"day": pa.int32(), "last_price": pa.float64()} | dict.fromkeys([*NAMES, "p_above", "volatility", "drift", "ar", "ma", "omega", "alpha", "beta", "freedom", "long_run_volatility"], pa.float64()) | {"closes": pa.int32()}


def forecast(symbol: str, day: object, close: np.ndarray, arma: tuple[float, float, float], garch: tuple[float, float, float, float], days: int, paths: int) -> list[dict]:
    r = np.diff(np.log(close))
    omega, alpha, beta, freedom = garch
    seed = int.from_bytes(hashlib.sha256(f"{symbol}|{day}|{close[-1]:.8f}|{days}|{paths}".encode()).digest()[:8], "big")
    steps, spread = simulate(r, arma, garch, days, paths, seed)
    price = close[-1] * np.exp(np.clip(steps, -50, 50))
    year = math.sqrt(SESSIONS)
    fixed = {"last_price": close[-1], "drift": arma[0] * SESSIONS * 100, "ar": arma[1], "ma": arma[2], "omega": omega, "alpha": alpha, "beta": beta, "freedom": freedom}
    fixed |= {"long_run_volatility": math.sqrt(omega / max(1 - alpha - beta, 1e-6)) * year, "closes": len(close)}
    return [
        {"day": k + 1, **dict(zip(NAMES, np.quantile(price[k], QUANTILES).tolist(), strict=True)), "p_above": float((price[k] >= close[-1]).mean()), "volatility": math.sqrt(spread[k]) * year, **fixed}
        for k in range(days)
    ]


def forecasts(symbols: pa.Array, last: list, closes: list[np.ndarray], days: int, paths: int) -> Iterator[tuple[pa.Scalar, dict]]:
    """The rows of each symbol, ``BATCH`` symbols fitted at once; shortest series first, so those of a batch are of like lengths."""
    returns = [np.diff(np.log(x)) for x in closes]
    order = sorted((k for k, r in enumerate(returns) if r.std() > 1e-8), key=lambda k: len(returns[k]))
    for at in range(0, len(order), BATCH):
        some = order[at : at + BATCH]
        armas = fit_armas([returns[k] for k in some])
        garches = fit_garches_t([arma_errors(returns[k], *arma) * 100 for k, arma in zip(some, armas, strict=True)])
        for k, arma, garch in zip(some, armas, garches, strict=True):
            for row in forecast(str(symbols[k].as_py()), last[k], closes[k], arma, garch, days, paths):
                yield symbols[k], row


def arima_garch_forecast(closes: DataFrame, *, days: int = 10, paths: int = 1000) -> DataFrame:
    """``days`` rows for each symbol of closes (symbol, d, close): quantiles of simulated closes, P(above), volatility and the parameters."""
    x = F.col("close")
    good = closes.where((x > 0) & ~F.isnan(x) & (x < float("inf")) & F.col("symbol").isNotNull() & F.col("d").isNotNull())
    each_day = good.groupBy("symbol", F.to_date("d").alias("d")).agg(F.max("close").alias("close"))
    newest = top_per_group(each_day, ["symbol"], [F.desc("d")], MOST).select("symbol", F.struct("d", F.col("close").cast("double").alias("close")).alias("v"))  # what a row holds is bounded
    series = newest.groupBy("symbol").agg(F.sort_array(F.collect_list("v")).alias("v")).where(F.size("v") >= LEAST)
    series = series.select("symbol", F.element_at("v.d", -1).alias("d"), F.col("v.close").alias("close"))
    # the work is in the fits, not in the bytes by which partitions would be merged: two shares a core
    dealt = series.repartition(2 * closes.sparkSession.sparkContext.defaultParallelism, "symbol")
    kind = closes.schema["symbol"].dataType.simpleString()

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            symbols = rows.column("symbol")
            made = list(forecasts(symbols, rows.column("d").to_pylist(), [x.values.to_numpy() for x in rows.column("close")], days, paths))
            names = pa.array([name.as_py() for name, _ in made], symbols.type)
            yield pa.RecordBatch.from_pydict({"symbol": names} | {n: pa.array([m[n] for _, m in made], t) for n, t in COLUMNS.items()})

    ddl = ", ".join(f"{n} {'int' if t == pa.int32() else 'double'}" for n, t in COLUMNS.items())
    return dealt.mapInArrow(fit, f"symbol {kind}, {ddl}")
