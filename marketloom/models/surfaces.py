"""Volatility surfaces: smoothing by a quadratic with a residual budget, and forecasts by functional components with a VAR(5).

A surface is an array of ``ROWS`` tenors by ``COLUMNS`` buckets, row by row.  Smoothing stands in for a bivariate smoothing spline of
degree two: a least-squares quadratic in both directions (nine orthogonal terms, whose coefficients are moments of the
surface) is taken as it is if its squared residuals stay within the budget of two per cell; else it is moved back to the
surface until they do.  It is built-in functions only.

Forecasts run per symbol over its newest ``HISTORY`` surfaces.  Components are fitted to the history, a VAR(5) to the differences of their scores, and the
next surface follows.  Three components are kept unless a fourth lowers the error of one-step forecasts, each made
from the surfaces before it alone, by five percent or more.

Defined results: surfaces that are null, of another size, or hold a null or a value that is not finite are left out; of several surfaces of a day
the largest (as an array) counts; symbols with fewer than ``LEAST`` + 1 surfaces, or without variation in some window, give no row; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import top_per_group

ROWS, COLUMNS = 4, 5
BUDGET, LOWEST, HIGHEST = 2.0, 1.0, 250.0
LAGS, LEAST, HISTORY, TESTED = 5, 35, 50, 10
#: What a fourth component must save, in percent, and the move that counts for direction.
SAVING, MOVE = 5.0, 0.25
CELLS = ROWS * COLUMNS


def orthogonal(n: int) -> list[list[float]]:
    """The constant, linear and quadratic polynomial on n even places, orthogonal to each other."""
    x = [i - (n - 1) / 2 for i in range(n)]
    return [[1.0] * n, x, [v * v - (n * n - 1) / 12 for v in x]]


TERMS = [[p * q for p in a for q in b] for a in orthogonal(ROWS) for b in orthogonal(COLUMNS)]
NORMS = [sum(v * v for v in t) for t in TERMS]


def _numbers(values: list[float]) -> Column:
    return F.array(*map(F.lit, values))


def smooth(df: DataFrame, values: str = "values", into: str = "smoothed") -> DataFrame:
    """``df`` with the smoothed surface and, as ``rss``, the squared residuals of the quadratic; surfaces that can't be told are left out."""
    v = F.col(values)
    good = (F.size(v) == CELLS) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    moments = [total(F.zip_with(v, _numbers(t), lambda a, b: a * b)) / n for t, n in zip(TERMS, NORMS, strict=True)]
    out = df.where(good).withColumn("_c", F.array(*moments))
    at = lambda i: [F.get(_numbers(t), i) * F.get("_c", F.lit(k)) for k, t in enumerate(TERMS)]
    out = out.withColumn("_f", F.transform(v, lambda x, i: sum(at(i)[1:], at(i)[0])))
    out = out.withColumn("rss", total(F.zip_with(v, "_f", lambda a, b: (a - b) * (a - b))))
    budget = BUDGET * CELLS
    back = F.when(F.col("rss") > budget, 1 - F.sqrt(budget / F.col("rss"))).otherwise(0.0)
    out = out.withColumn("_b", back).withColumn(into, F.transform(F.zip_with(v, "_f", lambda a, b: b + F.col("_b") * (a - b)), lambda x: F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), x))))
    return out.drop("_c", "_f", "_b")


def var_step(change: np.ndarray) -> np.ndarray:
    """The next row of a history of differences by a vector autoregression of ``LAGS`` lags."""
    n = len(change) - LAGS
    lagged = lambda begin: np.hstack([change[begin + LAGS - k : begin + LAGS - k + n] for k in range(1, LAGS + 1)])
    design = np.hstack([np.ones((n, 1)), lagged(0)])
    weights = np.linalg.lstsq(design, change[LAGS:], rcond=None)[0]
    return np.concatenate([[1.0], change[: -LAGS - 1 : -1].ravel()]) @ weights


def next_surface(history: np.ndarray, components: int) -> tuple[np.ndarray, float, float]:
    """(forecast, percent of the variance in the components, root mean square error of the history rebuilt from them)."""
    middle = history.mean(axis=0)
    _, size, basis = np.linalg.svd(history - middle, full_matrices=False)
    if (size**2).sum() <= 1e-12:
        raise ValueError("the history doesn't vary")
    basis = basis[:components]
    scores = (history - middle) @ basis.T
    ahead = middle + (scores[-1] + var_step(np.diff(scores, axis=0))) @ basis
    lost = history - middle - scores @ basis
    return np.clip(ahead, LOWEST, HIGHEST), float((size[:components] ** 2).sum() / (size**2).sum() * 100), float(np.sqrt((lost**2).mean()))


def one_step_errors(history: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float | None]:
    """(errors of one-step forecasts, errors of no change, share of directions met), over the last surfaces."""
    errors, naive, hits = [], [], []
    for t in range(max(LEAST, len(history) - TESTED), len(history)):
        forecast, before, now = next_surface(history[:t], components)[0], history[t - 1], history[t]
        errors.append(now - forecast)
        naive.append(now - before)
        moves = np.abs(forecast - before) >= MOVE
        if moves.any():
            hits.append((np.sign(forecast - before) == np.sign(now - before))[moves].mean())
    return np.array(errors), np.array(naive), float(np.mean(hits)) if hits else None


def chosen_components(three: float, four: float) -> tuple[int, float]:
    """(components to keep, percent that the fourth saves)."""
    saving = (three - four) / three * 100 if three > 0 else 0.0
    return (4 if saving >= SAVING else 3), saving


OUT = pa.schema(
    [("forecast", pa.list_(pa.float64())), ("components", pa.int32()), ("explained_percent", pa.float64()), ("rebuilt_rmse", pa.float64()), ("cell_rmse", pa.list_(pa.float64()))]
    + [(c, pa.float64()) for c in ("rmse_3", "rmse_4", "fourth_saves_percent", "baseline_rmse", "improvement_percent", "direction_percent")]
    + [("sessions", pa.int32()), ("surfaces", pa.int32())]
)
_DDL = "forecast array<double>, components int, explained_percent double, rebuilt_rmse double, cell_rmse array<double>, rmse_3 double, rmse_4 double, fourth_saves_percent double, baseline_rmse double, improvement_percent double, direction_percent double, sessions int, surfaces int"


def fit_history(history: np.ndarray) -> dict | None:
    """The forecast of one symbol with its validation; None where a window doesn't vary."""
    rms = lambda e: float(np.sqrt((e**2).mean()))
    try:
        tested = {k: one_step_errors(history, k) for k in (3, 4)}
        three, four = (rms(tested[k][0]) for k in (3, 4))
        components, saving = chosen_components(three, four)
        ahead, explained, rebuilt = next_surface(history, components)
    except (ValueError, np.linalg.LinAlgError):
        return None
    errors, naive, direction = tested[components]
    base = rms(naive)
    return {
        "forecast": ahead.tolist(), "components": components, "explained_percent": explained, "rebuilt_rmse": rebuilt, "cell_rmse": np.sqrt((errors**2).mean(axis=0)).tolist(),
        "rmse_3": three, "rmse_4": four, "fourth_saves_percent": saving, "baseline_rmse": base, "improvement_percent": (base - rms(errors)) / base * 100 if base > 1e-12 else 0.0,
        "direction_percent": None if direction is None else direction * 100, "sessions": len(errors), "surfaces": len(history),
    }


def surface_forecast(surfaces: DataFrame) -> DataFrame:
    """A row for each symbol from surfaces (symbol, d, values): the next surface, how many components, and the validation."""
    days = surfaces.where("symbol IS NOT NULL AND d IS NOT NULL").groupBy("symbol", "d").agg(F.max("values").alias("values"))
    newest = top_per_group(smooth(days), ["symbol"], [F.desc("d")], HISTORY).select("symbol", "d", "smoothed")  # what a group holds is bounded
    kind = surfaces.schema["symbol"].dataType.simpleString()

    def fit(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("d")
        if len(rows) <= LEAST:
            return pa.table({"symbol": pa.array([], rows.schema.field("symbol").type)} | {f.name: pa.array([], f.type) for f in OUT})
        got = fit_history(rows.column("smoothed").combine_chunks().flatten().to_numpy().reshape(-1, CELLS))
        names = pa.array([key[0].as_py()] if got else [], rows.schema.field("symbol").type)
        return pa.table({"symbol": names} | {f.name: pa.array([got[f.name]] if got else [], f.type) for f in OUT})

    return newest.groupBy("symbol").applyInArrow(fit, f"symbol {kind}, {_DDL}")
