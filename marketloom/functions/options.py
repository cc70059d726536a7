"""Option pricing as Column expressions: Black-Scholes, Greeks, implied volatility."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import finite, norm_cdf, norm_cdf_array, norm_cdf_sql, norm_pdf, norm_pdf_sql


def d1(s: Column, k: Column, t: Column, r: Column, v: Column) -> Column:
    return (F.ln(s / k) + (r + v * v / 2) * t) / (v * F.sqrt(t))


def price(s: Column, k: Column, t: Column, r: Column, v: Column, call: Column) -> Column:
    a = d1(s, k, t, r, v)
    b = a - v * F.sqrt(t)
    sign = F.when(call, 1.0).otherwise(-1.0)
    return sign * (s * norm_cdf(sign * a) - k * F.exp(-r * t) * norm_cdf(sign * b))


def greeks(s: Column, k: Column, t: Column, r: Column, v: Column, call: Column) -> dict[str, Column]:
    """delta, gamma, theta per day, vega and rho per percent; null on invalid input."""
    a = d1(s, k, t, r, v)
    b = a - v * F.sqrt(t)
    sign = F.when(call, 1.0).otherwise(-1.0)
    bond = k * F.exp(-r * t)
    out = {
        "delta": norm_cdf(a) - F.when(call, 0.0).otherwise(1.0),
        "gamma": norm_pdf(a) / (s * v * F.sqrt(t)),
        "theta": (-s * norm_pdf(a) * v / (2 * F.sqrt(t)) - sign * r * bond * norm_cdf(sign * b)) / 365,
        "vega": s * norm_pdf(a) * F.sqrt(t) / 100,
        "rho": sign * bond * t * norm_cdf(sign * b) / 100,
    }
    good = (s > 0) & (k > 0) & (t > 0) & (v > 0)
    return {n: F.when(good, c) for n, c in out.items()}


def prob_above(s: Column, k: Column, t: Column, r: Column, v: Column) -> Column:
    return norm_cdf(d1(s, k, t, r, v) - v * F.sqrt(t))


# Volatilities between which a quote is inverted, percents that count, and what a quote may lie below its bound.
LOW_VOL, HIGH_VOL, LEAST_PERCENT, MOST_PERCENT, SLACK, HALVINGS = 0.005, 5.0, 1.0, 250.0, 0.05, 70


def invert(premium: np.ndarray, s: np.ndarray, k: np.ndarray, t: np.ndarray, r: np.ndarray, sign: np.ndarray, steps: int) -> np.ndarray:
    """Volatilities by ``steps`` halvings of all rows at once (sign: 1 for calls, -1 for puts); NaN where a quote doesn't tell one."""
    with np.errstate(all="ignore"):
        root, drift, bond = np.sqrt(t), np.log(s / k) + r * t, k * np.exp(-r * t)

        def at(v: np.ndarray | float) -> np.ndarray:
            spread = v * root
            a = drift / spread + spread / 2
            return sign * (s * norm_cdf_array(sign * a) - bond * norm_cdf_array(sign * (a - spread)))

        told = (np.fmin(np.fmin(premium, s), np.fmin(k, t)) > 0) & (premium >= np.maximum(0.0, sign * (s - bond)) - SLACK) & (premium < np.where(sign > 0, s, bond))
        told &= (premium >= at(LOW_VOL) - SLACK) & (premium <= at(HIGH_VOL))
        low, high = np.full(len(s), LOW_VOL), np.full(len(s), HIGH_VOL)
        for _ in range(steps):
            middle = (low + high) / 2
            under = at(middle) < premium
            low, high = np.where(under, middle, low), np.where(under, high, middle)
        found = (low + high) / 2
        return np.where(told & (found * 100 >= LEAST_PERCENT) & (found * 100 <= MOST_PERCENT), found, np.nan)


def implied_vol(premium: Column, s: Column, k: Column, t: Column, r: Column, call: Column, steps: int = HALVINGS) -> Column:
    """Volatility by bisection, ``steps`` halvings, a batch of rows at once in NumPy (a fold of built-in functions runs uncompiled, 70 times a row).

    Null where the quote doesn't tell it: not positive, under its intrinsic value or the price at ``LOW_VOL`` by more than ``SLACK``, at or over what the
    option can be worth, over the price at ``HIGH_VOL``, or a result outside of ``LEAST_PERCENT`` to ``MOST_PERCENT``.
    """

    @F.pandas_udf("double")
    def inverted(premium: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, sign: pd.Series) -> pd.Series:
        return pd.Series(invert(*(c.to_numpy(float) for c in (premium, s, k, t, r, sign)), steps))

    doubles = [c.cast("double") for c in (premium, s, k, t, r)]
    return finite(inverted(*doubles, F.when(call, 1.0).otherwise(-1.0)))


def implied_sql(source: str, keep: str) -> str:
    """CTEs (recursive) that invert ``premium`` of the rows of ``source``, told apart by id; ``implied`` has id, ``keep`` and vol."""
    at = lambda v: price_sql("s", "strike", "t", "r", v, "sg")
    return f"""bisect AS (SELECT *, {LOW_VOL}::DOUBLE AS lo, {HIGH_VOL}::DOUBLE AS hi, 0 AS step, greatest(0, sg * (s - strike * exp(-r * t))) AS intrinsic, {at(LOW_VOL)} AS cheapest, {at(HIGH_VOL)} AS dearest FROM {source}
 UNION ALL SELECT * EXCLUDE (under) REPLACE (CASE WHEN under THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN under THEN hi ELSE (lo + hi) / 2 END AS hi, step + 1 AS step) FROM (SELECT *, {at('((lo + hi) / 2)')} < premium AS under FROM bisect WHERE step < {HALVINGS})),
implied AS (SELECT id, {keep}, CASE WHEN premium > 0 AND s > 0 AND strike > 0 AND t > 0 AND premium >= intrinsic - {SLACK} AND premium < CASE WHEN sg > 0 THEN s ELSE strike * exp(-r * t) END AND premium >= cheapest - {SLACK} AND premium <= dearest
 AND (lo + hi) * 50 BETWEEN {LEAST_PERCENT} AND {MOST_PERCENT} THEN (lo + hi) / 2 END AS vol FROM bisect WHERE step = {HALVINGS})"""


def d1_sql(s: str, k: str, t: str, r: str, v: str) -> str:
    return f"((ln({s} / {k}) + ({r} + {v} * {v} / 2) * {t}) / ({v} * sqrt({t})))"


def price_sql(s: str, k: str, t: str, r: str, v: str, sign: str) -> str:
    a = d1_sql(s, k, t, r, v)
    return f"({sign} * ({s} * {norm_cdf_sql(f'{sign} * {a}')} - {k} * exp(-{r} * {t}) * {norm_cdf_sql(f'{sign} * ({a} - {v} * sqrt({t}))')}))"


__all__ = ["d1", "d1_sql", "greeks", "implied_sql", "implied_vol", "norm_pdf_sql", "price", "price_sql", "prob_above"]
