"""Surfaces from quotes: buckets, filters and tenors against a plain form."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest

from marketloom.operators import iv_surface as ivs

DAY = dt.date(2024, 1, 1)
QUOTE = "id long, symbol string, d date, expiry date, strike double, is_call boolean, price double, spot double, volume double, oi double"


def cdf(x):
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def priced(call, spot, strike, t, vol, r=0.065):
    a = (math.log(spot / strike) + (r + vol * vol / 2) * t) / (vol * math.sqrt(t))
    b = a - vol * math.sqrt(t)
    return spot * cdf(a) - strike * math.exp(-r * t) * cdf(b) if call else strike * math.exp(-r * t) * cdf(-b) - spot * cdf(-a)


def made(symbol, days, vols, start, spot=100.0):
    """A whole chain whose volatility depends on the strike and the expiry."""
    rows = []
    for n, strike in enumerate(map(float, range(60, 145))):
        for call in (True, False):
            t = days / 365.25
            vol = vols + 0.002 * abs(strike - spot)
            rows.append((start + 2 * n + call, symbol, DAY, DAY + dt.timedelta(days=days), strike, call, priced(call, spot, strike, t, vol), spot, 1.0 + n % 3, 0.0))
    return rows


def plain_smile(rows, days):
    spot, t, seen = 100.0, days / 365.25, []
    for i, _, _, _, strike, call, price, _, volume, oi in rows:
        if (strike < 97 if call else strike > 103) or price <= 0:
            continue
        vol = (0.2 if days < 50 else 0.3) + 0.002 * abs(strike - spot)
        a = (math.log(spot / strike) + (0.065 + vol * vol / 2) * t) / (vol * math.sqrt(t))
        seen.append((call, abs(cdf(a) - (0 if call else 1)), volume + oi, i, vol * 100))
    def near(call, target):
        found = [(round(abs(x - target), 9), -liquid, i, v) for c, x, liquid, i, v in seen if c == call and 0.02 <= x <= 0.98]
        return min(found)[3] if found and min(found)[0] <= 0.18 else None
    return [near(False, 0.1), near(False, 0.25), (near(False, 0.5) + near(True, 0.5)) / 2, near(True, 0.25), near(True, 0.1)]


def test_surface_equals_a_plain_form(spark):
    early, late = made("A", 20, 0.2, 0), made("A", 70, 0.3, 1000)
    others = made("A", 1, 0.2, 2000) + made("A", 141, 0.2, 3000) + made("one", 30, 0.2, 4000)  # too near, too far, a single expiry
    few = [r for r in made("few", 20, 0.2, 5000) + made("few", 70, 0.2, 6000) if r[4] in (100.0, 101.0)]
    bad = [(7000 + k, "A", DAY, DAY + dt.timedelta(days=20), *x) for k, x in enumerate([(100.0, True, None, 100.0, 1.0, 1.0), (100.0, True, 99.9, 100.0, 1.0, 1.0), (None, True, 1.0, 100.0, 1.0, 1.0), (100.0, None, 1.0, 100.0, 1.0, 1.0), (100.0, False, 3.0, 100.0, 0.0, None)])]
    df = spark.createDataFrame(early + late + others + few + bad, QUOTE)
    got = ivs.surfaces(df).collect()
    assert [(r.symbol, r.d, len(r["values"])) for r in got] == [("A", DAY, 20)]
    a, b = plain_smile(early, 20), plain_smile(late, 70)
    want = [np.interp(ivs.TENORS, [20, 70], [a[j], b[j]]) for j in range(5)]
    assert got[0]["values"] == pytest.approx([want[j][i] for i in range(4) for j in range(5)], abs=1e-4)
    assert ivs.surfaces(df.limit(0)).collect() == []
