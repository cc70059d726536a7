"""Verdicts of the evaluation report, each reached, and worker confidence."""

from __future__ import annotations

import pytest

from marketloom.queries.market import VERDICTS, evaluation_report

RECORD = "market string, symbol long, status string, model_rmse double, baseline_rmse double, explained double, reconstruction double, direction double"


def test_every_verdict_is_reached(spark):
    def many(market, model, base, explained, direction, n=100):
        return [(market, k % 7, "scored", model, base, explained, 0.1, direction) for k in range(n)]

    rows = many("few", 1.0, 2.0, 99.0, 60.0, 99) + many("surface", 1.0, 2.0, 94.9, 60.0) + many("worse", 2.0, 2.0, 99.0, 60.0) + many("edge", 1.5, 2.0, 95.0, 55.0)
    rows += many("weak", 1.9, 2.0, 99.0, 60.0) + many("blind", 1.0, 2.0, None, None) + [("blind", 50, "pending", None, None, None, None, None), ("blind", 51, "scored", None, 3.0, None, None, None)]
    rows += [("none", 1, "pending", None, None, None, None, None)]
    df = spark.createDataFrame(rows, RECORD)
    got = {r.market: r for r in evaluation_report(df, "market").collect()}
    want = {"few": 0, "surface": 1, "worse": 2, "edge": 3, "weak": 4, "blind": 4, "none": 0}
    assert {k: r.verdict for k, r in got.items()} == {k: VERDICTS[v] for k, v in want.items()}
    blind, none = got["blind"], got["none"]
    assert (blind.scored, blind.pending, blind.symbols, blind.explained, blind.direction) == (101, 1, 9, None, None)
    assert blind.model_rmse == 1.0 and blind.baseline_rmse == pytest.approx(203 / 101) and blind.win_rate == pytest.approx(100 * 100 / 101)
    assert (none.scored, none.win_rate, none.model_rmse, none.improvement) == (0, None, None, None)
    assert got["worse"].win_rate == 0 and evaluation_report(df.limit(0), "market").collect() == []
