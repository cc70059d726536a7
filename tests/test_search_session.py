"""Runs of a search session against a plain record-by-record form."""

from __future__ import annotations

import random

import pytest

from marketloom.operators import search_session as ss


def plain(state, results, passing, outcomes, limit, final):
    best = {}
    for c, s in results:
        if c is not None:
            best[c] = s if c not in best or best[c] is None or (s is not None and s > best[c]) else best[c]
    kept = sorted((c for c in best if c in passing), key=lambda c: (best[c] is None, -(best[c] or 0), c))
    chosen = kept[:limit]
    state = {k: dict(v) for k, v in state.items()}
    for c, row in state.items():
        if c not in kept:
            row["stage"] = "filtered_out"
            if ss.NOTE not in row["limitations"]:
                row["limitations"] = [*row["limitations"], ss.NOTE]
        elif row["stage"] == "filtered_out":
            row["stage"] = "researched" if row["completed"] else "filtered"
    for c in chosen:
        state.setdefault(c, {"stage": "filtered", "completed": False, "outcome": False, "score": best[c], "final": None, "limitations": []})
    for c in chosen:
        row = state[c]
        if row["stage"] not in ("researched", "qualified") and c in outcomes:
            row["completed"], row["outcome"], row["final"] = outcomes[c]
            row["stage"] = "researched"
    able = sorted((c for c, r in state.items() if r["outcome"] and r["stage"] in ("researched", "qualified")), key=lambda c: (-state[c]["final"], c))
    for c, row in state.items():
        row["rank"] = able.index(c) + 1 if c in able[:final] else None
        row["stage"] = "qualified" if row["rank"] else "researched" if row["stage"] == "qualified" else row["stage"]
        row["eligible"] = c in able
    return state


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_the_plain_form(spark, seed):
    rng = random.Random(seed)
    ids = list(range(40))
    results = [(c, rng.choice([None, 0.5, rng.random(), rng.random()])) for c in ids if c % 7] + [(None, 0.9), (3, 0.99), (3, 0.1)]
    outcomes = {c: (rng.random() < 0.8, rng.random() < 0.6, rng.choice([0.5, rng.random()])) for c in ids if rng.random() < 0.9}
    made = spark.createDataFrame([(c, *v) for c, v in outcomes.items()], "company_id long, completed boolean, eligible boolean, final_score double")
    found = spark.createDataFrame(results, "company_id long, score double")
    state, want, seen = spark.createDataFrame([], ss.STATE), {}, set()
    for _ in range(4):
        passing = set(rng.sample(ids, 25))
        kept = spark.createDataFrame([(c,) for c in passing], "company_id long")
        state = ss.run(state, found, kept, made, limit=10, final=4)
        rows = state.collect()
        state = spark.createDataFrame(rows, state.schema)
        before = {c: r["stage"] for c, r in want.items()}
        want = plain(want, results, passing, outcomes, 10, 4)
        got = {r.company_id: r for r in rows}
        assert len(rows) == len(got) and set(got) == set(want)
        for c, r in want.items():
            g = got[c]
            assert (g.stage, g.completed, g.outcome, g.eligible, g.rank, g.limitations) == (r["stage"], r["completed"], r["outcome"], r["eligible"], r["rank"], r["limitations"])
            assert g.final_score == r["final"] and g.score == r["score"]
            seen.add((before.get(c), r["stage"]))
    assert {(None, "qualified"), ("qualified", "filtered_out"), ("filtered_out", "qualified")} <= seen or len(seen) > 6
    assert any(a == "filtered_out" and b != "filtered_out" for a, b in seen) and any(b == "filtered_out" for _, b in seen)


def test_empty_inputs_and_the_funnel(spark):
    empty = spark.createDataFrame([], ss.STATE)
    none = spark.createDataFrame([], "company_id long, score double")
    no_outcomes = spark.createDataFrame([], "company_id long, completed boolean, eligible boolean, final_score double")
    assert ss.run(empty, none, none, no_outcomes).collect() == []
    results = spark.createDataFrame([(1, 0.5), (2, 0.4)], "company_id long, score double")
    state = ss.run(empty, results, results.where("company_id = 2"), no_outcomes)
    assert [(r.company_id, r.stage, r.rank) for r in state.collect()] == [(2, "filtered", None)]
    assert {r.stage: r.n for r in ss.funnel(results, results.where("company_id = 2"), state).collect()} == {"semantic_matches": 2, "passed_filters": 1, "candidates": 1}
