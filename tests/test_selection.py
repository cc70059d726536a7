"""Round-robin selection under constraints, near titles and tolerance joins against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import round_robin as rr
from marketloom.operators.tolerance import first_within, within

ITEM = "id long, group string, url string, domain string, title string, score double, ord long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b):
    return bool(a) and bool(b) and (a == b or 1 - distance(a, b) / max(len(a), len(b)) >= 0.88)


def plain(items, limit, cap):
    groups = {}
    for it in sorted({i[0]: i for i in items if i[0] is not None and i[1] is not None}.values(), key=lambda i: (-i[5], i[0])):
        groups.setdefault(it[1], []).append(it)
    taken = []
    for position in range(max(map(len, groups.values()), default=0)):
        for g in sorted(groups):
            if position < len(groups[g]) and len(taken) < limit:
                it = groups[g][position]
                clash = any(t[2] == it[2] and it[2] is not None for t, _ in taken) or any(alike(t[4], it[4]) for t, _ in taken)
                if not clash and (it[3] is None or sum(t[3] == it[3] for t, _ in taken) < cap):
                    taken.append((it, position + 1))
    return [(t[0], t[1], p) for t, p in taken]


def made(seed, n, domains):
    rng = random.Random(seed)
    stems = ["market rises on strong earnings report", "central bank holds its policy rate", "oil slides as supply grows again", "shares of carmaker jump after results"]

    def title():
        t = list(rng.choice(stems) + rng.choice(["", " today", " in asia"]))
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = rng.choice("abcxyz")
        return rng.choice(["".join(t), "".join(t), "", None])

    rows = [(k, rng.choice(["a", "b", "c"]), f"u{rng.randrange(n // 2)}", rng.choice([None, *(f"d{j}" for j in range(domains))]), title(), float(rng.randrange(6)), k) for k in range(n)]
    return rows + [(None, "a", "x", "x", "x", 9.0, 0), (n + 1, None, "x", "x", "x", 9.0, 0), rows[0]]


@pytest.mark.parametrize(("seed", "n", "domains", "cap", "limit", "page"), [(1, 60, 12, 1, 100, None), (2, 90, 5, 2, 12, 3), (3, 40, 3, 3, 100, 2)])
def test_selection_equals_the_greedy_loop(spark, seed, n, domains, cap, limit, page):
    items = made(seed, n, domains)
    want = plain(items, limit, cap)
    got = rr.round_robin(spark.createDataFrame(items, ITEM), [F.desc("score")], limit=limit, cap=cap, page=page).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    by_id = {i[0]: i for i in items}
    taken = [by_id[i] for i, _, _ in want]
    rest = [i for i in items if i[0] is not None and i[1] is not None and i[0] not in {t[0] for t in taken}]
    if limit == 100:  # both kinds of conflict decide
        assert any(sum(t[3] == r[3] for t in taken) >= cap for r in rest if r[3])
        assert any(any(alike(t[4], r[4]) and t[4] != r[4] for t in taken) for r in rest)


def test_conflicts_undecided_before_are_waited_for(spark):
    """1 forbids 2 by its title, so 2 doesn't forbid 3 by its domain, which frees 3 and drops 4."""
    rows = [(1, "g", "u1", "d1", "a title that is quite long", 0.0, 1), (2, "g", "u2", "d2", "a title that is quite lonx", 0.0, 2), (3, "g", "u3", "d2", "something else altogether", 0.0, 3), (4, "g", "u4", "d2", None, 0.0, 4), (5, "g", "u3", None, "", 0.0, 5)]
    got = rr.conflict_free(spark.createDataFrame(rows, ITEM)).collect()
    assert sorted(r.id for r in got) == [1, 3]
    assert rr.round_robin(spark.createDataFrame([], ITEM), [F.desc("score")], limit=3).collect() == []


def test_tolerance_join_equals_all_pairs(spark):
    rng = random.Random(8)
    left = [(k, rng.choice("ab"), rng.randrange(400) * 0.005 - 1 + rng.choice([0, 1e-4, -1e-4])) for k in range(300)]
    left += [(900, "a", None), (901, "a", float("nan")), (902, None, 0.0), (903, "a", float("inf")), (904, "b", -0.0)]
    right = [(k, rng.choice("ab"), rng.randrange(400) * 0.005 - 1) for k in range(300)] + [(900, "a", None), (901, "b", float("nan")), (902, None, 0.0), (903, "a", float("inf")), (5, "a", 0.0)]
    a, b = spark.createDataFrame(left, "id long, k string, x double"), spark.createDataFrame(right, "q long, k string, y double")
    met = lambda i, j: i[1] is not None and i[1] == j[1] and i[2] is not None and j[2] is not None and abs(i[2] - j[2]) <= 0.01
    want = sorted((i[0], j[0]) for i in left for j in right if met(i, j))
    assert sorted((r.id, r.q) for r in within(a, b, ["k"], "x", "y", 0.01).collect()) == want and len(want) > 300
    first = {r.id: r.q for r in first_within(a, b, ["k"], "x", "y", 0.01, "id", "q").collect()}
    best = {}
    for i in left:
        found = [(j[2], j[0]) for j in right if met(i, j)]
        best[i[0]] = min(found)[1] if found else None
    assert first == best and None in first.values()
    assert within(a.limit(0), b, ["k"], "x", "y", 0.01).collect() == [] and all(r.q is None for r in first_within(a, b.limit(0), ["k"], "x", "y", 0.01, "id", "q").collect())
