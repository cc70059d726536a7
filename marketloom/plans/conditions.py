"""Conditions of a plan compiled to Column expressions.

A structured condition has three results: ``pass``, ``fail`` and, where the value is null, ``not_verified``.
Only a required condition that fails drops a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, FAIL, NOT_VERIFIED = "pass", "fail", "not_verified"


@dataclass(frozen=True)
class Condition:
    field: str  # ticker, market_cap, or a text column
    operator: str  # eq, in, gte, lte, around, between
    value: object
    required: bool = True
    tolerance: float = 0.4


def cap_bounds(c: Condition) -> tuple[float | None, float | None]:
    """Inclusive bounds of a size condition; None is unbounded."""
    values = [float(v) for v in c.value] if isinstance(c.value, (list, tuple)) else [float(c.value)]  # type: ignore[arg-type]
    match c.operator:
        case "around":
            return values[0] * (1 - c.tolerance), values[0] * (1 + c.tolerance)
        case "between" | "in":
            return min(values), max(values)
        case "gte":
            return values[0], None
        case "lte":
            return None, values[0]
        case _:
            return values[0], values[0]


def text_match(column: Column, wanted: Sequence[str]) -> Column:
    """Any of the wanted texts equals the column or occurs in it, in any case."""
    low = F.lower(column)
    found = F.lit(False)
    for w in wanted:
        found = found | F.contains(low, F.lit(w.lower()))
    return found


def status(c: Condition) -> Column:
    column = F.col(c.field)
    wanted = list(c.value) if isinstance(c.value, (list, tuple)) else [c.value]
    if c.field == "ticker":  # whatever the operator
        passed = F.upper(column).isin([str(w).upper() for w in wanted])
    elif c.field == "market_cap":
        low, high = cap_bounds(c)
        passed = F.lit(True)
        if low is not None:
            passed = passed & (column >= low)
        if high is not None:
            passed = passed & (column <= high)
    elif c.operator in ("eq", "in"):
        passed = text_match(column, [str(w) for w in wanted])
    else:  # an ordering of texts is a failure, not an unknown
        return F.lit(FAIL)
    return F.when(column.isNull(), NOT_VERIFIED).when(passed, PASS).otherwise(FAIL)


def with_statuses(df: DataFrame, plan: Sequence[Condition]) -> DataFrame:
    """``df`` with an array of (field, required, status) structs and the columns status_0, status_1, ..."""
    made = {f"status_{i}": status(c) for i, c in enumerate(plan)}
    df = df.withColumns(made)
    each = [F.struct(F.lit(c.field).alias("field"), F.lit(c.required).alias("required"), F.col(f"status_{i}").alias("status")) for i, c in enumerate(plan)]
    return df.withColumn("statuses", F.array(*each))


def apply_filters(df: DataFrame, plan: Sequence[Condition]) -> DataFrame:
    return with_statuses(df, plan).where(~F.exists("statuses", lambda s: s["required"] & (s["status"] == FAIL)))


def passes(column: Column, operator: str, value: float, high: float | None = None) -> Column:
    """A technical predicate; null and NaN are false."""
    x = F.when(~F.isnan(column), column)
    test = {
        "gt": lambda: x > value,
        "gte": lambda: x >= value,
        "lt": lambda: x < value,
        "lte": lambda: x <= value,
        "between": lambda: (x >= value) & (x <= high),
    }[operator]()
    return F.coalesce(test, F.lit(False))


def strength(column: Column, operator: str, value: float, high: float | None = None) -> Column:
    """How clearly a predicate that passes does so, from 0.5 to 1."""
    if operator == "between":
        middle, half = (value + high) / 2, max((high - value) / 2, 1e-9)  # type: ignore[operator]
        return F.greatest(F.lit(0.5), 1 - 0.5 * F.abs(column - middle) / half)
    margin = column - value if operator in ("gt", "gte") else value - column
    return F.least(F.lit(1.0), F.greatest(F.lit(0.5), 0.5 + 0.5 * margin / max(abs(value), 1.0)))
