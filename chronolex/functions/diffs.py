"""Operators that compare two scores, and how each wants its operands trimmed and its results ranked."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _average(a: Column, b: Column) -> Column:
    return (a + b) / 2


def _harmonic(a: Column, b: Column) -> Column:
    mean = F.when((a <= 0) | (b <= 0), F.lit(0.0)).otherwise(F.try_divide(2 * a * b, a + b))
    return _average(mean, _average(a, b))


def _geometric(a: Column, b: Column) -> Column:
    product = a * b
    return _average(F.signum(product) * F.sqrt(F.abs(product)), _average(a, b))


def _logarithmic(a: Column, b: Column) -> Column:
    shift = F.greatest(F.lit(0.0), 1 - F.least(a, b))
    return F.exp((F.ln(a + shift) + F.ln(b + shift)) / 2) - shift


@dataclass(frozen=True)
class Diff:
    value: Callable[[Column, Column], Column]
    trim: str  # before comparing: "union" of both sides' best, "inner" for items of both, or "none"
    absolute: bool = False  # ranked by absolute value


DIFFS: dict[str, Diff] = {
    "adiff": Diff(lambda a, b: a - b, "union", absolute=True),
    "diff": Diff(lambda a, b: a - b, "union"),
    "sum": Diff(lambda a, b: a + b, "none"),
    "min": Diff(F.least, "inner"),
    "max": Diff(F.greatest, "union"),
    "avg": Diff(_average, "inner"),
    "havg": Diff(_harmonic, "inner"),
    "gavg": Diff(_geometric, "inner"),
    "lavg": Diff(_logarithmic, "inner"),
}


def diff(op: str | Callable[[Column, Column], Column]) -> Diff:
    """The named operator, or any function of two Columns as one that keeps all items."""
    return Diff(op, "none") if callable(op) else DIFFS[op.lower()]
