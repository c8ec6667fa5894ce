"""Predicates on attributes and dates: functions from a Column to a condition, which Catalyst pushes to the scan."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Predicate = Callable[[Column], Column]

#: POSIX classes and what Java calls them.
_POSIX = {"alpha": r"\p{L}", "digit": r"\d", "alnum": r"\p{L}\p{N}", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "space": r"\s", "punct": r"\p{Punct}", "word": r"\w"}


def exact(value: str) -> Predicate:
    return lambda c: c == F.lit(value)


def any_of(values: Iterable[str]) -> Predicate:
    found = sorted(set(values))
    return lambda c: c.isin(found)


def anything() -> Predicate:
    return lambda c: F.lit(True)


def java_regex(pattern: str, modifiers: str = "") -> str:
    """A pattern with modifiers i, m, s, x, and g for a match of the whole value."""
    pattern = re.sub(r"\[:(\w+):\]", lambda m: _POSIX[m[1]], pattern)
    if "g" in modifiers:
        pattern = f"^(?:{pattern})$"
    flags = "".join(m for m in "imsx" if m in modifiers)
    return f"(?{flags}){pattern}" if flags else pattern


def regex(pattern: str, modifiers: str = "") -> Predicate:
    return lambda c: c.rlike(java_regex(pattern, modifiers))


def prefix(value: str | Iterable[str]) -> Predicate:
    return _any_part(value, lambda c, v: c.startswith(v))


def suffix(value: str | Iterable[str]) -> Predicate:
    return _any_part(value, lambda c, v: c.endswith(v))


def infix(value: str | Iterable[str]) -> Predicate:
    return _any_part(value, lambda c, v: c.contains(v))


def _any_part(value: str | Iterable[str], test: Callable[[Column, str], Column]) -> Predicate:
    values = [value] if isinstance(value, str) else sorted(set(value))

    def made(c: Column) -> Column:
        out = F.lit(False)
        for v in values:
            out = out | test(c, v)
        return out

    return made


def negated(p: Predicate) -> Predicate:
    return lambda c: ~p(c)


def as_predicate(value: str | Iterable[str] | Predicate) -> Predicate:
    """A string is an exact value, a collection of strings a set."""
    if callable(value):
        return value
    return exact(value) if isinstance(value, str) else any_of(value)


def all_of(where: dict[str, str | Iterable[str] | Predicate] | None, name: Callable[[str], str] = str) -> Column:
    """The conjunction of predicates by attribute, or the condition that where makes of the attributes' columns; name gives an attribute's column."""
    if callable(where):
        return where(lambda attribute: F.col(name(attribute)))
    out = F.lit(True)
    for attribute, value in (where or {}).items():
        out = out & as_predicate(value)(F.col(name(attribute)))
    return out


def dates(request: str | int | None) -> Predicate:
    """Of a date column: nothing or ``*`` for all, a year, ``MIN-MAX`` or ``MIN:MAX`` with either end open, a list by comma, space or bar, or ``/regex/``."""
    text = "" if request is None else str(request).strip()
    if text in ("", "*"):
        return anything()
    if m := re.fullmatch(r"/(.*)/([a-z]*)", text):
        return lambda c: c.cast("string").rlike(java_regex(m[1], m[2]))
    if m := re.fullmatch(r"(\d+|\*)?\s*[-:]\s*(\d+|\*)?", text):
        low, high = (None if x in (None, "*") else int(x) for x in m.groups())
        return lambda c: (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c <= high)
    years = [int(x) for x in re.split(r"[,\s|]+", text) if x]
    return lambda c: c.isin(years) if len(years) > 1 else c == years[0]


def date_bounds(request: str | int | None) -> tuple[int | None, int | None]:
    """First and last date of a range or year, for filling slices; None for the corpus' own."""
    text = "" if request is None else str(request).strip()
    if m := re.fullmatch(r"(\d+|\*)?\s*[-:]\s*(\d+|\*)?", text):
        return tuple(None if x in (None, "*") else int(x) for x in m.groups())
    return (int(text), int(text)) if text.isdigit() else (None, None)
