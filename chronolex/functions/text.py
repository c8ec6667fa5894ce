"""Small text functions of readers and reports."""

from __future__ import annotations

import html

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of attributes and what they are called here.
ATTRIBUTES = {
    "word": "w", "token": "w", "w": "w", "lemma": "l", "lem": "l", "l": "l", "postag": "p", "tag": "p", "pt": "p", "pos": "p", "p": "p",
    "textclass": "genre", "genre": "genre", "doc.textclass": "genre", "doc.genre": "genre",
}
TITLES = {"w": "Word", "l": "Lemma", "p": "POS"}


def attribute(name: str) -> str:
    key = name.strip().lstrip("$")
    return ATTRIBUTES.get(key.lower(), key.removeprefix("doc."))


def title(name: str) -> str:
    return TITLES.get(attribute(name), attribute(name).capitalize())


def is_metadata(name: str) -> bool:
    return attribute(name) not in TITLES


def genre(text_class: Column) -> Column:
    """What stands before the first colon of a text class."""
    return F.trim(F.split(text_class, ":", 2)[0])


def author(name: Column) -> Column:
    """A name without a trailing parenthesis."""
    return F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""))


def authority_ids(value: Column) -> Column:
    """All ids that follow a number sign, joined by a space."""
    return F.array_join(F.regexp_extract_all(value, F.lit(r"#(\w+)"), F.lit(1)), " ")


def squeezed(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def leading_year(value: Column) -> Column:
    """The digits that a date starts with; null without any."""
    return F.regexp_extract(value, r"^\s*([0-9]+)", 1).try_cast("int")


def sliced(date: Column, size: int) -> Column:
    """The first date of the slice; one slice, 0, for size 0."""
    return F.lit(0) if not size else (F.floor(date / size) * size).cast("int")


def item_key(*attributes: str) -> Column:
    return F.concat_ws("\t", *attributes)


def si(n: float, digits: int = 2) -> str:
    """A number with a unit prefix: 12345 is 12.35k."""
    for unit in ("", "k", "M", "G", "T", "P"):
        if abs(n) < 1000 or unit == "P":
            return f"{n:.{digits}f}{unit}" if unit else f"{n:g}"
        n /= 1000
    return ""


def span_of_time(seconds: float) -> str:
    minutes, rest = divmod(seconds, 60)
    hours, minutes = divmod(int(minutes), 60)
    return f"{hours}h{minutes}m{rest:.1f}s" if hours else f"{minutes}m{rest:.1f}s" if minutes else f"{rest:.3f}s"


def escaped(value: object) -> str:
    return html.escape("" if value is None else str(value))
