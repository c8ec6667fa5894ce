"""Requests as users type them: clauses of attributes and values, and lists of attributes to group by.

A clause is ``attribute=value`` or, where a default attribute is known, a value alone; clauses are parted by commas or blanks and all hold. A value is a word, words
joined by ``|``, ``/pattern/modifiers``, or ``*``; a word that starts or ends with ``*`` stands for what ends, starts or goes on with the rest. A backslash takes
the next character as it is. In a group-by list each clause names an attribute, whose value, if it has one, restricts what is told."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import Predicate, any_of, anything, exact, infix, prefix, regex, suffix

_CLAUSE = re.compile(r"[\s,]*(?:\$?(?P<name>(?:\\.|[^\s,:=|/\\$*])+)\s*[:=]\s*)?(?P<value>/(?:\\.|[^/\\])*/[a-z]*|(?:\\.|[^\s,|\\])+(?:\s*\|\s*(?:\\.|[^\s,|\\])+)*)")


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def value_of(text: str) -> Predicate:
    """What a value of a clause takes in."""
    if text in ("", "*"):
        return anything()
    if m := re.fullmatch(r"/(.*)/([a-z]*)", text, re.S):
        return regex(m[1].replace("\\/", "/"), m[2])
    words = [w for w in re.split(r"(?<!\\)\s*\|\s*", text) if w]
    if len(words) > 1:
        return any_of(map(_plain, words))
    head, tail = text.startswith("*"), text.endswith("*") and not text.endswith("\\*")
    word = _plain(text[head : len(text) - tail])
    return (infix if head and tail else suffix if head else prefix if tail else exact)(word)


def _clauses(text: str) -> Iterator[tuple[str | None, str]]:
    at = 0
    while at < len(text.rstrip(" ,\t\n")):
        m = _CLAUSE.match(text, at)
        if m is None:
            raise ValueError(f"can't read the request from {text[at:]!r} on")
        at = m.end()
        if m["name"] is None and m["value"].upper() == "WITH":
            continue
        yield m["name"] and _plain(m["name"]), m["value"]


def clauses(text: str, default: str) -> dict[str, Predicate]:
    """Conditions by attribute; values without an attribute are the default's. Two clauses of one attribute both hold."""
    out: dict[str, Predicate] = {}
    for name, value in _clauses(text):
        name = (name or default).lstrip("$") or default
        one, before = value_of(value), out.get(name)
        out[name] = one if before is None else lambda c, a=before, b=one: a(c) & b(c)
    return out


def group_by(text: str) -> tuple[list[str], dict[str, Predicate]]:
    """Attributes in order, and the conditions on them."""
    items, having = [], {}
    for name, value in _clauses(text):
        attribute = name or _plain(value)
        items.append(attribute.lstrip("$"))
        if name is not None and value != "*":
            having[items[-1]] = value_of(value)
    return list(dict.fromkeys(items)), having


_KEY = re.compile(r"""\s*(?:@(?P<constant>'(?:\\.|[^'\\])*'|[\w\-]+)|(?P<date>date)(?:\s*/\s*(?P<size>\d+))?(?=\s*(?:,|\]|$))|\$?(?P<name>[\w.]+)(?P<changes>(?:\s*~\s*s/(?:\\.|[^/\\])*/(?:\\.|[^/\\])*/[gimsx]*)*))\s*""")
_CHANGE = re.compile(r"s/((?:\\.|[^/\\])*)/((?:\\.|[^/\\])*)/([gimsx]*)")


def count_keys(text: str, default_date: str = "date") -> dict[str, Column]:
    """Keys to count by, by name, of a list such as ``[$l, doc.genre ~ s/:.*//, date/10, @'all']``: attributes and metadata (without ``doc.``), maybe with parts of their values replaced, slices of the
    date, and constants. A change without the modifier g is made once, and a group of the pattern stands in the replacement as $1 or \\1."""
    inner = re.sub(r"^\s*(?:#by)?\s*\[(.*)\]\s*$", r"\1", text, flags=re.S | re.I)
    keys: dict[str, Column] = {}
    at = 0
    while at < len(inner.rstrip()):
        m = _KEY.match(inner, at)
        if m is None or m.end() < len(inner.rstrip()) and inner[m.end()] != ",":
            raise ValueError(f"can't read the keys from {inner[at:]!r} on")
        at = m.end() + 1
        if m["constant"] is not None:
            value = _plain(m["constant"][1:-1]) if m["constant"].startswith("'") else m["constant"]
            keys[f"const{len(keys)}" if value == "" else value] = F.lit(value)
        elif m["date"]:
            size = int(m["size"] or 1)
            keys["date"] = F.lit(0) if size == 0 else (F.floor(F.col(default_date) / size) * size).cast("int")
        else:
            name = m["name"].removeprefix("doc.")
            column = F.col(name)
            for pattern, by, modifiers in _CHANGE.findall(m["changes"]):
                flags = "".join(x for x in "imsx" if x in modifiers)
                found = (f"(?{flags})" if flags else "") + pattern.replace("\\/", "/")
                by = re.sub(r"\\(\d)", r"$\1", by.replace("\\/", "/"))
                # Once: the rest of the value is taken as it is, from the first match on.
                column = F.regexp_replace(column, F.lit(found), F.lit(by)) if "g" in modifiers else _replaced_once(column, found, by)
            keys[name] = column
    return keys


def _replaced_once(column: Column, pattern: str, by: str) -> Column:
    """The first match of pattern replaced."""
    first = F.regexp_substr(column, F.lit(pattern))
    at = F.regexp_instr(column, F.lit(pattern))
    changed = F.regexp_replace(first, F.lit(pattern), F.lit(by))
    whole = F.concat(F.substring(column, F.lit(1), at - 1), changed, F.substring(column, at + F.char_length(first), F.char_length(column)))
    return F.when(first.isNull(), column).otherwise(whole)
