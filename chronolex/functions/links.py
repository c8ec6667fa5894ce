"""For each row of a profile the request that finds its hits, in canonical form, and the factor between its hits and its counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import querytree as Q

_PLACE = "\x00"


def quoted(word: Column) -> Column:
    """What querytree.quoted gives, of a column."""
    plain = F.regexp_replace(word, F.lit(r"(?U)([^\w.\-])"), F.lit(r"\\$1"))
    return F.when(F.lower(word).isin("with", "without", "and", "or", "not", "near"), F.concat(F.lit("\\"), plain)).otherwise(plain)


def _tree(request: Q.Request, relation: str, items: Q.Tree | None, distance: int) -> Q.Tree:
    target = request.tree if request.tree is not None else Q.Token("any")
    if items is None:
        return target
    if relation == "xf":
        return Q.Pair("WITH", target, items)
    if relation == "tdf":
        return Q.Pair("&&", target, items)
    both = _marked(items, 2)
    if relation == "chain":
        told = [t for t in target.tokens() if t.match == 2]
        if told:
            return _with(target, both)
        distance = int(request.options.get("dmax", distance))
    return Q.Near(_marked(target, 1), both, distance - 1)


def _marked(tree: Q.Tree, match: int) -> Q.Tree:
    if isinstance(tree, Q.Token):
        return tree if tree.match else replace(tree, match=match)
    if isinstance(tree, Q.Pair):
        return replace(tree, a=_marked(tree.a, match), b=_marked(tree.b, match))
    return Q.Not(_marked(tree.a, match)) if isinstance(tree, Q.Not) else tree


def _with(tree: Q.Tree, items: Q.Tree) -> Q.Tree:
    """tree with items as conditions of the item that is told, the one of match id 2."""
    if isinstance(tree, Q.Sequence):
        return replace(tree, items=tuple(Q.Pair("WITH", i, items) if any(t.match == 2 for t in i.tokens()) else i for i in tree.items))
    if isinstance(tree, Q.Near):
        a, b = (Q.Pair("WITH", i, items) if any(t.match == 2 for t in i.tokens()) else i for i in (tree.a, tree.b))
        return replace(tree, a=a, b=b)
    return Q.Pair("WITH", tree, items)


def with_links(profile: DataFrame, request: str | Q.Request, group_by: Sequence[str], *, relation: str = "cof", size: int = 0, distance: int = 5, metadata: Sequence[str] = (), ways: float | None = None) -> DataFrame:
    """profile with link and fcoef. relation: xf (the target's tokens themselves), cof (near it), tdf (in one document with it) or chain (ways is then Chain.ways); metadata names the items that are of documents. A row
    without an item, as of a filled slice, has no link."""
    asked = Q.parse(request) if isinstance(request, str) else request
    tokens = [g for g in group_by if g not in metadata]
    items: Q.Tree | None = None
    for g in tokens:
        one = Q.Token("exact", (_PLACE + g,), g)
        items = one if items is None else Q.Pair("WITH", items, one)
    filters = (*asked.filters, *(Q.Has(g, Q.Token("exact", (_PLACE + g,))) for g in metadata if g in group_by))
    form = replace(asked, tree=_tree(asked, relation, items, distance), filters=filters, dates=(_PLACE + "low", _PLACE + "high") if size else asked.dates)
    text = str(form)
    fill = {Q.quoted(_PLACE + g): quoted(F.col(g)) for g in group_by} | {_PLACE + "low": F.col("slice").cast("string"), _PLACE + "high": (F.col("slice") + size - 1).cast("string")}
    parts: list[Column] = []
    while text:
        at, mark = min(((text.find(m), m) for m in fill if m in text), default=(len(text), ""), key=lambda x: (x[0], -len(x[1])))
        if at:
            parts.append(F.lit(text[:at]))
        if mark:
            parts.append(fill[mark])
        text = text[at + len(mark) :]
    coef = asked.options.get("coef", ways if ways is not None else {"cof": 2 * distance}.get(relation, 1))
    return profile.withColumns({"link": F.concat(*parts), "fcoef": F.lit(float(coef))})
