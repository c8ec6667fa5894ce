"""Comparison of two profiles, item by item and slice by slice."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.diffs import diff
from .profiles import over_slices, rank_value
from .relations import written
from .trim import best

_SIDE = ("N", "f1", "f2", "f12", "score")


def aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with a column ordinal: their slices in order. A side of one slice goes with each slice of the other; otherwise there must be as many."""
    a, b = written(a), written(b)  # their slices are counted first
    order = Window.orderBy("slice")  # over a row a slice
    sides = [p.select("slice").distinct().withColumn("ordinal", F.row_number().over(order)) for p in (a, b)]
    n, m = (s.count() for s in sides)
    if n != m and 1 not in (n, m):
        raise ValueError(f"{n} slices can't be aligned with {m}")
    made = []
    for own, p, k, other in ((sides[0], a, n, sides[1]), (sides[1], b, m, sides[0])):
        # A side of one slice takes the other's labels.
        labels = own.withColumn("to", F.col("slice")) if k > 1 or n == m else own.select("slice").join(other.select("ordinal", F.col("slice").alias("to")))
        made.append(p.join(F.broadcast(labels), "slice").withColumn("slice", F.col("to")).drop("to"))
    return made[0], made[1]


def compared(a: DataFrame, b: DataFrame, items: Sequence[str], op: str | Callable[[Column, Column], Column] = "adiff", k: int = -1, *, align: bool = False) -> DataFrame:
    """slice, items, the counts and scores of both sides, diff: the k best of each slice. An item that one side lacks has zeros there.

    Both sides are trimmed first as the operator wants it: to the union of their k best, or to what both have."""
    items, wanted = list(items), diff(op)
    key = "ordinal" if align else "slice"
    if align:
        a, b = aligned(a, b)
    left, right = ([key, *items, *(F.col(c).alias(f"{s}_{c}") for c in _SIDE)] for s in "ab")
    if wanted.trim == "union" and k >= 0:
        # The best of each side first, by ranks that stop at k; then what both sides have of their union.
        tops = [_best_keys(side, key, items, k) for side in (a, b)]
        keys = tops[0].unionByName(tops[1]).distinct()
        a, b = (side.join(keys, [key, *items], "left_semi") for side in (a, b))
    both = a.select(*left, *([F.col("slice").alias("a_slice")] if align else [])).join(b.select(*right, *([F.col("slice").alias("b_slice")] if align else [])), [key, *items], "inner" if wanted.trim == "inner" else "full_outer")
    both = both.fillna(0, [f"{s}_{c}" for s in "ab" for c in _SIDE[:-1]])
    value = wanted.value(rank_value("a_score"), rank_value("b_score"))
    out = both.withColumns({"a_score": rank_value("a_score"), "b_score": rank_value("b_score"), "diff": value})
    if align:
        out = out.withColumn("slice", F.coalesce("a_slice", "b_slice")).drop("ordinal", "a_slice", "b_slice")
    columns = ["slice", *items, *(f"{s}_{c}" for s in "ab" for c in _SIDE), "diff"]
    return best(out.select(*columns), items, k, score="diff", absolute=wanted.absolute)


def _best_keys(side: DataFrame, key: str, items: Sequence[str], k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(rank_value("score").desc(), *items)
    return side.select(key, *items, "score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(key, *items)


def compared_overall(a: DataFrame, b: DataFrame, items: Sequence[str], op: str = "adiff", k: int = 10, name: str = "f", eps: float = 0.0) -> DataFrame:
    """Comparison slice by slice of the items that are best with all slices as one."""
    a, b = written(a), written(b)  # each is read three times
    one = compared(over_slices(a, items, name, eps), over_slices(b, items, name, eps), items, op, k).select(*items)
    return compared(a, b, items, op).join(F.broadcast(one) if k >= 0 else one, list(items), "left_semi")  # k items at most
