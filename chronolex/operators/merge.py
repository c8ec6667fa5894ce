"""Union of databases: aggregates of several corpora as one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relations import dealt, parts_of


def _all(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def union_unigrams(tables: Sequence[DataFrame], attributes: Sequence[str]) -> DataFrame:
    return _all(tables).groupBy(*attributes, "date").agg(F.sum("f").alias("f"))


def union_cooccurrences(tables: Sequence[DataFrame], attributes: Sequence[str], minimum: int = 2) -> DataFrame:
    """Of tables that are thresholded already: what a part has dropped stays dropped, and the threshold holds for the sums."""
    keys = [*(f"{a}1" for a in attributes), "date", *(f"{a}2" for a in attributes)]
    return _all(tables).groupBy(*keys).agg(F.sum("f12").alias("f12")).filter(F.col("f12") >= minimum)


def union_marginals(tables: Sequence[DataFrame], attributes: Sequence[str]) -> DataFrame:
    """Marginals hold what the parts dropped, so they stay exact."""
    return _all(tables).groupBy(*attributes, "date").agg(F.sum("f1").alias("f1"))


def union_segments(tables: Sequence[DataFrame], attributes: Sequence[str] = (), segment: Sequence[str] = ("doc_id",), *, document_min: int = 0, term_min: int = 0) -> DataFrame:
    """Segments of different parts stay apart: the ids of their documents bear the part's number, and whatever else names a segment stays. Terms in too few segments of the
    union, or too rare in them, are dropped."""
    keys = list(dict.fromkeys((*segment, "doc_id")))
    union = _all([t.withColumn("doc_id", F.concat_ws(":", F.lit(k), "doc_id")) for k, t in enumerate(tables)])
    if document_min <= 1 and term_min <= 1:
        return union
    # As no segment is in two parts, each is summed under its own id: by part and in whatever partitions by document the part has.
    segments = [dealt(t, parts_of(t), "doc_id").groupBy(*attributes, *keys).agg(F.sum("f").alias("f")).groupBy(*attributes).agg(F.count("*").alias("__d"), F.sum("f").alias("__f")) for t in tables]
    held = _all(segments).groupBy(*attributes).agg(F.sum("__d").alias("__d"), F.sum("__f").alias("__f"))
    often = held.filter((F.col("__d") >= document_min) & (F.col("__f") >= term_min)).select(*attributes)
    return union.join(often, list(attributes), "left_semi")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def other_than(universe: DataFrame, a: DataFrame) -> DataFrame:
    """What the universe has and a lacks; nulls are equal."""
    return universe.subtract(a)
