"""Profiles: which items go with a target, by slice of time, with counts N, f1, f2, f12 and a score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import Predicate, all_of, dates
from ..functions.scores import score
from ..functions.text import sliced
from .relations import written

Where = Mapping[str, "str | Sequence[str] | Predicate"]


@dataclass(frozen=True)
class Totals:
    """Totals by date that are known on the driver, a number a date; what is made of them is a part of the plan and not a job."""

    spark: SparkSession
    by_date: Mapping[int, int]


def _sliced(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("slice", sliced(F.col("date"), size))


def slice_totals(totals: DataFrame | Totals, size: int) -> DataFrame:
    """slice, N: from date, n. No date request restricts it."""
    if isinstance(totals, Totals):
        n: dict[int, int] = {}
        for date, x in totals.by_date.items():
            at = date // size * size if size else 0
            n[at] = n.get(at, 0) + x
        rows = ", ".join(f"({at}, {x}L)" for at, x in sorted(n.items())) or "(0, 0L)"
        return totals.spark.sql(f"SELECT slice, N FROM VALUES {rows} AS t(slice, N)" + ("" if n else " WHERE false"))
    return _sliced(totals, size).groupBy("slice").agg(F.sum("n").alias("N"))


def scored(counts: DataFrame, name: str, eps: float = 0.0) -> DataFrame:
    return counts.withColumn("score", score(name, F.col("N"), F.col("f1"), F.col("f2"), F.col("f12"), eps))


def _assembled(f12: DataFrame, f2: DataFrame | None, f1: DataFrame, n: DataFrame, items: Sequence[str], name: str, eps: float) -> DataFrame:
    """f1 and n have a row a slice, of which there are as many as dates at most, so Catalyst broadcasts them by their size."""
    counts = f12 if f2 is None else f12.join(f2, ["slice", *items])
    counts = counts.join(f1, "slice").join(n, "slice")
    return scored(counts, name, eps).select("slice", *items, "N", "f1", "f2", "f12", "score")


def unigram_profile(xf: DataFrame, where: Where | None, group_by: Sequence[str], *, date: str | int | None = None, size: int = 1, having: Where | None = None, name: str = "f", eps: float = 0.0, keys: DataFrame | None = None, totals: DataFrame | Totals | None = None) -> DataFrame:
    """Targets profile themselves: f12 = f2 = the item's own count; N counts tokens. keys (slice and group_by) is a set that alone is told, with f12 = 0 where the
    target doesn't take an item in, and f2 the item's count all the same. totals (date, n) spares the sums of N."""
    in_time, items = dates(date)(F.col("date")), list(group_by)
    n = slice_totals(xf.groupBy("date").agg(F.sum("f").alias("n")) if totals is None else totals, size)
    hits = _sliced(xf.filter(all_of(where) & in_time), size)
    f1 = hits.groupBy("slice").agg(F.sum("f").alias("f1"))
    own = hits.filter(all_of(having)).groupBy("slice", *items).agg(F.sum("f").alias("f12"))
    if keys is None:
        return _assembled(own.withColumn("f2", F.col("f12")), None, f1, n, items, name, eps)
    f2 = _sliced(xf.filter(all_of(having) & in_time), size).groupBy("slice", *items).agg(F.sum("f").alias("f2"))
    return _assembled(told(keys, own, items), f2, every_slice(f1, n), n, items, name, eps)


def told(keys: DataFrame, f12: DataFrame, items: Sequence[str]) -> DataFrame:
    """f12 for the slices and items of keys alone, 0 where it lacks one."""
    return keys.select("slice", *items).distinct().join(f12, ["slice", *items], "left").fillna(0, ["f12"])


def every_slice(f1: DataFrame, n: DataFrame) -> DataFrame:
    return n.select("slice").join(f1, "slice", "left").fillna(0, ["f1"])


def cof_profile(
    cof: DataFrame, marginal: DataFrame, where: Where, group_by: Sequence[str], *, date: str | int | None = None, size: int = 1, having: Where | None = None,
    name: str = "f", eps: float = 0.0, one_pass: bool = False, keys: DataFrame | None = None, totals: DataFrame | Totals | None = None,
    one_row: bool = False,
) -> DataFrame:
    """Items that co-occur with the target. having restricts items, in f12 and f2, and leaves f1 alone; keys (slice and group_by) is a set that alone is told, with
    f12 = 0 where it doesn't co-occur; totals (date, n) spares the sums of N, and one_row says that marginal has one
    row an item and slice. f2 sums the marginals of all tuples that give an item, or, one_pass, of those that co-occur with the target."""
    in_time = dates(date)(F.col("date"))
    items = list(group_by)
    n = slice_totals(marginal.groupBy("date").agg(F.sum("f1").alias("n")) if totals is None else totals, size)
    f1 = _sliced(marginal.filter(all_of(where) & in_time), size).groupBy("slice").agg(F.sum("f1").alias("f1"))
    hits = _sliced(cof.filter(all_of(where, lambda a: f"{a}1") & all_of(having, lambda a: f"{a}2") & in_time), size)
    renamed = [F.col(f"{a}2").alias(a) for a in items]
    f12 = hits.groupBy("slice", *renamed).agg(F.sum("f12").alias("f12"))
    if keys is not None:
        f12 = told(keys, f12, items)
    sums = marginal.filter(all_of(having) & in_time)
    if one_pass:
        attributes = [c for c in marginal.columns if c not in ("date", "f1")]
        sums = sums.join(hits.select(*(F.col(f"{a}2").alias(a) for a in attributes), "date").distinct(), [*attributes, "date"], "left_semi")
    # The marginals are summed by item before they meet the items that were found.
    cut = _sliced(sums, size)
    f2 = cut.select("slice", *items, F.col("f1").alias("f2")) if one_row else cut.groupBy("slice", *items).agg(F.sum("f1").alias("f2"))
    if keys is not None:
        f1 = every_slice(f1, n)
    return _assembled(f12, f2, f1, n, items, name, eps)


def rollup_profile(
    cof: DataFrame, marginal: DataFrame, where: Where, group_by: Sequence[str], sizes: Sequence[int], *, date: str | int | None = None, having: Where | None = None, name: str = "f", eps: float = 0.0,
) -> DataFrame:
    """cof_profile for several sizes of slices at once, told apart by the column size: each table is read once, and all levels are grouping sets of the same rows. The marginals of all
    levels are written once, as N, f1 and f2 are all read from them."""
    items, sizes, in_time = list(group_by), list(dict.fromkeys(sizes)), dates(date)(F.col("date"))
    levels = [f"__slice{k}" for k in sizes]

    def leveled(rows: DataFrame, *sets: Sequence[str], **sums: Column) -> DataFrame:
        """Sums by level and each of sets, with size, slice and by, which tells the set (0 for the first)."""
        cut = rows.withColumns({x: sliced(F.col("date"), k) for x, k in zip(levels, sizes, strict=True)})
        keys = list(dict.fromkeys(i for s in sets for i in s))
        is_in = lambda c: F.grouping(c) == 0
        size = F.coalesce(*(F.when(is_in(x), F.lit(k)) for x, k in zip(levels, sizes, strict=True)))
        slice_ = F.coalesce(*(F.when(is_in(x), F.col(x)) for x in levels))
        by = F.when(is_in(keys[0]), F.lit(0)).otherwise(F.lit(1)) if len(sets) > 1 else F.lit(0)
        groups = [[x, *s] for x in levels for s in sets]
        found = cut.groupingSets([[F.col(c) for c in g] for g in groups], *(F.col(c) for c in [*levels, *keys])).agg(*(c.alias(n) for n, c in sums.items()), size.alias("size"), slice_.alias("slice"), by.alias("by"))
        return found.select("size", "slice", "by", *keys, *sums)

    hits = cof.filter(all_of(where, lambda a: f"{a}1") & all_of(having, lambda a: f"{a}2") & in_time).select("date", "f12", *(F.col(f"{a}2").alias(a) for a in items))
    f12 = leveled(hits, items, f12=F.sum("f12")).drop("by")
    part = lambda cond: F.coalesce(F.sum(F.when(cond & in_time, F.col("f1"))), F.lit(0).cast("long"))
    sums = written(leveled(marginal, items, [], N=F.sum("f1"), f1=part(all_of(where)), f2=part(all_of(having))))
    f2 = sums.filter("by = 0").select("size", "slice", *items, "f2")
    n = sums.filter("by = 1 and f1 > 0").select("size", "slice", "N", "f1")
    counts = f12.join(f2, ["size", "slice", *items]).join(n, ["size", "slice"])
    return scored(counts, name, eps).select("size", "slice", *items, "N", "f1", "f2", "f12", "score")


def near_profile(
    found: DataFrame, tokens: DataFrame, where: Where, group_by: Sequence[str], *, size: int = 0, distance: int = 5, adjacent: bool = False, minimum: int = 1,
    name: str = "f", eps: float = 0.0, having: Where | None = None,
) -> DataFrame:
    """Counts of joint hits of a target and any token within distance, as a concordance service counts them: the threshold is applied after grouping,
    f2 and N are token counts times the coefficient of the query, and f1 the target's tokens times it. adjacent: the item follows the target at once."""
    items = list(group_by)
    fcoef = 1 if adjacent else 2 * distance
    gap = F.col("gap") == 1 if adjacent else F.abs("gap") <= distance
    hits = _sliced(found.filter(all_of(where, lambda a: f"{a}1") & all_of(having, lambda a: f"{a}2") & gap), size)
    f12 = hits.groupBy("slice", *(F.col(f"{a}2").alias(a) for a in items)).agg(F.count("*").alias("f12")).filter(F.col("f12") >= minimum)
    return _token_counts(f12, tokens, where, items, size, fcoef, name, eps)


#: Tokens that a gap without an upper bound may have.
FARTHEST = 32


def sequence_profile(
    found: DataFrame, tokens: DataFrame, where: Where, group_by: Sequence[str], *, size: int = 0, op: str = "<", between: int = 0, item: int = 2, minimum: int = 1,
    name: str = "f", eps: float = 0.0, having: Where | None = None,
) -> DataFrame:
    """As near_profile, for two tokens in order with some others between them: between at most ("<"), or more than between and at most FARTHEST (">"). item says
    which of the two is told, the second (the target comes first) or the first. found must reach as far as the gap does."""
    items = list(group_by)
    low, high = (1, between + 1) if op == "<" else (between + 2, FARTHEST)
    gap = F.col("gap") if item == 2 else -F.col("gap")
    fcoef = high - low + 1
    hits = _sliced(found.filter(all_of(where, lambda a: f"{a}1") & all_of(having, lambda a: f"{a}2") & gap.between(low, high)), size)
    f12 = hits.groupBy("slice", *(F.col(f"{a}2").alias(a) for a in items)).agg(F.count("*").alias("f12")).filter(F.col("f12") >= minimum)
    return _token_counts(f12, tokens, where, items, size, fcoef, name, eps)


def _token_counts(f12: DataFrame, tokens: DataFrame, where: Where, items: list[str], size: int, fcoef: int, name: str, eps: float) -> DataFrame:
    """f12 with f1, f2 and N as counts of tokens times the coefficient of the query."""
    cut = _sliced(tokens, size)
    f2 = cut.groupBy("slice", *items).agg((fcoef * F.count("*")).alias("f2"))
    f1 = cut.filter(all_of(where)).groupBy("slice").agg((fcoef * F.count("*")).alias("f1"))
    n = cut.groupBy("slice").agg((fcoef * F.count("*")).alias("N"))
    counts = f12.join(f2, ["slice", *items]).join(f1, "slice").join(n, "slice").withColumn("N", F.greatest("N", "f1"))
    return scored(counts, name, eps).select("slice", *items, "N", "f1", "f2", "f12", "score")


def filled(profile: DataFrame, sizes: DataFrame, items: Sequence[str]) -> DataFrame:
    """profile with a row of nulls and f12 = 0 for each slice of sizes (slice, N) that it lacks."""
    missing = sizes.join(profile.select("slice").distinct(), "slice", "left_anti")
    return profile.unionByName(missing.select("slice", "N", F.lit(0).cast("long").alias("f1"), F.lit(0).cast("long").alias("f2"), F.lit(0).cast("long").alias("f12")), allowMissingColumns=True)


def requested(profile: DataFrame, items: Sequence[str]) -> DataFrame:
    """slice and items of a profile, as keys of another."""
    return profile.select("slice", *items).distinct()


def missing_keys(shards: Mapping[str, DataFrame], items: Sequence[str]) -> DataFrame:
    """shard, slice and items that some shard has and this one lacks, to be asked for by extending its profile."""
    held = None
    for shard, profile in shards.items():
        part = requested(profile, items).withColumn("shard", F.lit(shard))
        held = part if held is None else held.unionByName(part)
    names = held.sparkSession.createDataFrame([(s,) for s in shards], "shard string")
    every = held.select("slice", *items).distinct().join(F.broadcast(names))  # a row a shard
    return every.join(held, ["shard", "slice", *items], "left_anti")


def summed(profiles: Sequence[DataFrame], items: Sequence[str], name: str = "f", eps: float = 0.0, one_n: bool = False) -> DataFrame:
    """Profiles of shards as one: all counts add up. Each must tell the items that any tells (see missing_keys and keys of cof_profile), or their f2 falls short. one_n: all have the same N, which isn't summed."""
    counts = totals = None
    for k, p in enumerate(profiles):
        a = p.select("slice", *items, "f2", "f12")
        b = p.select("slice", "N", "f1").distinct().withColumn("shard", F.lit(k))
        counts, totals = (a, b) if counts is None else (counts.unionByName(a), totals.unionByName(b))
    by_item = counts.groupBy("slice", *items).agg(F.sum("f2").alias("f2"), F.sum("f12").alias("f12"))
    by_slice = totals.groupBy("slice").agg((F.max("N") if one_n else F.sum("N")).alias("N"), F.sum("f1").alias("f1"))
    return scored(by_item.join(by_slice, "slice"), name, eps).select("slice", *items, "N", "f1", "f2", "f12", "score")


def over_slices(profile: DataFrame, items: Sequence[str], name: str = "f", eps: float = 0.0) -> DataFrame:
    """All slices as one, 0."""
    by_item = profile.groupBy(*items).agg(F.sum("f2").alias("f2"), F.sum("f12").alias("f12"))
    by_slice = profile.select("slice", "N", "f1").distinct().agg(F.sum("N").alias("N"), F.sum("f1").alias("f1"))
    one = by_item.join(F.broadcast(by_slice))  # one row
    return scored(one, name, eps).select(F.lit(0).alias("slice"), *items, "N", "f1", "f2", "f12", "score")


def rank_value(column: str = "score") -> Column:
    """A score for ranking: null counts as 0."""
    return F.coalesce(F.col(column), F.lit(0.0))
