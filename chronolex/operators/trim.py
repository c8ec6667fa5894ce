"""Trimming of profiles: the best k of each slice or of all slices, cut-offs, and sets of items to keep or drop. Ties go by item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .profiles import over_slices, rank_value
from .relations import written


def best(profile: DataFrame, items: Sequence[str], k: int, *, score: str = "score", absolute: bool = False, one_slice: bool = False) -> DataFrame:
    """The k best of each slice; all for k < 0. one_slice says that there is one slice alone, which needs no shuffle to rank."""
    if k < 0:
        return profile
    value = F.abs(rank_value(score)) if absolute else rank_value(score)
    if one_slice:
        return profile.orderBy(value.desc(), *items).limit(k)
    order = Window.partitionBy("slice").orderBy(value.desc(), *items)
    return profile.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= k).drop("__rank")


def best_overall(profile: DataFrame, items: Sequence[str], k: int, name: str = "f", eps: float = 0.0) -> DataFrame:
    """The items that are best with all slices as one, in every slice; f12 = 0 where a slice lacks one."""
    profile = written(profile)  # it is read three times
    top = over_slices(profile, items, name, eps).orderBy(rank_value().desc(), *items).limit(k).select(*items)
    sizes = profile.select("slice", "N", "f1").distinct()
    grid = F.broadcast(top).join(sizes)  # k rows by a row a slice
    out = grid.join(profile.drop("N", "f1"), ["slice", *items], "left").fillna(0, ["f2", "f12"]).fillna(0.0, ["score"])
    return out.select("slice", *items, "N", "f1", "f2", "f12", "score")


def cut_off(profile: DataFrame, least: float, score: str = "score") -> DataFrame:
    return profile.filter(rank_value(score) >= least)


def marked(profile: DataFrame, items: Sequence[str], k: int) -> DataFrame:
    """profile with good, whether an item is among the k best of its slice."""
    order = Window.partitionBy("slice").orderBy(rank_value().desc(), *items)
    return profile.withColumn("good", F.row_number().over(order) <= k)


def kept(profile: DataFrame, keys: DataFrame, items: Sequence[str]) -> DataFrame:
    """Only the items of keys; those that a slice lacks have zero counts."""
    sizes = profile.select("slice", "N", "f1").distinct()
    grid = keys.select(*items).distinct().join(F.broadcast(sizes))  # a row a slice
    out = grid.join(profile.drop("N", "f1"), ["slice", *items], "left").fillna(0, ["f2", "f12"]).fillna(0.0, ["score"])
    return out.select("slice", *items, "N", "f1", "f2", "f12", "score")


def dropped(profile: DataFrame, keys: DataFrame, items: Sequence[str]) -> DataFrame:
    return profile.join(keys.select(*items).distinct(), list(items), "left_anti")


def without_empty_slices(profile: DataFrame) -> DataFrame:
    return profile.filter((F.col("f1") > 0) & F.col("f12").isNotNull())
