"""Token tables: segmentation and filters.

A token table has doc_id, sent_id, pos (its order), date and one column an attribute. Filters come before pairs are made, so windows
close over what is dropped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.predicates import java_regex

def segments(marks: DataFrame, is_break: Column, by: Sequence[str] = ("doc_id",), order: str = "pos", name: str = "sent_id") -> DataFrame:
    """marks without its break rows, with the number of breaks before each row as name."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumns({name: F.sum(is_break.cast("int")).over(before), "__break": is_break}).filter("not __break").drop("__break")


def filled_forward(tokens: DataFrame, column: str, by: Sequence[str] = ("doc_id",), order: str = "pos") -> DataFrame:
    """column with nulls replaced by the last value before them, as page numbers are."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn(column, F.last(column, ignorenulls=True).over(before))


def matching(tokens: DataFrame, good: Mapping[str, str] | None = None, bad: Mapping[str, str] | None = None) -> DataFrame:
    """Tokens whose attributes match all good patterns and no bad one; a null counts as the empty string."""
    keep = F.lit(True)
    for a, pattern in (good or {}).items():
        keep = keep & F.coalesce(F.col(a), F.lit("")).rlike(java_regex(pattern))
    for a, pattern in (bad or {}).items():
        keep = keep & ~F.coalesce(F.col(a), F.lit("")).rlike(java_regex(pattern))
    return tokens.filter(keep)


def listed(tokens: DataFrame, attribute: str, values: DataFrame | Sequence[str], keep: bool = True) -> DataFrame:
    """Tokens whose attribute is in a list (keep), or isn't. A list in Python is a condition if it is short; a DataFrame of one column is joined."""
    if not isinstance(values, DataFrame):
        if len(values) <= 1000:
            inside = F.col(attribute).isin(list(values))
            return tokens.filter(inside if keep else ~inside | F.col(attribute).isNull())
        values = tokens.sparkSession.createDataFrame([(v,) for v in values], "value string")
    found = values.select(F.col(values.columns[0]).alias(attribute)).distinct()
    return tokens.join(found, attribute, "left_semi" if keep else "left_anti")


def list_file(spark, path: str) -> DataFrame:
    """The values of a file, one a line; what follows a number sign at a line's start is a comment."""
    return spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.trim("value").alias("value"))


def frequent(tokens: DataFrame, attributes: Sequence[str], tuple_min: int = 2, minimum: Mapping[str, int] | None = None) -> DataFrame:
    """Tokens whose attribute values and whose whole tuples are frequent enough. Tuples are counted before any value is dropped, over all dates.

    A value's count is the sum over its tuples, so both filters come from one count of tuples, and one join brings them to the tokens."""
    minimum = {a: (minimum or {}).get(a, tuple_min) for a in attributes}
    if tuple_min <= 1 and all(n <= 1 for n in minimum.values()):
        return tokens
    tuples = tokens.groupBy(*attributes).agg(F.count("*").alias("__n"))
    kept = tuples.filter(F.col("__n") >= tuple_min)
    for a, n in minimum.items():
        if n > 1 and len(attributes) > 1:
            often = tuples.groupBy(a).agg(F.sum("__n").alias("__a")).filter(F.col("__a") >= n).select(a)
            kept = kept.join(often, a, "left_semi")
        elif n > 1:
            kept = kept.filter(F.col("__n") >= n)
    return tokens.join(kept.select(*attributes), list(attributes), "left_semi")


def sample(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows, the same ones for the same seed, whatever the partitions: those whose keys have the smallest digests with it."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key))), *key).limit(n)


def metadata(docs: DataFrame, good: str | None = None, bad: str | None = None, key: str = "doc_id") -> DataFrame:
    """docs with the metadata columns alone whose names match good and not bad."""
    import re

    names = [c for c in docs.columns if c != key and (good is None or re.search(good, c)) and not (bad and re.search(bad, c))]
    return docs.select(key, *names)


def targets(xf: DataFrame, where: Column, attributes: Sequence[str], most: int = 65_535) -> DataFrame:
    """The distinct tuples that a condition takes in, the first ones in order if they are more than most, an option for reports; profiles take all in."""
    return xf.filter(where).select(*attributes).distinct().orderBy(*attributes).limit(most)


def counted_by(tokens: DataFrame, keys: Mapping[str, Column], least: int = 1) -> DataFrame:
    """Counts by any expressions, such as parts of attributes, of which the frequent ones are told."""
    return tokens.groupBy(*(c.alias(n) for n, c in keys.items())).agg(F.count("*").alias("f")).filter(F.col("f") >= least)
