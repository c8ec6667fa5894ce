"""Writers of results and aggregates: tab-separated text, JSON, HTML, coordinate lists; and readers of the text forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escaped, item_key, title

PROFILE = ("N", "f1", "f2", "f12", "score")
DIFF = ("a_N", "b_N", "a_f1", "b_f1", "a_f2", "b_f2", "a_f12", "b_f12", "a_score", "b_score", "diff")


def ordered(profile: DataFrame, score: str = "score") -> DataFrame:
    return profile.orderBy("slice", F.coalesce(F.col(score), F.lit(0.0)).desc(), *(c for c in profile.columns if c not in (*PROFILE, *DIFF, "slice")))


def as_rows(profile: DataFrame, items: Sequence[str]) -> DataFrame:
    """Counts, score, slice and items in the order of the text form."""
    numbers = DIFF if "diff" in profile.columns else PROFILE
    return ordered(profile, numbers[-1]).select(*numbers, F.col("slice").alias("label"), *items)


def write_text(profile: DataFrame, items: Sequence[str], path: str, header: bool = False) -> None:
    as_rows(profile, items).write.option("sep", "\t").option("header", header).csv(path)


def as_json(profile: DataFrame, items: Sequence[str]) -> DataFrame:
    """A JSON object a slice with its counts and its items; a slice's items are a report's, trimmed before."""
    numbers = DIFF[-1:] if "diff" in profile.columns else ("f2", "f12", "score")
    each = F.struct(item_key(*items).alias("item"), *numbers)
    grouped = profile.groupBy("slice").agg(F.array_sort(F.collect_list(each)).alias("items"))
    return grouped.select("slice", F.to_json(F.struct("slice", "items")).alias("json"))


def as_html(profile: DataFrame, items: Sequence[str], rows: int = 1000) -> str:
    """A table of a report, which is trimmed before: with more rows than these, an error."""
    numbers = DIFF if "diff" in profile.columns else PROFILE
    if len(profile.limit(rows + 1).collect()) > rows:
        raise ValueError(f"a report of more than {rows} rows: trim it, or write it as text")
    names = [*numbers, "slice", *items]
    head = "".join(f"<th>{escaped(title(n) if n in items else n)}</th>" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{escaped(r[n])}</td>" for n in names) + "</tr>\n" for r in ordered(profile, numbers[-1]).limit(rows).collect())
    return f"<table>\n<tr>{head}</tr>\n{body}</table>\n"


def write_unigrams(xf: DataFrame, attributes: Sequence[str], path: str) -> None:
    xf.select("f", *attributes, "date").write.option("sep", "\t").csv(path)


def read_unigrams(spark: SparkSession, path: str, attributes: Sequence[str]) -> DataFrame:
    schema = ", ".join(("f long", *(f"{a} string" for a in attributes), "date int"))
    return spark.read.schema(schema).option("sep", "\t").csv(path).fillna("", list(attributes)).select(*attributes, "date", "f")


def write_cooccurrences(cof: DataFrame, marginal: DataFrame, attributes: Sequence[str], path: str) -> None:
    """Pairs, and for each first item and date what its pairs leave of the marginal, with empty second items."""
    left, right = [f"{a}1" for a in attributes], [f"{a}2" for a in attributes]
    held = cof.groupBy(*left, "date").agg(F.sum("f12").alias("held"))
    named = marginal.select(*(F.col(a).alias(f"{a}1") for a in attributes), "date", "f1")
    rest = named.join(held, [*left, "date"], "left").select((F.col("f1") - F.coalesce("held", F.lit(0))).alias("f12"), *left, "date", *(F.lit(None).cast("string").alias(r) for r in right)).filter("f12 > 0")
    cof.select("f12", *left, "date", *right).unionByName(rest).write.option("sep", "\t").option("nullValue", r"\N").option("emptyValue", "").csv(path)


def read_cooccurrences(spark: SparkSession, path: str, attributes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Pairs and marginals of the text form."""
    left, right = [f"{a}1" for a in attributes], [f"{a}2" for a in attributes]
    schema = ", ".join(("f12 long", *(f"{a} string" for a in left), "date int", *(f"{a} string" for a in right)))
    rows = spark.read.schema(schema).option("sep", "\t").option("nullValue", r"\N").option("emptyValue", "").csv(path)
    paired = F.lit(True)
    for r in right:
        paired = paired & F.col(r).isNotNull()
    marginal = rows.groupBy(*(F.col(a).alias(b) for a, b in zip(left, attributes, strict=True)), "date").agg(F.sum("f12").alias("f1"))
    return rows.filter(paired).select(*left, "date", *right, "f12"), marginal


def write_matrix(tdf: DataFrame, attributes: Sequence[str], path: str, segment: Sequence[str] = ("doc_id",)) -> None:
    """The matrix as coordinates with strings, and beside it a header: how many terms, segments and entries it has."""
    entries = as_coordinates(tdf, attributes, segment)
    entries.write.option("sep", "\t").csv(f"{path}/entries")
    header = tdf.sparkSession.read.option("sep", "\t").schema("term string, segment string, f long").csv(f"{path}/entries")
    header.agg(F.countDistinct("term").alias("terms"), F.countDistinct("segment").alias("segments"), F.count("*").alias("entries")).coalesce(1).write.option("header", True).option("sep", "\t").csv(f"{path}/header")


def as_coordinates(tdf: DataFrame, attributes: Sequence[str], segment: Sequence[str] = ("doc_id",)) -> DataFrame:
    """term, segment, f: the matrix as a list."""
    return tdf.select(item_key(*attributes).alias("term"), F.concat_ws(":", *segment).alias("segment"), "f")
