"""Building, opening and asking a database: a folder of Parquet tables with a header."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import querytree, requests
from ..functions.predicates import date_bounds
from ..operators import compare, corpus, documents, merge, profiles, relations, trim

_TABLES = ("xf", "cof", "marginal", "tdf", "docs")
#: Small tables that write() adds: the totals of each date, and marginals and unigrams over all dates.
_ROLLUPS = ("totals", "marginal_sums", "xf_sums")


#: Bytes of a row group, small enough for a target's rows to be most of those read.
ROW_GROUP = 4 << 20


@dataclass
class Database:
    attributes: tuple[str, ...]
    xf: DataFrame
    cof: DataFrame
    marginal: DataFrame
    tdf: DataFrame
    docs: DataFrame
    cof_min: int = 2
    totals: DataFrame | None = None
    marginal_sums: DataFrame | None = None
    xf_sums: DataFrame | None = None
    _dated: list | None = field(default=None, repr=False)

    def write(self, path: str) -> None:
        """Tables are dealt and sorted by the first attribute, then the date: a target lies in one or two files and few row groups, and dates are told by the
        row groups' statistics. Totals by date and sums over all dates are written beside them, from the tables as written."""
        first, spark = self.attributes[0], self.xf.sparkSession
        keys = {"xf": first, "cof": f"{first}1", "marginal": first, "tdf": first}
        for name in _TABLES:
            table = getattr(self, name)
            if name in keys:
                table = table.repartitionByRange(keys[name], "date").sortWithinPartitions(keys[name], "date")
            table.write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/{name}")
        made = {n: spark.read.parquet(f"{path}/{n}") for n in keys}
        _totals(made["xf"], made["marginal"], made["tdf"]).coalesce(1).write.parquet(f"{path}/totals")
        for name, value in (("marginal", "f1"), ("xf", "f")):
            sums = made[name].groupBy(*self.attributes).agg(F.sum(value).alias(value))
            sums.repartitionByRange(first).sortWithinPartitions(first).write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/{name}_sums")
        header = self.xf.sparkSession.createDataFrame([(list(self.attributes), self.cof_min)], "attributes array<string>, cof_min int")
        header.coalesce(1).write.json(f"{path}/header")

    def union(self, *others: Database, document_min: int = 0, term_min: int = 0) -> Database:
        """The databases as one; the frequency filters of terms in documents are applied anew to their union."""
        every, a = (self, *others), self.attributes
        pick = lambda name: [getattr(d, name) for d in every]
        docs = [d.withColumn("doc_id", F.concat_ws(":", F.lit(k), "doc_id")) for k, d in enumerate(pick("docs"))]
        joined = docs[0]
        for d in docs[1:]:
            joined = joined.unionByName(d, allowMissingColumns=True)
        return Database(a, merge.union_unigrams(pick("xf"), a), merge.union_cooccurrences(pick("cof"), a, self.cof_min), merge.union_marginals(pick("marginal"), a), merge.union_segments(pick("tdf"), a, document_min=document_min, term_min=term_min), joined, self.cof_min)

    def matrix(self) -> documents.Matrix:
        return documents.Matrix(self.tdf, self.docs, self.attributes)

    def profile(self, relation: str, where, group_by: Sequence[str], *, k: int = -1, least: float | None = None, overall: bool = False, fill: bool = False, date: str | int | None = None, size: int = 1, name: str = "f", eps: float = 0.0, **how) -> DataFrame:
        """relation: xf, cof or tdf (where is then a documents.Query, or a condition on terms). where and group_by may be requests as users type them, also boolean ones; metadata
        conditions of a request, ``doc.NAME=VALUE`` or ``#has[NAME,VALUE]``, restrict a tdf profile's documents."""
        boolean = isinstance(where, str) and querytree.is_boolean(where)
        if boolean:
            tree = querytree.parse(where)
            if relation == "tdf":
                where = documents.asked(self.matrix(), tree, self.attributes[0])
            else:
                if tree.filters:
                    warnings.warn(f"a {relation} profile has no documents: conditions on them are ignored", stacklevel=2)
                where = tree.where(self.attributes[0])
        where, group_by, how["having"] = self.request(where, group_by, how.get("having"))
        if relation != "tdf" and any(a.startswith("doc.") for a in (where if isinstance(where, Mapping) else ())):
            warnings.warn(f"a {relation} profile has no documents: conditions on them are ignored", stacklevel=2)
            where = {a: p for a, p in where.items() if not a.startswith("doc.")}
        how |= {"date": date, "size": size, "name": name, "eps": eps}
        totals = self._totals(relation)
        # Where neither slices nor dates matter, sums over all dates do.
        whole = size == 0 and date is None
        sums = {"xf": self.xf_sums, "cof": None if how.get("one_pass") else self.marginal_sums}.get(relation) if whole else None
        sums = None if sums is None else sums.withColumn("date", F.lit(0))
        if relation == "xf":
            found = profiles.unigram_profile(self.xf if sums is None else sums, where, group_by, totals=totals, **how)
        elif relation == "cof":
            how["one_row"] = sums is not None and set(group_by) == set(self.attributes)
            found = profiles.cof_profile(self.cof, self.marginal if sums is None else sums, where, group_by, totals=totals, **how)
        else:
            query = where
            if not isinstance(where, documents.Query):
                query = documents.terms(self.matrix(), {a: p for a, p in where.items() if not a.startswith("doc.")})
                about = {a.removeprefix("doc."): p for a, p in where.items() if a.startswith("doc.")}
                query = query.in_documents(about) if about else query
            found = documents.tdf_profile(query, group_by, **how)
        if least is not None:
            found = trim.cut_off(found, least)
        if overall and k >= 0:
            found = trim.best_overall(found, group_by, k, name, eps)
        else:
            found = trim.best(found, group_by, k, one_slice=size == 0)
        if fill:
            low, high = date_bounds(date)
            in_time = F.lit(True) if low is None else F.col("date") >= low
            in_time = in_time if high is None else in_time & (F.col("date") <= high)
            table, value = {"xf": (self.xf, "f"), "cof": (self.marginal, "f1")}.get(relation, (self.tdf, "f"))
            dated = relations.totals_by_date(table, value).filter(in_time).select("date")
            sizes = profiles.slice_totals(totals, size).join(profiles._sliced(dated, size).select("slice").distinct(), "slice", "left_semi")
            found = profiles.filled(found, sizes, group_by)
        return found

    def request(self, where, group_by, having=None) -> tuple:
        """where, group_by and having with strings read as requests."""
        if isinstance(where, str):
            where = requests.clauses(where, self.attributes[0])
        if isinstance(group_by, str):
            group_by, more = requests.group_by(group_by)
            having = {**(having or {}), **more} or None
        return where, list(group_by), having

    def _totals(self, relation: str) -> DataFrame | profiles.Totals:
        """A number a date."""
        if self.totals is not None:
            if self._dated is None:
                self._dated = self.totals.collect()
            return profiles.Totals(self.totals.sparkSession, {r["date"]: r["n"] for r in self._dated if r["relation"] == relation and r["date"] is not None})
        table, value = {"xf": (self.xf, "f"), "cof": (self.marginal, "f1")}.get(relation, (self.tdf, "f"))
        return relations.totals_by_date(table, value)

    def extend(self, relation: str, where, group_by: Sequence[str], keys: DataFrame, **how) -> DataFrame:
        """The profile of the slices and items of keys alone, also those that don't co-occur."""
        return self.profile(relation, where, group_by, keys=keys, **how)

    def compare(self, relation: str, a: Mapping, b: Mapping, group_by: Sequence[str], op: str | Callable = "adiff", k: int = -1, *, overall: bool = False, size: int = 0, name: str = "f", eps: float = 0.0, align: bool = False, **both) -> DataFrame:
        """a and b hold each side's where, date and having; what they lack is taken from both."""
        _, group_by, having = self.request({}, group_by, both.pop("having", None))
        both = {**both, "having": having} if having else both
        sides = [self.profile(relation, group_by=group_by, size=side.get("size", size), name=name, eps=eps, **both, **{x: v for x, v in side.items() if x != "size"}) for side in (a, b)]
        if overall:
            return compare.compared_overall(*sides, group_by, op, k, name, eps)
        return compare.compared(*sides, group_by, op, k, align=align)

    def export(self, path: str) -> None:
        """All tables as tab-separated text with headers, a folder each."""
        for name in _TABLES:
            table = getattr(self, name)
            flat = table.select(*(F.to_json(F.struct(c)).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in table.dtypes))
            flat.write.option("sep", "\t").option("header", True).csv(f"{path}/{name}")

    def info(self) -> DataFrame:
        """Rows, dates and counts of each table."""
        out = None
        for name, value in (("xf", "f"), ("cof", "f12"), ("marginal", "f1"), ("tdf", "f")):
            t = getattr(self, name)
            row = t.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum(value).alias("total"))
            row = row.select("name", "n_rows", "first", "last", "total")
            out = row if out is None else out.unionByName(row)
        return out


def _totals(xf: DataFrame, marginal: DataFrame, tdf: DataFrame) -> DataFrame:
    """relation, date, n."""
    out = None
    for name, table, value in (("xf", xf, "f"), ("cof", marginal, "f1"), ("tdf", tdf, "f")):
        part = relations.totals_by_date(table, value).select(F.lit(name).alias("relation"), "date", "n")
        out = part if out is None else out.unionByName(part)
    return out


def create(tokens: DataFrame, docs: DataFrame, attributes: Sequence[str] = ("l",), *, distance: int = 5, tuple_min: int = 2, minimum: Mapping[str, int] | None = None, cof_min: int = 2, segment_least: int = 4, document_min: int = 4, order: Sequence[str] = ("pos",)) -> Database:
    """Filters tokens by frequency and writes them once, then counts unigrams, pairs, marginals and segments of these."""
    kept = relations.written(corpus.frequent(tokens, attributes, tuple_min, minimum))
    blocks = relations.windows(kept, attributes, distance, order=order)
    return Database(
        tuple(attributes), relations.unigrams(kept, attributes), relations.thresholded(relations.cooccurrences_of(blocks, attributes, distance), cof_min),
        relations.marginals_of(blocks, attributes, distance),
        relations.term_segments(kept, attributes, least=segment_least, document_min=document_min), docs, cof_min,
    )


def open_database(spark: SparkSession, *paths: str) -> Database:
    """One folder, or several as their union."""
    found = []
    for path in paths:
        header = spark.read.json(f"{path}/header").first()
        rollups = {t: spark.read.parquet(f"{path}/{t}") for t in _ROLLUPS}
        found.append(Database(tuple(header["attributes"]), *(spark.read.parquet(f"{path}/{t}") for t in _TABLES), cof_min=header["cof_min"], **rollups))
    return found[0] if len(found) == 1 else found[0].union(*found[1:])


def link_template(where: Mapping[str, str], group_by: Sequence[str], date: str | None = None) -> str:
    """A concordance query for one row of a profile, with places for its items: ``{attribute}``."""
    target = " WITH ".join(f"${a}={v}" for a, v in where.items())
    item = " WITH ".join(f"${a}={{{a}}}" for a in group_by)
    return f"near({target} , {item})" + (f" #date[{date}]" if date else "")
