"""Profiles over a term-by-segment matrix: co-occurrence is being in one segment, counted as the smaller of two counts.

A boolean query is a pair of a term condition and a set of documents; None stands for all."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import querytree as Q
from ..functions.predicates import all_of, dates
from ..functions.text import sliced
from .profiles import Where, every_slice, scored, told
from .relations import dealt


@dataclass(frozen=True)
class Matrix:
    """tdf: attributes, segment columns, doc_id, date, f; docs: doc_id and metadata; parts: the partitions in which it is summed by document (see relations.parts_of)."""

    tdf: DataFrame
    docs: DataFrame
    attributes: tuple[str, ...]
    segment: tuple[str, ...] = ("doc_id",)
    parts: int | None = None

    def by_document(self, rows: DataFrame) -> DataFrame:
        return dealt(rows, self.parts, "doc_id")

    def documents_of(self, terms: Column | None) -> DataFrame:
        """Documents that hold any of the terms."""
        return self.by_document((self.tdf if terms is None else self.tdf.filter(terms)).select("doc_id")).distinct()


@dataclass(frozen=True)
class Query:
    matrix: Matrix
    terms: Column | None = None
    docs: DataFrame | None = None

    def with_(self, other: Query) -> Query:
        """Terms of both conditions."""
        return Query(self.matrix, _both(self.terms, other.terms), _met(self.docs, other.docs))

    def without(self, other: Query) -> Query:
        """Terms of the first condition and not of the second."""
        return Query(self.matrix, _both(self.terms, F.lit(False) if other.terms is None else ~other.terms), self.docs)

    def and_(self, other: Query) -> Query:
        """Terms of either, in documents that hold terms of both."""
        docs = _met(_met(self.docs, other.docs), _met(self.matrix.documents_of(self.terms), self.matrix.documents_of(other.terms)))
        return Query(self.matrix, None if self.terms is None or other.terms is None else self.terms | other.terms, docs)

    def or_(self, other: Query) -> Query:
        docs = None if self.docs is None or other.docs is None else self.docs.union(other.docs).distinct()
        return Query(self.matrix, None if self.terms is None or other.terms is None else self.terms | other.terms, docs)

    def negated(self) -> Query:
        """All other terms; for a query of documents alone, all other documents."""
        if self.terms is None and self.docs is not None:
            return Query(self.matrix, None, self.matrix.by_document(self.matrix.docs.select("doc_id")).join(self.docs, "doc_id", "left_anti"))
        return Query(self.matrix, F.lit(False) if self.terms is None else ~self.terms, self.docs)

    def in_documents(self, where: Where) -> Query:
        """Only in documents whose metadata match."""
        return Query(self.matrix, self.terms, _met(self.docs, self.matrix.by_document(self.matrix.docs.filter(all_of(where)).select("doc_id"))))


def colocated(matrix: Matrix, name: str, buckets: int = 64) -> Matrix:
    """The matrix as tables of the session's catalogue, name_tdf and name_docs, in buckets by document, as many at least: what profiles join and sum by document needs no shuffle then, and as a bucket is a task, large matrices get more. Drop the tables when they aren't asked any more."""
    buckets = max(buckets, matrix.parts or 0)
    spark = matrix.tdf.sparkSession
    for part, table in (("tdf", matrix.tdf), ("docs", matrix.docs)):
        table.repartition(buckets, "doc_id").write.bucketBy(buckets, "doc_id").sortBy("doc_id").format("parquet").saveAsTable(f"{name}_{part}")
    return Matrix(spark.table(f"{name}_tdf"), spark.table(f"{name}_docs"), matrix.attributes, matrix.segment)


def terms(matrix: Matrix, where: Where) -> Query:
    return Query(matrix, all_of(where))


def asked(matrix: Matrix, request: str | Q.Request, default: str | None = None) -> Query:
    """A boolean request over terms and documents: WITH and WITHOUT tell of one term, && of one document, #has of its metadata. default is the attribute of bare words."""
    found = Q.parse(request) if isinstance(request, str) else request
    default = default or matrix.attributes[0]

    def made(tree: Q.Tree) -> Query:
        if isinstance(tree, Q.Pair):
            a, b = made(tree.a), made(tree.b)
            return {"WITH": a.with_, "WITHOUT": a.without, "&&": a.and_, "||": a.or_}[tree.op](b)
        if isinstance(tree, Q.Not):
            return made(tree.a).negated()
        return Query(matrix, tree.condition(F.col, default))

    out = Query(matrix) if found.tree is None else made(found.tree)
    for f in found.filters:
        out = out.in_documents({f.field: f.predicate()})
    return out


def _both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


def _met(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
    return b if a is None else a if b is None else a.join(b, "doc_id", "left_semi")


def tdf_profile(query: Query, group_by: Sequence[str], *, date: str | int | None = None, size: int = 0, having: Where | None = None, name: str = "f", eps: float = 0.0, keys: DataFrame | None = None) -> DataFrame:
    """Items of terms, of metadata, or of both. Items of terms are summed in a segment before the smaller count is taken; items of both take it term by term.
    keys (slice and items) is a set that alone is told, with f12 = 0 where the target doesn't meet an item."""
    m, items = query.matrix, list(group_by)
    by_term, by_meta = [g for g in items if g in m.attributes], [g for g in items if g not in m.attributes]
    segment = list(dict.fromkeys((*m.segment, "doc_id")))
    in_time = dates(date)(F.col("date"))
    slice_ = sliced(F.col("date"), size).alias("slice")
    by_document = m.by_document(m.tdf)
    hit = by_document if query.terms is None else by_document.filter(query.terms)
    if query.docs is not None:
        hit = hit.join(query.docs, "doc_id", "left_semi")
    q = hit.filter(in_time).groupBy(*segment, "date").agg(F.sum("f").alias("q"))
    n = m.tdf.groupBy("date").agg(F.sum("f").alias("n")).groupBy(slice_).agg(F.sum("n").alias("N"))
    f1 = q.groupBy(slice_).agg(F.sum("q").alias("f1"))
    wanted = all_of({k: v for k, v in (having or {}).items() if k in m.attributes})
    meta = m.docs.filter(all_of({k: v for k, v in (having or {}).items() if k not in m.attributes})).select("doc_id", *by_meta)
    meta, everything, dealt_out = m.by_document(meta), m.tdf.filter(wanted), by_document.filter(wanted)
    if by_term and not by_meta:
        grouped = dealt_out.filter(in_time).groupBy(*segment, *by_term).agg(F.sum("f").alias("g"))
        f12 = grouped.join(q, segment).groupBy(slice_, *by_term).agg(F.sum(F.least("q", "g")).alias("f12"))
        f2 = everything.filter(in_time).groupBy(slice_, *by_term).agg(F.sum("f").alias("f2"))
    elif by_meta and not by_term:
        f12 = q.join(meta, "doc_id").groupBy(slice_, *by_meta).agg(F.sum("q").alias("f12"))
        # Sizes of documents by metadata take no notice of the dates asked for.
        f2 = by_document.groupBy("doc_id", "date").agg(F.sum("f").alias("f")).join(meta, "doc_id").groupBy(slice_, *by_meta).agg(F.sum("f").alias("f2"))
    else:
        f12 = dealt_out.filter(in_time).join(q.drop("date"), segment).join(meta, "doc_id").groupBy(slice_, *items).agg(F.sum(F.least("q", "f")).alias("f12"))
        f2 = dealt_out.filter(in_time).join(meta, "doc_id").groupBy(slice_, *items).agg(F.sum("f").alias("f2"))
    if keys is not None:
        f12, f1 = told(keys, f12, items), every_slice(f1, n)
    counts = f12.join(f2, ["slice", *items]).join(f1, "slice").join(n, "slice")
    return scored(counts, name, eps).select("slice", *items, "N", "f1", "f2", "f12", "score")
