"""Joins and sums by ids are dealt by rows, so what one task holds doesn't grow with the tables."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronolex import catalogue
from chronolex.operators import documents, merge, relations
from chronolex.sources import adapters

DATA = "/root/testdata/sf0.001"
ATTRS = ("l", "p")


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(relations, "TASK_ROWS", 250, raising=False)


def rows(df):
    return Counter(map(tuple, df.collect()))


def most_of_a_task(df):
    return df.groupBy(F.spark_partition_id().alias("k")).count().agg(F.max("count")).first()[0]


def test_tokens_of_baskets_are_dealt_by_rows(spark, few):
    tokens = adapters.basket_tokens(spark, DATA)
    assert tokens.count() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert most_of_a_task(tokens) < 4 * 250


def test_segments_are_summed_in_bounded_tasks(spark, few):
    made = relations.term_segments(adapters.basket_tokens(spark, DATA), ATTRS, least=1, document_min=4).select(*ATTRS, "doc_id", "date", "f")
    matrix = documents.Matrix(made, adapters.basket_docs(spark, DATA), ATTRS, parts=relations.parts_of(made))
    assert matrix.parts > 4 and most_of_a_task(matrix.by_document(made)) < 4 * 250
    name = "buckets_by_rows"
    held = documents.colocated(matrix, name, 2)
    try:
        told = spark.sql(f"DESCRIBE EXTENDED {name}_tdf").filter("col_name = 'Num Buckets'").first()["data_type"]
        assert int(told) == matrix.parts
        assert rows(held.tdf) == rows(made)
    finally:
        for part in ("tdf", "docs"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")


@pytest.mark.parametrize("name", ["set_union", "union_tdf", "tdf_matrix_B", "tdf_and", "tdf_negated", "tdf_meta_B", "tdf_mixed_B", "request_bool_documents", "tdf_colocated_B"])
def test_dealt_queries_give_the_same_rows(spark, few, monkeypatch, name):
    dealt = rows(catalogue.queries()[name](spark, DATA))
    monkeypatch.setattr(relations, "TASK_ROWS", 1 << 40)
    assert dealt == rows(catalogue.queries()[name](spark, DATA))


BY_DOCUMENT = re.compile(r"Exchange hashpartitioning\((?:doc_id|sent_id|o_orderkey|l_orderkey)#[^)]*, (\d+)\)")


@pytest.mark.parametrize("name", ["request_bool_documents", "request_bool_has", "request_bool_negated", "request_bool_without", "tdf_and", "tdf_having_B", "tdf_meta_B", "tdf_meta_filter", "tdf_negated", "tdf_or", "tdf_terms_B"])
def test_no_step_by_document_is_dealt_by_bytes(spark, few, capsys, name):
    catalogue.queries()[name](spark, DATA).explain()
    made = [int(n) for n in BY_DOCUMENT.findall(capsys.readouterr().out)]
    # More than the four partitions that the session's shuffles have.
    assert made and min(made) > 4


def test_union_counts_a_segment_of_several_dates_once(spark, few):
    schema = "l string, doc_id long, date int, f long"
    tables = [spark.createDataFrame([("a", d, y, 1) for d in range(3) for y in (1990, 1991)] + [("b", 0, 1990, 9)], schema), spark.createDataFrame([("b", d, 1990, 1) for d in range(4)], schema)]
    found = merge.union_segments(tables, ("l",), document_min=4)
    assert rows(found) == Counter([("b", "0:0", 1990, 9), *(("b", f"1:{d}", 1990, 1) for d in range(4))])
