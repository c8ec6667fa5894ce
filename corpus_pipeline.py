"""From raw documents to packed training sequences: quality rules, near-duplicates, personal data, packing.

Each stage is written as Parquet in the shared folder and read again as the next one's documents. All but the last keep the columns of the
documents, also further ones and such as differ only in case. A row whose doc_id is null has no group of near-duplicates and stays; a row that repeats another's
doc_id and text is a copy and goes; a null or empty text fails the quality rules; texts of any length pass whole; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolex.llm.byte_bpe import default_files
from chronolex.llm.common import forget, place, placed, stored, table
from chronolex.llm.near_dup import near_duplicates
from chronolex.llm.packing import pack_documents
from chronolex.llm.pii import masked_documents
from chronolex.llm.quality import good_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    kept = stored(near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct(), "kept")
    rows, key, text = placed(docs), place(docs, "doc_id"), place(docs, "text")
    whole = rows.select(F.col(key).alias("key"), F.struct(*rows.columns).alias("row"))
    ids = kept.withColumnRenamed("doc_id", "key")
    same = Window.partitionBy("key", F.xxhash64(F.col("row")[text])).orderBy("key")
    one = whole.join(ids, "key", "left_semi").withColumn("copy", F.row_number().over(same)).filter("copy = 1")
    return one.select("row.*").union(rows.filter(F.col(key).isNull())).toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked."""
    return masked_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of training sequences."""
    return pack_documents(docs, *default_files())


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]

#: Reliabilities, near-duplicates and the packing can't be told in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(before)
    return docs
