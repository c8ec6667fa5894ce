"""Token tables from the test tables. Dates that the tables lack are made from ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relations import dealt, parts_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files make fewer partitions; where files abound nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _runs(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def _class(run: Column) -> Column:
    size = F.length(run)
    return F.when(size <= 3, "short").when(size <= 7, "middle").otherwise("long")


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of letters of documents, in lower case; a document is a sentence. p is a class by length."""
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = docs.select("doc_id", (1900 + F.col("doc_id") % 100).cast("int").alias("date"), F.posexplode(_runs("text")).alias("pos", "l"))
    return words.select("doc_id", F.lit(0).alias("sent_id"), "pos", "date", "l", _class(F.col("l")).alias("p"))


def text_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of text_tokens, a row each: date, and tokens, an array of l."""
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select((1900 + F.col("doc_id") % 100).cast("int").alias("date"), F.transform(_runs("text"), lambda w: F.struct(w.alias("l"))).alias("tokens"))


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", "source")


def basket_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of orders: an order is a document and a sentence, dated by its year."""
    lines, orders, parts = (_table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    n = parts_of(lines)
    # The order comes last, so that what is summed by document stays in the partitions of this join.
    named = dealt(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), n, "l_orderkey")
    joined = named.join(dealt(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pos = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    return joined.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("sent_id"), pos.alias("pos"), F.year("o_orderdate").alias("date"), F.col("p_name").alias("w"), F.col("p_type").alias("p"), F.col("p_brand").alias("l"))


def basket_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers, nations = (_table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("o_orderkey").alias("doc_id"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), F.col("n_name").alias("nation"))


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of a user's day: a user is a document, a day a sentence, dated by the day of the year."""
    events = _table(spark, sf_dir, "events")
    pos = F.struct("ts", "event_id")
    return events.select(F.col("user_id").alias("doc_id"), F.dayofyear("ts").alias("sent_id"), pos.alias("pos"), F.dayofyear("ts").alias("date"), F.col("event_type").alias("l"))


def chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations with the speaker's role; a turn is a sentence."""
    chats = _table(spark, sf_dir, "conversations")
    words = chats.select("conv_id", "turn", "role", F.posexplode(_runs("text")).alias("pos", "l"))
    return words.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_id"), "pos", (1900 + F.col("conv_id") % 50).cast("int").alias("date"), "l", F.col("role").alias("p"))
