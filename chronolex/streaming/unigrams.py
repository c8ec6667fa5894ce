"""Unigram counts by slice as a stream: a slice is a tumbling window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counts(stream: DataFrame, time: str, attributes: Sequence[str], window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, attributes, f; rows later than the watermark are dropped, and a window is told once it is past."""
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    grouped = timed.groupBy(F.window("__t", window).alias("w"), *attributes).agg(F.count("*").alias("f"))
    return grouped.select(F.col("w.start").alias("start"), *attributes, "f")


def count_files(spark: SparkSession, path: str, schema, time: str, attributes: Sequence[str], to: str, checkpoint: str, **how) -> dict[str, int]:
    """Counts the files that path has now and stops; called again, it goes on from its checkpoint with new files only. Tells how many rows were read, and how many
    groups of rows were too late for a window that is told already."""
    stream = spark.readStream.schema(schema).parquet(path)
    query = counts(stream, time, attributes, **how).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(to)
    query.awaitTermination()
    steps = query.recentProgress
    return {"rows": sum(p.numInputRows for p in steps), "late": sum(o.numRowsDroppedByWatermark for p in steps for o in p.stateOperators)}
