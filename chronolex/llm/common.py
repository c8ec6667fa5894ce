"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Python step looks at together; bounds a worker's memory.
ROWS_AT_ONCE = 256

#: White space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all runs on this machine; a cluster must name one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("chronolex.scratch.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="chronolex-")
            spark.conf.set("chronolex.scratch.dir", found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/chronolex-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.chronolex_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table made by stored() that nothing reads any more."""
    path = getattr(df, "chronolex_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on: names that clash, differ only in case or hold dots do no harm."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def place(df: DataFrame, name: str) -> str:
    """What placed() calls the column of this exact name, or, without one, of this name in other case."""
    same = [k for k, c in enumerate(df.columns) if c == name] or [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not same:
        raise ValueError(f"no column {name} among {df.columns}")
    return f"c{same[0]}"


def picked(df: DataFrame, *names: str) -> DataFrame:
    """These columns of df alone."""
    return placed(df).select(*(F.col(place(df, n)).alias(n) for n in names))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[list]]:
    """Slices of at most ROWS_AT_ONCE rows, as Python lists in the order of names."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield [part.column(n).to_pylist() for n in names]


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(work, schema)


def null_as_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


@lru_cache(maxsize=4)
def tokenizer(path: str, plain_specials: bool = False):
    """A tokenizers file with truncation and padding unused; one per worker process. plain_specials: their strings are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    found.encode_special_tokens = plain_specials
    return found


def tokenizer_file(name: str) -> str:
    """A file of the public tokenizers' folder; asked for at run time, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)
