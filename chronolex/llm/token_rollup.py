"""Token counts as delta-maintained rollups.

Changes are signed: an insert adds a document and its tokens, a delete takes them away, a revised count adds the difference (and moves the
document, if its source or language is another). A batch of changes is summed by source, language and tokenizer version, and only these sums are
committed, under the batch's name. A commit writes its sums into a folder of their own inside the store and then a manifest under the batch's name,
by a rename; only folders that a manifest names count. So a batch is there whole or not at all, two writers of one batch count once, and
repeating a batch, whole or after a crash, changes nothing; the same name with other sums is an error. Totals are sums over
the committed folders, and a compaction replaces them by one.

Defined cases: null source or lang are groups of their own; null counts are 0; an empty batch is committed and adds nothing; groups
whose documents and tokens are all gone are left out of the totals; repeated rows count each; texts of any length are counted
whole; an empty table or store has no totals; extra columns, also of clashing names, are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import default_files, encode
from .common import ROWS_AT_ONCE, SPACE, null_as_empty, picked, scratch_path, stored, table

KEYS = ("source", "lang", "tokenizer")
_SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
_MANIFEST = "batch string, folder string, digest string, replaces array<string>"


def _change(side: str, sign: int, tokens: Column, keep: Column) -> Column:
    return F.when(keep, F.struct(*(F.col(f"{side}{k}").alias(k) for k in KEYS), F.lit(sign).cast("long").alias("n_docs"), (sign * F.coalesce(tokens, F.lit(0))).cast("long").alias("n_tokens")))


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that add rows of source, lang, tokenizer, n_tokens."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take such rows away."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.coalesce(F.col("n_tokens"), F.lit(0))).cast("long").alias("n_tokens"))


def revisions(pairs: DataFrame) -> DataFrame:
    """Changes from rows of old_source, old_lang, old_tokenizer, old_n_tokens to new_source and so on."""
    both = F.array(_change("old_", -1, F.col("old_n_tokens"), F.lit(True)), _change("new_", 1, F.col("new_n_tokens"), F.lit(True)))
    return pairs.select(F.explode(both).alias("x")).select("x.*")


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _known(spark: SparkSession, store: str, batch: str):
    """The manifest of a batch, or None."""
    target, fs = _files(spark, f"{store}/commits/{batch}.json")
    return spark.read.schema(_MANIFEST).json(str(target)).first() if fs.exists(target) else None


def _summed(changes: DataFrame) -> DataFrame:
    # Sums by task first: a source with a third of all rows arrives as one row a task.
    return changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _digest(sums: DataFrame) -> str:
    """The same for the same rows in any order."""
    rows, total = sums.agg(F.count("*"), F.sum(F.xxhash64(*KEYS, "n_docs", "n_tokens").cast("decimal(38,0)"))).first()
    return f"{rows}:{total}"


def _staged(store: str, batch: str, changes: DataFrame) -> tuple[str, str]:
    """Writes a batch's sums into a folder of their own, which counts only once a manifest names it: (folder, digest of the sums)."""
    folder = f"{batch}-{uuid.uuid4().hex}"
    path = f"{store}/data/folder={folder}"
    _summed(changes).write.parquet(path)
    return folder, _digest(changes.sparkSession.read.schema(_SUMS).parquet(path))


def _published(spark: SparkSession, store: str, batch: str, folder: str, digest: str, replaces: list[str]) -> bool:
    """Makes the folder the batch's by renaming a manifest to the batch's name; False if another writer was first. There is one manifest a name, so
    whoever wins, one folder counts."""
    hidden, fs = _files(spark, f"{store}/commits/.{folder}")
    target, _ = _files(spark, f"{store}/commits/{batch}.json")
    fs.mkdirs(target.getParent())
    out = fs.create(hidden, True)
    out.write(bytearray(json.dumps({"batch": batch, "folder": folder, "digest": digest, "replaces": replaces}).encode()))
    out.close()
    won = not fs.exists(target) and fs.rename(hidden, target)
    fs.delete(hidden, False)
    found = _known(spark, store, batch)
    if found is None:
        raise OSError(f"batch {batch} could not be committed to {store}")
    if won and found["folder"] == folder:
        return True
    data, _ = _files(spark, f"{store}/data/folder={folder}")
    fs.delete(data, True)
    return False


def commit(store: str, batch: str, changes: DataFrame) -> bool:
    """Adds the batch's sums to the store; False if the store has the batch already. The same name with other sums is an error."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    spark = changes.sparkSession
    found = _known(spark, store, batch)
    if found is None:
        folder, digest = _staged(store, batch, changes)
        if _published(spark, store, batch, folder, digest, []):
            return True
        found = _known(spark, store, batch)
    else:
        digest = _digest(_summed(changes))
    if found["digest"] != digest:
        raise ValueError(f"batch {batch} is in {store} with other sums")
    return False


def _committed(spark: SparkSession, store: str) -> DataFrame:
    """The sums of all folders that a manifest names and none replaces."""
    target, fs = _files(spark, f"{store}/commits")
    if not fs.exists(target):
        return spark.createDataFrame([], _SUMS)
    manifests = spark.read.schema(_MANIFEST).json(str(target))
    counted = manifests.select("folder").join(manifests.select(F.explode("replaces").alias("folder")), "folder", "left_anti")
    sums = spark.read.schema(f"{_SUMS}, folder string").option("basePath", f"{store}/data").parquet(f"{store}/data")
    return sums.join(counted, "folder", "left_semi")


def totals(spark: SparkSession, store: str) -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
    return _summed(_committed(spark, store)).filter("n_docs <> 0 or n_tokens <> 0")


def compact(spark: SparkSession, store: str) -> bool:
    """Writes the sums of all committed folders as one that replaces them; names of batches stay known. False if another compaction came first."""
    manifests = spark.read.schema(_MANIFEST).json(f"{store}/commits")
    counted = manifests.select("folder").join(manifests.select(F.explode("replaces").alias("folder")), "folder", "left_anti")
    folders = sorted(r["folder"] for r in counted.collect())  # those since the last compaction
    number = manifests.filter(F.size("replaces") > 0).count()
    sums = spark.read.schema(f"{_SUMS}, folder string").option("basePath", f"{store}/data").parquet(*(f"{store}/data/folder={f}" for f in folders))
    name = f"compacted-{number}"
    return _published(spark, store, name, *_staged(store, name, sums), folders)


def _counted(batches: Iterator[pa.RecordBatch], path: str, ranks: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            counts = [len(ids) for ids in encode(part.column("text").to_pylist(), path, ranks)]
            yield pa.RecordBatch.from_arrays([part.column("source"), part.column("lang"), part.column("words"), pa.array(counts, pa.int64())], names=["source", "lang", "words", "ids"])


def counted(docs: DataFrame, path: str, ranks: str | None) -> DataFrame:
    """Per row of docs: source, lang, words (between white space) and ids (of the byte-level BPE)."""
    text = null_as_empty(F.col("text"))
    words = F.size(F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), f"{SPACE}+")).cast("long")
    rows = picked(docs, "source", "lang", "text").select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.when(F.translate(text, " \t\n\x0b\x0c\r", "") == "", F.lit(0).cast("long")).otherwise(words).alias("words"), text.alias("text"))
    return rows.mapInArrow(lambda batches: _counted(batches, path, ranks), "source string, lang string, words long, ids long")


def op3_delta_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents come in, counted by two tokenizers; the BPE's counts are revised by the end id; what has fewer
    than ten words is deleted; the revision is sent once more, which changes nothing."""
    rows = stored(counted(table(spark, sf_dir, "documents"), *default_files()), "counts")
    version = lambda df, name, n: df.select("source", "lang", F.lit(name).alias("tokenizer"), n.alias("n_tokens"))
    words, ids = (lambda df: version(df, "words", F.col("words"))), (lambda df, more=0: version(df, "byte_bpe_50k", F.col("ids") + more))
    store, short = scratch_path(spark, "rollup"), rows.filter("words < 10")
    revised = revisions(rows.select(*(f for side, more in (("old_", 0), ("new_", 1)) for f in (F.col("source").alias(f"{side}source"), F.col("lang").alias(f"{side}lang"), F.lit("byte_bpe_50k").alias(f"{side}tokenizer"), (F.col("ids") + more).alias(f"{side}n_tokens")))))
    commit(store, "load", inserts(words(rows).unionByName(ids(rows))))
    commit(store, "end-id", revised)
    commit(store, "short", deletes(words(short).unionByName(ids(short, 1))))
    commit(store, "end-id", revised)
    return totals(spark, store)
