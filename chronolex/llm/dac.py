"""Directly addressable codes for token ids, and the files that hold them.

An id is split into chunks of 8 bits. Level k holds, for each id that is that long, its k-th chunk and a continuation bit; a rank
directory over the bits gives the place of an id's next chunk. So any id, or any range, is read without decoding what stands before.

A payload: ``DAC1``, number of levels (u4), number of ids (u4), then for each level its number of chunks (u4), the chunks (u1 each),
the continuation bits (least first, padded to 64 bits) and the ranks before each 512 bits (u4). All little-endian.

Files: Parquet with one row a segment, in ascending doc_id order: shard and segment numbers, ids of the shard before the segment,
doc_ids, lengths and the payload. Spark writes and reads them, so any store that Spark reaches will do. They are not compressed, as the codes are
compact and are read where they lie: token_at and tokens_of fetch one segment's payload and decode one id, or one document's range, in it.

Defined cases: a null text is an empty document and so is the end id alone; null doc_ids come first; rows that repeat a doc_id stay,
in order of their texts; documents of any length stay whole in one segment; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_bpe import END_ID, default_files, encode
from .common import ROWS_AT_ONCE, null_as_empty, picked, scratch_path, table

_STEP = 512
#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 19


def pack(ids: np.ndarray) -> bytes:
    ids = np.asarray(ids, dtype=np.uint32)
    levels, rest = [], ids
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 8, dtype=np.uint8)])
        per_step = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), _STEP)) if len(more) else np.zeros(0, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per_step)[:-1]]).astype("<u4") if len(per_step) else np.zeros(0, dtype="<u4")
        levels.append(struct.pack("<I", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            break
        rest = rest[more] >> 8
    return b"DAC1" + struct.pack("<II", len(levels), len(ids)) + b"".join(levels)


class Dac:
    """A payload that is read in place."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"DAC1":
            raise ValueError("not a DAC1 payload")
        n_levels, self.size = struct.unpack_from("<II", payload, 4)
        at, self.levels = 12, []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<I", payload, at)
            n_bits, n_ranks = ((n + 7) // 8 + 7) // 8 * 8, -(-n // _STEP)
            chunks = np.frombuffer(payload, np.uint8, n, at + 4)
            bits = np.frombuffer(payload, np.uint8, n_bits, at + 4 + n)
            self.levels.append((chunks, bits, np.frombuffer(payload, "<u4", n_ranks, at + 4 + n + n_bits)))
            at += 4 + n + n_bits + 4 * n_ranks

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Continuation bits before place i: the directory's count and those of one step at most."""
        if i // _STEP >= len(ranks):
            return int(ranks[-1]) + int(np.bitwise_count(bits[(len(ranks) - 1) * _STEP // 8 :]).sum()) if len(ranks) else 0
        full, part = divmod(i, 8)
        before = int(ranks[i // _STEP]) + int(np.bitwise_count(bits[i // _STEP * _STEP // 8 : full]).sum())
        return before + (int(bits[full]) & ((1 << part) - 1)).bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(bits, ranks, i), shift + 8
        return value

    def range(self, a: int, b: int) -> np.ndarray:
        """Ids a to b, end exclusive; only their own chunks are touched."""
        out, where, shift = np.zeros(b - a, dtype=np.uint32), np.arange(b - a), 0
        for chunks, bits, ranks in self.levels:
            if a >= b:
                break
            out[where] |= chunks[a:b].astype(np.uint32) << shift
            more = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            where, first = where[more], self._rank(bits, ranks, a)
            a, b, shift = first, first + len(where), shift + 8
        return out


_SEGMENTS = "shard int, segment int, shard_ids_before long, n_ids long, doc_ids array<long>, lengths array<int>, payload binary"
_SEGMENTS_ARROW = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("shard_ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())])


def _segments(batches: Iterator[pa.RecordBatch], path: str, ranks: str | None, segment_ids: int) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId()
    before, number, docs, parts, held = 0, 0, [], [], 0

    def closed() -> pa.RecordBatch:
        row = {"shard": shard, "segment": number, "shard_ids_before": before, "n_ids": held, "doc_ids": docs, "lengths": [len(p) for p in parts], "payload": pack(np.concatenate(parts))}
        return pa.RecordBatch.from_pylist([row], schema=_SEGMENTS_ARROW)

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist(), path, ranks), strict=True):
                docs.append(doc)
                parts.append(np.append(ids, np.uint32(END_ID)))
                held += len(parts[-1])
                if held >= segment_ids:
                    yield closed()
                    before, number, docs, parts, held = before + held, number + 1, [], [], 0
    if docs:
        yield closed()


def write_ids(docs: DataFrame, to: str, path: str, ranks: str | None, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the files: documents are dealt by ranges of doc_id and the start of the text, so part files and the segments in them ascend, and rows that share a doc_id spread over tasks."""
    text = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), null_as_empty(F.col("text")).alias("text"))
    ordered = text.repartitionByRange("doc_id", F.left("text", F.lit(128))).sortWithinPartitions("doc_id", "text")
    segments = ordered.mapInArrow(lambda batches: _segments(batches, path, ranks, segment_ids), _SEGMENTS)
    segments.write.option("compression", "none").option("parquet.block.size", 8 << 20).parquet(to)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = {n: batch.column(n)[row].as_py() for n in ("doc_ids", "lengths", "payload", "before")}
            dac, at = Dac(one["payload"]), 0
            out: dict[str, list] = {"doc_id": one["doc_ids"], "start": [], "n_tokens": one["lengths"], "ids_crc32": []}
            for n in one["lengths"]:
                out["start"].append(one["before"] + at)
                out["ids_crc32"].append(zlib.crc32(dac.range(at, at + n).astype("<u4").tobytes()))
                at += n
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))


def _bases(segments: DataFrame) -> DataFrame:
    """shard, base (ids of all shards before it) and shard_ids. One row a shard, that is a write task, so the running sum is bounded by the number of partitions."""
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    return totals.withColumn("base", F.sum("shard_ids").over(Window.orderBy("shard")) - F.col("shard_ids"))


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The id at a position of the whole collection: the directory tells its segment, and one code of that segment is read."""
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    shard = _bases(segments).filter((F.col("base") <= position) & (F.col("base") + F.col("shard_ids") > position)).first()
    if shard is None:
        raise IndexError(position)
    within = position - shard["base"]
    row = segments.filter((F.col("shard") == shard["shard"]) & (F.col("shard_ids_before") <= within) & (F.col("shard_ids_before") + F.col("n_ids") > within)).select("shard_ids_before", "payload").first()
    return Dac(row["payload"])[within - row["shard_ids_before"]]


def tokens_of(spark: SparkSession, path: str, doc_id: int) -> np.ndarray | None:
    """The ids of a document (of the first of rows that repeat its doc_id), without decoding those of others; None without it."""
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    row = segments.filter(F.array_contains("doc_ids", doc_id)).orderBy("shard", "segment").select("doc_ids", "lengths", "payload").first()
    if row is None:
        return None
    at = row["doc_ids"].index(doc_id)
    start = sum(row["lengths"][:at])
    return Dac(row["payload"]).range(start, start + row["lengths"][at])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document what the files hold: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    bases = _bases(segments).select("shard", "base")
    placed = segments.join(F.broadcast(bases), "shard").select((F.col("base") + F.col("shard_ids_before")).alias("before"), "doc_ids", "lengths", "payload")
    return placed.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as directly addressable codes and read back from the files."""
    to = scratch_path(spark, "dac")
    write_ids(table(spark, sf_dir, "documents"), to, *default_files())
    return read_ids(spark, to)
