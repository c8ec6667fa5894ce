"""Packing of documents into sequences of a fixed number of tokens, by swap-based local search.

Documents are tokenised where they lie. Longer ones are cut so that only the first piece is shorter than a sequence; a whole piece
is a sequence by itself. The rest, at most one piece a document, are dealt into blocks of a bounded number of pieces by their place in the
stored table, so equal rows spread like others. In each block
a best-fit start is improved: the emptiest bin gives its pieces away by moves, one-for-one and two-for-one exchanges with other
underfull bins, each of which increases the sum of squared fills, until the bin is empty or no exchange helps. What lies in the emptiest bins
of all blocks is packed once more, in blocks of its own, until one block holds it: so blocks cost hardly any sequences.

Defined cases: a null text is an empty document of the end id alone; texts of any length are cut, whole; rows that repeat a doc_id are packed each; ties are broken by
order of doc_id; an empty table gives no rows; extra columns, also of clashing names, are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import END_ID, default_files, encode
from .common import ROWS_AT_ONCE, null_as_empty, picked, stored, table

ROOM = 1024
#: Pieces of a block: many enough that a block's last bins don't count, few enough for one task.
BLOCK = 16384
#: Of each block one in so many pieces, those of its emptiest bins, are packed again with those of other blocks.
AGAIN = 16

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64())])


def cut(n: int, room: int = ROOM) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n > 0 ids; only the first may be shorter than a sequence."""
    first = n % room or room
    return [(0, first), *((at, room) for at in range(first, n, room))]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, ranks: str | None, room: int) -> Iterator[pa.RecordBatch]:
    number = (1 << 62) | TaskContext.get().partitionId() << 36  # of sequences that one piece fills
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            out: dict[str, list] = {n: [] for n in _PIECES_ARROW.names}
            for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist(), path, ranks), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), room)):
                    whole = length == room
                    for name, v in zip(out, (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), number if whole else None), strict=True):
                        out[name].append(v)
                    number += whole
            yield pa.RecordBatch.from_pydict(out, schema=_PIECES_ARROW)


def best_fit(lengths: list[int], room: int) -> list[list[int]]:
    """Bins of piece numbers: longest first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(room + 1)]
    gaps: list[int] = []  # those that some bin has, ascending
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        k = bisect_left(gaps, n)
        if k < len(gaps):
            gap = gaps[k]
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                del gaps[k]
        else:
            gap, b = room, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := gap - n:
            if not by_gap[left]:
                insort(gaps, left)
            by_gap[left].append(b)
    return bins


def improved(lengths: list[int], bins: list[list[int]], room: int) -> list[list[int]]:
    """Empties underfull bins by moves and exchanges that each increase the sum of squared fills."""
    size = np.array(lengths, dtype=np.int64)
    least = -(-int(size.sum()) // room)
    home = np.empty(len(size), dtype=np.int64)
    for b, items in enumerate(bins):
        home[items] = b
    fill = np.array([size[items].sum() for items in bins], dtype=np.int64)
    left, tried = len(bins), np.zeros(len(bins), dtype=bool)
    while left > least:
        open_bins = np.flatnonzero((fill > 0) & (fill < room) & ~tried)
        if not len(open_bins):
            break
        a = int(open_bins[np.argmin(fill[open_bins])])
        tried[a] = True
        while fill[a] and (found := _exchange(size, home, fill, a, room)):
            give, take, b = found
            moved = int(size[give].sum() - size[take].sum())
            home[give], home[take] = b, a
            fill[a] -= moved
            fill[b] += moved
        left -= not fill[a]
    out: dict[int, list[int]] = {}
    for i, b in enumerate(home.tolist()):
        out.setdefault(b, []).append(i)
    return list(out.values())


def _exchange(size: np.ndarray, home: np.ndarray, fill: np.ndarray, a: int, room: int):
    """The exchange that takes most from bin a into a fuller bin: (pieces given, pieces taken, bin), or None."""
    own = np.flatnonzero(home == a)
    gap = room - fill
    gap[a] = 0
    usable = (fill > 0) & (gap > 0) & (fill >= fill[a])
    best = None
    for i in own[np.argsort(-size[own], kind="stable")].tolist():  # a move, into the bin that it fills best
        fits = np.flatnonzero(usable & (gap >= size[i]))
        if len(fits):
            return np.array([i]), np.zeros(0, dtype=np.int64), int(fits[np.argmin(gap[fits])])
    other = np.flatnonzero(usable[home])
    n, slack = size[other], gap[home[other]]
    offers = [[i] for i in own.tolist()] + [[i, j] for k, i in enumerate(own.tolist()) for j in own.tolist()[k + 1 :]]
    for give in offers:  # one or two for one
        x = int(size[give].sum())
        won = np.where((n < x) & (n + slack >= x), x - n, 0)
        if len(won) and (k := int(np.argmax(won))) >= 0 and won[k] > 0 and (best is None or won[k] > best[0]):
            best = int(won[k]), np.array(give), np.array([other[k]])
    return best and (best[1], best[2], int(home[best[2][0]]))


def packed_block(block: pd.DataFrame, room: int = ROOM) -> pd.DataFrame:
    block = block.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], kind="stable").reset_index(drop=True)
    lengths = block["length"].astype(int).tolist()
    sequence, offset = np.empty(len(block), dtype=np.int64), np.empty(len(block), dtype=np.int64)
    for number, items in enumerate(improved(lengths, best_fit(lengths, room), room)):
        at = 0
        for i in items:
            sequence[i], offset[i], at = number, at, at + lengths[i]
    fill, pieces = np.bincount(sequence, weights=lengths), np.bincount(sequence)
    emptiest = np.argsort(fill, kind="stable")
    loose = np.zeros(len(fill), dtype=bool)
    loose[emptiest[np.cumsum(pieces[emptiest]) <= max(len(block) // AGAIN, pieces[emptiest[0]])]] = True
    named = block.assign(sequence_id=(block["block"].astype(np.int64).to_numpy() << 32) | sequence, offset=offset, loose=(loose & (fill < room))[sequence])
    return named[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "loose"]]


def pack_documents(docs: DataFrame, path: str, ranks: str | None, room: int = ROOM, block: int = BLOCK) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    text = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), null_as_empty(F.col("text")).alias("text"))
    pieces = stored(text.mapInArrow(lambda batches: _pieces(batches, path, ranks, room), _PIECES), "pieces")
    done, left, first = pieces.filter(F.col("length") == room).withColumn("offset", F.lit(0).cast("long")), pieces.filter(F.col("length") < room), 0
    while True:
        n_blocks = max(1, -(-left.count() // block))
        # Rows are dealt by their number in the stored table, which a repeated task counts alike.
        key = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)) + first
        packed = left.withColumn("block", key).groupBy("block").applyInPandas(lambda pdf: packed_block(pdf, room), f"{_PIECES}, offset long, loose boolean")
        if n_blocks == 1:
            return done.unionByName(packed.drop("loose"))
        packed, first = stored(packed, "packed"), first + n_blocks
        done, again = done.unionByName(packed.filter("not loose").drop("loose")), packed.filter("loose")
        if 2 * again.count() > left.count():  # one bin of each block holds most of it
            return done.unionByName(again.drop("loose"))
        left = again.drop("offset", "loose")


def op8_local_search_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), *default_files())
