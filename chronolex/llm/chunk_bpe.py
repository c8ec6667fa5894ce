"""BPE encoding by content-defined chunk reuse, and decoding.

A rolling hash over 16 bytes cuts a text where its low bits are zero, so equal passages give equal chunks wherever they stand. A
chunk is encoded once in a Python worker, which keeps a bounded table of chunks across the documents and tasks it sees; a repeated
chunk costs one look-up. What a chunk contributes is the part between its first and last white space, where the tokenizer's words
surely end. Each join between two chunks is repaired: a window around it is encoded anew and must agree with what both chunks
have on either side; while it doesn't, the window takes in one more word of both.

Sharing is by worker, not by a shuffle of the corpus: a shuffle of chunks and one of ids would write more than the texts themselves,
and a passage in a third of all documents would gather their ids in one task.

Defined cases: a null text is empty and has no ids; texts of any length are whole; repeated rows each give a row; an empty table
gives no rows; extra columns are ignored. Texts without white space are encoded as they are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, null_as_empty, picked, table, tokenizer, tokenizer_file

#: A chunk ends, on average, each so many bytes (a power of two), but has so many at least and at most.
MEAN, LEAST, MOST = 2048, 256, 16384
#: Chunks that a worker keeps.
CHUNKS = 4096
#: A character of the private use area.
MARK = "\ue000"
#: Texts of ASCII and composed Latin letters, on which the rank table and the tokenizers library agree; others go to the library as they are.
_LATIN = re.compile("[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: The words of such a text in lower case.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=2)
def merges(path: str) -> tuple[tiktoken.Encoding, int] | None:
    """The merges of a tokenizers file whose words end in ``</w>`` as a rank table over marked words, and what its ids lie above the file's.

    A word is followed by MARK, whose three bytes merge first and then join the word's last byte, as ``</w>`` does in the file. Ids
    ascend in the order of the merges, so they serve as ranks; None for a file where that isn't so."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary = model["vocab"]
    ids = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if model.get("end_of_word_suffix") != "</w>" or ids != sorted(ids):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}
    mark = MARK.encode()
    ranks = {}
    for token, i in vocabulary.items():
        word = token.removesuffix("</w>")
        if not token.startswith("<|") and all(c in byte_of for c in word):
            ranks[bytes(byte_of[c] for c in word) + mark * (word != token)] = i + len(mark) - 1
    ranks |= {mark[:2]: 0, mark: 1}  # no Latin text has these bytes otherwise
    return tiktoken.Encoding("marked_words", pat_str=rf"[^\s{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={}), len(mark) - 1


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks, the last being the text's."""
    if len(data) <= LEAST:
        return [len(data)]
    h = (np.frombuffer(data, dtype=np.uint8).astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    factor, width = 0x01000193, 1
    while width < 16:  # each pass doubles the bytes that a hash covers
        h[width:] = h[width:] + h[:-width] * np.uint32(factor)
        factor, width = factor * factor & 0xFFFFFFFF, width * 2
    out, last = [], 0
    for at in (np.flatnonzero((h >> np.uint32(7)) & np.uint32(MEAN - 1) == 0) + 1).tolist():
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= LEAST:
            out.append(at)
            last = at
    while len(data) - last > MOST:
        last += MOST
        out.append(last)
    return out if last == len(data) else [*out, len(data)]


class Disagreement(Exception):
    """Even the window of two whole chunks has other ids than they: the text is encoded as it is."""


class ChunkEncoder:
    """Encodes texts with bounded tables of chunks and of the windows around their joins."""

    def __init__(self, path: str):
        self.path, self.wholes, self.chunks, self.joins = path, {}, {}, {}
        self.encoded = self.reused = 0

    def _ids(self, data: bytes) -> list[int]:
        return tokenizer(self.path).encode(data.decode(), add_special_tokens=False).ids

    def plain(self, data: bytes) -> list[int]:
        """Ids of a stretch that white space or the text's ends bound."""
        text, table = data.decode(), merges(self.path)
        if table is None or "<|" in text or not _LATIN.fullmatch(text):
            return tokenizer(self.path).encode(text, add_special_tokens=False).ids if text else []
        ids = np.array(table[0].encode_ordinary(_PARTS.sub(rf"\g<0>{MARK}", text.lower())), dtype=np.int64)
        return (ids - table[1]).tolist()

    def _whole(self, data: bytes) -> list[int]:
        """Ids of a text that is one chunk."""
        got = self.wholes.get(data)
        if got is not None:
            self.reused += 1
            return got
        self.encoded += 1
        return self._kept(self.wholes, data, self.plain(data))

    @staticmethod
    def _kept(table: dict, key: bytes, value):
        """value, which the table keeps; of a full table the older half goes."""
        if len(table) >= CHUNKS:
            for old in list(islice(table, CHUNKS // 2)):
                del table[old]
        table[key] = value
        return value

    def _chunk(self, data: bytes):
        """(first safe place, last safe place, ids between), or None if white space is nowhere in it."""
        got = self.chunks.get(data)
        if got is not None or data in self.chunks:
            self.reused += 1
            return got
        self.encoded += 1
        spaces = np.flatnonzero(_SPACES[np.frombuffer(data, dtype=np.uint8)])
        if len(spaces):
            a, b = int(spaces[0]) + 1, int(spaces[-1]) + 1
            got = a, b, self.plain(data[a:b])
        return self._kept(self.chunks, data, got)

    def _join(self, data: bytes, a: int, b: int, low: int, high: int) -> list[int]:
        """Ids of data[a:b], which a cut runs through: a window around it is encoded until it agrees with the chunks beside it, known from low to high."""
        left, right = a, b
        while True:
            left = self._word_before(data, left, low)
            right = self._word_after(data, right, high)
            head, tail = self.plain(data[left:a]), self.plain(data[b:right])
            window = data[left:right]
            got = self.joins.get(window)
            if got is None:
                got = self._ids(window)
                self._kept(self.joins, window, got)
            if got[: len(head)] == head and got[len(got) - len(tail) :] == tail:
                return got[len(head) : len(got) - len(tail)]
            if left == low and right == high:
                raise Disagreement

    @staticmethod
    def _word_before(data: bytes, at: int, low: int) -> int:
        end = len(data[low:at].rstrip()) if at - low < 64 else len(data[at - 64 : at].rstrip()) + at - 64 - low
        found = max(data.rfind(c, low, low + end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
        return max(low, found)

    @staticmethod
    def _word_after(data: bytes, at: int, high: int) -> int:
        stop = min(high, at + 64)
        found = [i for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := data.find(c, at + 1, stop)) >= 0]
        return min(found) + 1 if found else high

    def encode(self, text: str) -> list[int]:
        data = text.encode()
        ends = cuts(data)
        if len(ends) == 1:
            return self._whole(data)
        parts, last = [], 0
        for end in ends:
            got = self._chunk(data[last:end])
            if got is not None:
                parts.append((last + got[0], last + got[1], got[2]))
            last = end
        if not parts:
            return self._ids(data)
        out, at, low = [self.plain(data[: parts[0][0]])], None, 0
        for a, b, ids in parts:
            if at is not None:
                try:
                    out.append(self._join(data, at, a, low, b))
                except Disagreement:
                    return self._ids(data)
            out.append(ids)
            at, low = b, a
        out.append(self.plain(data[at:]))
        return list(chain.from_iterable(out))


_encoders: dict[str, ChunkEncoder] = {}


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoders.setdefault(path, ChunkEncoder(path))
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE // 4):
            part = batch.slice(at, ROWS_AT_ONCE // 4)
            ids = [encoder.encode(t) for t in part.column("text").to_pylist()]
            decoded = tokenizer(path).decode_batch(ids, skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, type=pa.list_(pa.int32())), pa.array(decoded, type=pa.string())], names=["doc_id", "ids", "decoded"])


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded, the text that the ids give back."""
    path = path or tokenizer_file("word_bpe_49k.json")
    text = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), null_as_empty(F.col("text")).alias("text"))
    return text.mapInArrow(lambda batches: _encoded(batches, path), "doc_id long, ids array<int>, decoded string")


def op4_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded; digests of the ids and of the decoded texts."""
    return encode_documents(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
