"""Phrase collocations by suffix sigma.

Each word starts a suffix: it and the words after it in its piece, MAX_WORDS of them at most. Equal suffixes are summed where texts are read, and the rest are shuffled once, to ranges of
language, first word, second word and so on. Each range is sorted in reverse, so that all suffixes that start with a phrase stand together, and one stack with an entry for each number of words counts all phrases on
the way: a suffix that no longer starts with an entry's phrase closes it. A phrase at the edge of a range may go on in the next one; what a range's first and last rows start with is passed on whatever its count, and
summed. So a frequent word, pair or phrase spreads over as many ranges as its suffixes fill. Bounds of the ranges come from suffixes of about SAMPLE documents; they tell where work is done and nothing else.

The phrases that are frequent enough are then joined with their parts: both sides of each cut, whose counts are never less than theirs, and the longer phrases that they are in.

Words are all but spaces and tabs, with A-Z in lower case; a piece ends at ``. , ; : ! ?`` and at line ends. As bytes a word of a suffix ends with 0xFF, which no UTF-8 text holds, so bytewise order keeps suffixes of a phrase together.

Defined cases: a null or empty text has no words; a null lang is `und`; texts of any length are cut at white space into spans that hand on their last words; repeated rows count each;
a language without frequent phrases has no rows; an empty table gives no rows; extra columns are ignored, also such as bear a result's name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, null_as_empty, picked, stored, table
from .near_dup import met

MAX_WORDS, LEAST, LONGER_SHARE, BEST, NO_LANGUAGE = 4, 30, 80, 2000, "und"
END = b"\xff"
#: Words that are summed together where they are read, and bytes of a text that are looked at together.
WORDS_AT_ONCE, SPAN = 1 << 19, 1 << 22
#: Documents, about, whose suffixes tell the bounds of ranges; bytes of a bound; suffixes of a range, about; bounds are the quantiles of so many suffixes for each range, and of DRAWN at most.
SAMPLE, BOUND_BYTES, RANGE_ROWS, PER_RANGE, DRAWN = 1024, 48, 1 << 20, 64, 1 << 19
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, and END between pieces."""
    return text.lower().translate(_BREAKS).replace(b"\n", b" \xff ").split()


def spans(text: bytes) -> Iterator[bytes]:
    """text in spans of about SPAN bytes, cut at white space or the end of a piece."""
    at = 0
    while len(text) - at > SPAN:
        cut = at + SPAN
        while cut < len(text) and text[cut] not in b" \t\n\r.,;:!?\x0b\x0c":
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def summed(words: list[bytes], starts: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct suffixes of the first words, starts of them, as bytes in ascending order, and how often each is there."""
    ended = sorted(w + END for w in set(words) if w != END)
    place = {w[:-1]: k + 1 for k, w in enumerate(ended)} | {END: 0}
    ids = np.zeros(len(words) + MAX_WORDS, dtype=np.uint64)
    ids[: len(words)] = np.fromiter(map(place.__getitem__, words), np.uint64, len(words))
    columns = [ids[:starts]]
    for k in range(1, MAX_WORDS):
        columns.append(np.where(columns[-1] == 0, np.uint64(0), ids[k : k + starts]))
    bits = np.uint64(len(ended).bit_length())
    keys = [columns[k] << bits | columns[k + 1] for k in range(0, MAX_WORDS, 2)]  # two words a key: under 2 ** 32 distinct words
    used = columns[0] > 0
    keys = [k[used] for k in keys]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = np.ones(len(order), dtype=bool)
    first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(order)))
    terms, low = pa.array(ended, pa.binary()), (np.uint64(1) << bits) - np.uint64(1)
    parts = []
    for key in keys:
        for ids in (key[at] >> bits, key[at] & low):
            parts.append(terms.take(pa.array(ids.astype(np.int64) - 1, mask=ids == 0)))
    return pc.binary_join_element_wise(*parts, b"", null_handling="skip") if len(at) else pa.array([], pa.binary()), counts


_SUFFIX = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("n", pa.int64())])


def _suffixes(batches: Iterator[pa.RecordBatch], bounds: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Suffixes of texts with their counts and the range that each is in."""
    held: dict[str, list[bytes]] = {}
    total = 0

    def taken(lang: str, keep: int) -> Iterator[pa.RecordBatch]:
        nonlocal total
        words = held.pop(lang)
        total -= len(words) - keep
        starts = len(words) - keep
        if keep:
            held[lang] = words[starts:]
        found, counts = summed(words, starts)
        if not len(found):
            return
        keys = pc.binary_join_element_wise(pa.scalar(lang.encode() + END), found, b"")
        cuts = [bisect_left(keys, b, key=lambda x: x.as_py()) for b in bounds]
        parts = np.searchsorted(np.array(cuts, dtype=np.int64), np.arange(len(keys)), side="right")
        for at in range(0, len(keys), 1 << 16):
            piece = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(parts[piece], pa.int32()), keys[piece].cast(pa.binary()), pa.array(counts[piece], pa.int64())], schema=_SUFFIX)

    for batch in batches:
        for row in range(batch.num_rows):
            lang, text = batch.column("lang")[row].as_py(), batch.column("text")[row].as_py().encode()
            for span in spans(text):
                found = words_of(span)
                held.setdefault(lang, []).extend(found)
                total += len(found)
                if total >= WORDS_AT_ONCE:
                    for other in list(held):  # the text may go on: its last words wait for those that follow them
                        yield from taken(other, min(MAX_WORDS - 1, len(held[other])) if other == lang else 0)
            held.setdefault(lang, []).append(END)
            total += 1
    for lang in list(held):
        yield from taken(lang, 0)


def _shared(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes each row of binary data shares, from the start, with the row before it; 0 for the first."""
    size = np.diff(offsets)
    most = np.minimum(size[1:], size[:-1])
    out = np.zeros(len(size), dtype=np.int64)
    active, k = np.flatnonzero(most > 0), 0
    while len(active):
        active = active[data[offsets[active] + k] == data[offsets[active + 1] + k]]
        k += 1
        out[active + 1] = k
        active = active[most[active] > k]
    return out


def _bytes_of(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and where each starts and the last ends."""
    offsets = np.frombuffer(keys.buffers()[1], dtype=np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
    return np.frombuffer(keys.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


_PHRASES = "lang string, phrase string, k int, f long"


def _counted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Phrases of suffixes in reverse order, with k words and counted f times (k = 0: the language with its words). The stack has an entry for each number of words, of which the last suffix tells the phrase: open_[k] counts it, first[k] says that it started with
    the partition. A phrase that the partition's edges may cut is told whatever its count, any other if it's frequent enough."""
    none = np.int64(1) << 40
    last, open_, first = None, np.zeros(MAX_WORDS + 1, dtype=np.int64), [True] * (MAX_WORDS + 1)
    out: dict[str, list] = {"lang": [], "phrase": [], "k": [], "f": []}

    def add(prefix: bytes, k: int, f: int) -> None:
        lang, *words, _ = prefix.split(END)
        for c, v in zip(out.values(), (lang.decode(), b" ".join(words).decode(), k, f), strict=True):
            c.append(v)

    def taken() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("f", pa.int64())]))
        for values in out.values():
            values.clear()
        return made

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, counts = batch.column("key"), batch.column("n").to_numpy()
        if last is not None:  # the last suffix again, which counts nothing, so that open phrases go on
            keys, counts = pa.concat_arrays([pa.array([last], pa.binary()), keys]), np.append(0, counts)
        data, offsets = _bytes_of(keys)
        ends = np.flatnonzero(data == END[0])
        row = np.searchsorted(offsets, ends, side="right") - 1
        k = np.arange(len(ends)) - np.searchsorted(ends, offsets[:-1])[row]
        size = np.full((len(keys), MAX_WORDS + 1), none)
        size[row, k] = ends - offsets[row] + 1
        new = _shared(data, offsets)[:, None] < size
        new[0] = True
        for k in range(MAX_WORDS + 1):
            at = np.flatnonzero(new[:, k])
            sums = np.add.reduceat(counts, at)
            sums[0] += open_[k]
            there = size[at, k] < none
            closed = np.flatnonzero(there[:-1] & (sums[:-1] >= least))
            if first[k] and there[0] and len(at) > 1 and sums[0] < least:
                closed = np.append(closed, 0)
            for j in closed:
                start = offsets[at[j]]
                add(data[start : start + size[at[j], k]].tobytes(), k, int(sums[j]))
            first[k] = first[k] and len(at) == 1
            open_[k] = sums[-1] if there[-1] else 0
        last = keys[-1].as_py()
        if out["k"]:
            yield taken()
    if last is not None:
        parts = last.split(END)[:-1]
        for k in range(len(parts)):
            add(END.join(parts[: k + 1]) + END, k, int(open_[k]))
    yield taken()


def frequent(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase (words joined by a space), k (its words) and f of all phrases of MAX_WORDS words at most that docs (lang, text) hold so often, and the words of each language with k = 0; stored."""
    spark, narrow = docs.sparkSession, picked(docs, "lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), null_as_empty(F.col("text")).alias("text"))
    suffixes = lambda rows, bounds: rows.mapInArrow(lambda batches: _suffixes(batches, bounds), "part int, key binary, n long")
    rows = narrow.count()
    share = min(1.0, SAMPLE / max(rows, 1))
    some = stored(suffixes(narrow.sample(share, 20240607) if share < 1 else narrow, []).select(F.substring("key", 1, BOUND_BYTES).alias("key")), "sample")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(some.count() / share / RANGE_ROWS) + 1)
    drawn = sorted(bytes(r["key"]) for r in some.orderBy(F.xxhash64("key", F.monotonically_increasing_id())).limit(min(PER_RANGE * n, DRAWN)).collect())
    bounds = sorted({drawn[k * len(drawn) // n] for k in range(1, n)}) if drawn else []
    forget(some)
    ordered = suffixes(narrow, bounds).repartitionById(n, "part").sortWithinPartitions(F.desc("key")).select("key", "n")
    counted = ordered.mapInArrow(lambda batches: _counted(batches, least), _PHRASES)
    return stored(counted.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "phrases")


def _some(words: Column, start: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the phrases of two words and more, by their lowest-scoring cut, of equal ones the first."""
    words = F.split("phrase", " ")
    cuts = phrases.filter("k >= 2").select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), words.alias("words"), "k")
    cuts = stored(cuts.select("lang", "phrase", "a", "cut", _some(F.col("words"), 1, F.col("cut")).alias("left"), _some(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right")), "cuts")
    part = lambda name, f: phrases.filter("k between 1 and 3").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = met(met(cuts, part("left", "l"), "lang", "left"), part("right", "r"), "lang", "right")
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)")
    best = stored(both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")), "scored")
    forget(cuts)
    total = phrases.filter("k = 0").select("lang", F.col("f").alias("n"))
    out = stored(met(best, total, "lang").select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score"), "candidates")
    forget(best)
    return out


def _within(phrases: DataFrame) -> DataFrame:
    """lang, phrase and longer, the most that a longer phrase with this one inside is counted."""
    words, k = F.split("phrase", " "), F.col("k")
    places = F.flatten(F.transform(F.sequence(F.lit(2), k - 1), lambda size: F.transform(F.sequence(F.lit(1), k - size + 1), lambda start: F.struct(start.alias("start"), size.alias("size")))))
    inner = phrases.filter("k >= 3").select("lang", "f", words.alias("words"), F.explode(places).alias("x"))
    return inner.select("lang", "f", _some(F.col("words"), F.col("x.start"), F.col("x.size")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    phrases = frequent(docs, least)
    kept = scored(phrases).join(_within(phrases), ["lang", "phrase"], "left").filter(f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {LONGER_SHARE}").drop("longer")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for salts in (512, 16, 1):  # so that no task ranks all phrases of a language
        salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).filter(F.col("rank") <= best)
        kept = kept if salts == 1 else kept.drop("rank")
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_suffix_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of all documents, by language."""
    return collocations(table(spark, sf_dir, "documents"))
