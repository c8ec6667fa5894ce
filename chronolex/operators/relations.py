"""The aggregates that profiles read: unigram, co-occurrence and term-by-segment counts.

Build them once and write them as Parquet, partitioned by date or sorted by the first attribute; each profile is then a filter and two sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens that are met with each other in one array; those near its edges come on top.
BLOCK = 2048
#: Rows that a task sorts or sums by key, on average, where keys are nearly as many as rows.
TASK_ROWS = 1 << 18


def parts_of(stored: DataFrame) -> int | None:
    """How many partitions hold TASK_ROWS of these rows each; None if the cores alone make as many. The rows are counted, so they should be a table that is read.

    Spark deals shuffles by bytes, of which rows of ids take few once compressed: what a task holds in memory then is dozens of times what it has read."""
    rows = stored.count()
    return None if rows <= TASK_ROWS * stored.sparkSession.sparkContext.defaultParallelism else -(-rows // TASK_ROWS)


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """rows in so many partitions by keys; as they are for None. Joins and sums by these keys, or by more, go on in the same partitions."""
    return rows if parts is None else rows.repartition(parts, *keys)


def unigrams(tokens: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """attributes, date, f."""
    return tokens.groupBy(*attributes, "date").agg(F.count("*").alias("f"))


def windows(tokens: DataFrame, attributes: Sequence[str], distance: int = 5, sentence: Sequence[str] = ("doc_id", "sent_id"), order: Sequence[str] = ("pos",)) -> DataFrame:
    """The tokens in blocks, as an array column t, for pairs_of and marginals_of.

    Tokens are sorted by ranges and numbered through, whatever their sentences; blocks of BLOCK numbers become arrays, with the tokens that are near enough after
    and before them. So arrays are bounded, and a sentence of any length spreads over many tasks. The blocks are written once, whatever is made of them."""
    attributes, within = list(attributes), max(distance, 1)
    found = numbered(tokens, [*sentence], [*order], attributes)
    block = F.floor(F.col("__at") / BLOCK)
    first, last = F.floor((F.col("__at") - within) / BLOCK), F.floor((F.col("__at") + within) / BLOCK)
    item = F.struct(F.col("__at").alias("at"), (block == F.col("__block")).alias("own"), F.struct(*(F.col(f"`{c}`") for c in sentence)).alias("sentence"), "date", *attributes)
    dealt = found.withColumn("__block", F.explode(F.sequence(first, last)))
    return written(dealt.groupBy("__block").agg(F.sort_array(F.collect_list(item)).alias("t")).select("t"))


def blocks_of(sentences: DataFrame, attributes: Sequence[str], distance: int = 5) -> DataFrame:
    """Blocks for pairs_of and marginals_of as windows() gives them, of sentences that are a row each: date, and in order their tokens, an array of structs of attributes. Rows are cut into blocks where they are
    read, so nothing is sorted, shuffled or written; what is made of the blocks twice reads the sentences twice."""
    within = max(distance, 1)
    last = F.floor((F.size("tokens") - 1) / BLOCK)
    before = lambda b: F.least(b * BLOCK, F.lit(within))
    cut = lambda b: F.slice("tokens", (b * BLOCK - before(b)).cast("int") + 1, (before(b) + BLOCK + within).cast("int"))
    # The outer forms spare tests for empty arrays, which would make them twice more.
    whole = sentences.select("date", F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0))), cut).alias("parts"))
    parts = whole.select("date", F.posexplode_outer("parts").alias("block", "part")).withColumn("before", before(F.col("block")))
    own = lambda i: (i >= F.col("before")) & (i < F.col("before") + BLOCK)
    item = lambda x, i: F.struct(own(i).alias("own"), F.lit(True).alias("sentence"), "date", *(x[a].alias(a) for a in attributes))
    return parts.select(F.transform("part", item).alias("t"))


def sentence_marginals(sentences: DataFrame, attributes: Sequence[str], distance: int = 5) -> DataFrame:
    """attributes, date, f1: what marginals_of() gives, from the places of tokens in sentences that are a row each (see blocks_of)."""
    placed = sentences.select("date", F.size("tokens").alias("size"), F.posexplode_outer("tokens").alias("i", "x"))
    near = F.least(F.col("i"), F.lit(distance)) + F.least(F.col("size") - 1 - F.col("i"), F.lit(distance))
    return placed.select(*(F.col(f"x.{a}").alias(a) for a in attributes), "date", near.cast("long").alias("n"), "i").filter("i is not null and n > 0").groupBy(*attributes, "date").agg(F.sum("n").alias("f1"))


def _around(blocks: DataFrame, distance: int, where: Column) -> DataFrame:
    """i and one, each token that where takes in, with the slice around it, which starts at s."""
    placed = blocks.select("t", F.posexplode_outer("t").alias("i", "one")).filter(F.col("one.own") & where)
    start = F.greatest(F.col("i") - distance, F.lit(0))
    return placed.select("i", "one", start.alias("s"), F.slice("t", start + 1, F.col("i") + distance + 1 - start).alias("around"))


def pairs(tokens: DataFrame, attributes: Sequence[str], distance: int = 5, **how) -> DataFrame:
    """All ordered pairs of tokens of a sentence at most distance apart, unsummed: each attribute with 1 and with 2, date, gap."""
    return pairs_of(windows(tokens, attributes, distance, **how), attributes, distance)


def pairs_of(blocks: DataFrame, attributes: Sequence[str], distance: int = 5) -> DataFrame:
    """The pairs in windows of at least this distance. A condition on the first token, its attributes or date, is applied before any is met with another."""
    near = _around(blocks, distance, F.lit(True))
    # Neither array is empty, or its row falls out; the outer form spares the tests for that, which would make it twice more.
    met = near.select("i", "one", "s", F.posexplode_outer("around").alias("k", "two")).filter("s + k <> i and one.sentence <=> two.sentence")
    return met.select(*(F.col(f"one.{a}").alias(f"{a}1") for a in attributes), F.col("one.date").alias("date"), *(F.col(f"two.{a}").alias(f"{a}2") for a in attributes), (F.col("s") + F.col("k") - F.col("i")).alias("gap"))


def numbered(tokens: DataFrame, sentence: Sequence[str], order: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """The tokens with __at, their number in the order of sentence, order, date and attributes, without gaps. The sorted rows are written once, as what numbers
    them counts the rows of each partition first."""
    keys = list(dict.fromkeys((*sentence, *order, "date", *attributes)))
    ranged = tokens.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = written(ranged.withColumn("__n", F.monotonically_increasing_id()))
    part = F.shiftright("__n", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__size")).orderBy("__part").collect()
    starts = list(zip((r["__part"] for r in sizes), accumulate((r["__size"] for r in sizes), initial=0), strict=False))
    offsets = F.broadcast(tokens.sparkSession.createDataFrame(starts, "__part long, __start long"))
    return rows.withColumn("__part", part).join(offsets, "__part").select(*keys, (F.col("__start") + F.col("__n").bitwiseAND((1 << 33) - 1)).alias("__at"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's name in spark.checkpoint.dir, or, where that is unset and all runs on this machine, in a temporary folder."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="chronolex-")
    return f"{folder.rstrip('/')}/chronolex-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in a folder of its own."""
    path = scratch_path(df.sparkSession, "written")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cooccurrences(tokens: DataFrame, attributes: Sequence[str], distance: int = 5, **how) -> DataFrame:
    """attributes with 1, date, attributes with 2, f12, before any threshold."""
    return cooccurrences_of(windows(tokens, attributes, distance, **how), attributes, distance)


def cooccurrences_of(blocks: DataFrame, attributes: Sequence[str], distance: int = 5) -> DataFrame:
    found = pairs_of(blocks, attributes, distance)
    return found.groupBy(*(f"{a}1" for a in attributes), "date", *(f"{a}2" for a in attributes)).agg(F.count("*").alias("f12"))


def marginals_of(blocks: DataFrame, attributes: Sequence[str], distance: int = 5) -> DataFrame:
    """attributes, date, f1: what marginals() gives, from the number of neighbours that each token has in its sentence, so without making pairs."""

    def counted(x: Column, i: Column) -> Column:
        # A sentence's tokens stand together, so the farthest one of it on either side tells how many there are; mostly the first that is looked at.
        same = lambda k: F.get("t", i + k)["sentence"].eqNullSafe(x["sentence"])
        side = lambda sign: F.coalesce(*(F.when(same(sign * d), F.lit(d)) for d in range(distance, 0, -1)), F.lit(0))
        near = side(-1) + side(1)
        return F.struct(*(x[a].alias(a) for a in attributes), x["date"].alias("date"), F.when(x["own"], near).otherwise(0).cast("long").alias("n"))

    # Within each array, as rows of one token each would all carry it.
    counted = blocks.select(F.explode(F.transform("t", counted)).alias("x")).select("x.*")
    return counted.filter("n > 0").groupBy(*attributes, "date").agg(F.sum("n").alias("f1"))


def marginals(cof: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """attributes, date, f1: the sums over all partners. Take them before thresholding cof."""
    return cof.groupBy(*(F.col(f"{a}1").alias(a) for a in attributes), "date").agg(F.sum("f12").alias("f1"))


def thresholded(cof: DataFrame, minimum: int = 2) -> DataFrame:
    """Pairs that are frequent enough at one date."""
    return cof.filter(F.col("f12") >= minimum)


def term_segments(
    tokens: DataFrame, attributes: Sequence[str], segment: Sequence[str] = ("doc_id",), least: int = 4, most: float = float("inf"), document_min: int = 4, term_min: int = 0
) -> DataFrame:
    """attributes, segment, date, f: counts of terms in segments with more than least and fewer than most tokens, for terms in at least
    document_min such segments that occur at least term_min times in them. What is kept by size is written once, as the terms are told from it first, and so are these: few terms
    are broadcast then, and nothing is shuffled by term."""
    keys = list(dict.fromkeys((*segment, "doc_id")))
    counts = tokens.groupBy(*attributes, *keys, "date").agg(F.count("*").alias("f"))
    sized = tokens.groupBy(*segment).agg(F.count("*").alias("__n")).filter((F.col("__n") > max(least, 1)) & (F.col("__n") < most)).select(*segment)
    kept = counts.join(sized, list(segment), "left_semi")
    if document_min <= 1 and term_min <= 1:
        return kept
    kept = written(kept)
    terms = kept.groupBy(*attributes).agg(F.count("*").alias("__d"), F.sum("f").alias("__f")).filter((F.col("__d") >= document_min) & (F.col("__f") >= term_min))
    return kept.join(written(terms.select(*attributes)), list(attributes), "left_semi")


def term_years(tdf: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """attributes, date, f: what terms count in each year."""
    return tdf.groupBy(*attributes, "date").agg(F.sum("f").alias("f"))


def totals_by_date(counts: DataFrame, value: str) -> DataFrame:
    """date, n: the total of each date."""
    return counts.groupBy("date").agg(F.sum(value).alias("n"))
