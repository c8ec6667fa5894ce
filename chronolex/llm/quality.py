"""Quality rules by weak supervision, in DataFrame functions only.

Eight rules vote on each document that it is good (1), bad (-1), or abstain (0). Spark counts the vote patterns of all documents, of
which there are at most 3 ** 8; expectation-maximisation over the counts estimates how reliable each rule is. A document is kept if its posterior
probability of being good is one half or more and the base check doesn't fail it.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined cases: a null or empty text has no words and fails the base check; texts of any length are
whole; repeated rows each give a row; without rows the rules count as right nine times in ten; extra columns are ignored, also such
as bear a result's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, null_as_empty, picked, place, placed, stored, table
from .weak_labels import Reliability, estimate

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(grams: Column) -> Column:
    """Words in five-word windows whose hash occurs again, from the hashes of all windows. Most texts have none, so a set's size decides first."""
    placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, i: F.get(a, i)["h"]
    again = lambda a: F.filter(a, lambda x, i: F.coalesce(x["h"] == same(a, i + 1), F.lit(False)) | (i > 0) & F.coalesce(x["h"] == same(a, i - 1), F.lit(False)))
    starts = lambda a: F.sort_array(F.transform(again(a), lambda x: x["i"]))
    # Each window adds the words up to the next one's start, five at most.
    added = lambda s: F.transform(s, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(s, i + 1) - p, F.lit(5))))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  evaluates value once
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(once(placed, lambda a: once(starts(a), lambda s: total(added(s)))))


def measured(docs: DataFrame, text: str) -> DataFrame:
    """docs as the struct row, with the features of the column named text."""
    staged = docs.select(F.struct(*docs.columns).alias("row"), null_as_empty(F.col(text)).alias("text"))
    trimmed = F.btrim("text", F.lit(_BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))
    staged = staged.withColumn("words", words)
    grams = F.when(F.size("words") >= 5, F.transform(F.sequence(F.lit(1), F.size("words") - 4), lambda i: F.xxhash64(F.slice("words", i, 5)))).otherwise(F.array().cast("array<long>"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    staged = staged.withColumns({"grams": grams, "lines": lines})
    return staged.select(
        "row",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("grams")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        (F.length("text") - F.length(F.translate("text", "0123456789", ""))).cast("long").alias("n_digits"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("int")


def votes() -> list[Column]:
    """The eight rules; each says bad, good or nothing. Most can only object: that a text isn't odd in one way speaks little for it."""
    c, no = F.col, F.lit(False)
    long = c("n_words") >= 50
    return [
        _vote(c("n_words") < 10, no),
        _vote(100 * c("n_repeat_words") > 20 * c("n_words"), no),
        _vote(100 * c("n_symbols") > 10 * c("word_chars"), 100 * c("n_symbols") <= c("word_chars")),
        _vote(4 * c("n_symbols") > c("n_words"), 50 * c("n_symbols") <= c("n_words")),
        _vote(10 * c("n_dup_lines") > 3 * c("n_lines"), no),
        _vote((c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 12 * c("n_words")), no),
        _vote(100 * c("n_digits") > 30 * c("word_chars"), no),
        _vote(long & (5 * c("n_distinct") < c("n_words")), long & (10 * c("n_distinct") >= 4 * c("n_words"))),
    ]


def reliability(voted: DataFrame) -> Reliability:
    """EM over the counted patterns of the column votes."""
    counted = voted.groupBy("votes").count().collect()  # at most 3 ** 8 rows
    return estimate(sorted((tuple(r["votes"]), r["count"]) for r in counted), len(votes()))


def probability(model: Reliability) -> Column:
    """The posterior probability of being good, from the column votes."""
    start, each = model.weights()
    odds = F.lit(start)
    for r, (up, down) in enumerate(each):
        vote = F.get("votes", F.lit(r))
        odds = odds + F.when(vote > 0, F.lit(up)).when(vote < 0, F.lit(down)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def judged(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """row (of placed(docs), or of the doc_id only), the features, base_failed, quality (the posterior) and kept."""
    found = measured(placed(docs), place(docs, "text")) if with_text else measured(picked(docs, "doc_id", "text"), "text")
    row = F.col("row") if with_text else F.struct(F.col("row")["doc_id"].alias("doc_id"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    voted = stored(found.select(row.alias("row"), *FEATURES, base.alias("base_failed"), F.array(*votes()).alias("votes")), "quality")
    quality = probability(reliability(voted))
    return voted.select("row", *FEATURES, "base_failed", quality.alias("quality"), (~F.col("base_failed") & (quality >= 0.5)).alias("kept"))


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, whole, that are kept."""
    return judged(docs, with_text=True).filter("kept").select("row.*").toDF(*docs.columns)


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their features and the verdict."""
    return judged(table(spark, sf_dir, "documents")).select(F.col("row")["doc_id"].alias("doc_id"), *FEATURES, "base_failed", "kept", "quality")
