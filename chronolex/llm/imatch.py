"""I-Match fingerprints of documents and how alike two are, in DataFrame functions only.

Terms are a text's distinct words in lower case. The lexicon holds those within a band of inverse document frequency: in LEAST_DOCS documents or more and in one of
every SELDOM at most, counted over all documents. Random subsets of the lexicon are drawn by a hash of the term: it puts a term on a level, half of all terms on level 0, a quarter on level 1
and so on, and into one of SUBSETS subsets of that level. A text's terms in each subset are sorted and hashed together, so a subset's hash is equal if and only if two texts have the same terms of it.
All levels of all texts are kept, so every term of the lexicon that a text holds is in its fingerprint, however long the text is.

A fingerprint is the hashes of a text's subsets that hold a term. The likeness of two is the share of equal ones among the subsets which hold a term of either; long texts have more dense subsets, in which some
term always differs once a text is edited, so it falls with the logarithm of their length. A text without lexicon terms is told by a digest of the whole: such a one is like an equal text only.

Scale: the next document comes from windows over ranges of doc_id, into each of which the first row of the following range is copied; ties of doc_id are dealt to several ranges by a hash of the text. Terms are 64-bit
hashes. A text's terms are those of the lexicon but for two kinds. Those in too many documents, fewer than SELDOM for each word of an average text, are one broadcast row. Those that one document has alone
go to that one by the same ranges, so terms of texts are shuffled for the counts alone, as partial sums. The words that an edit makes where it cuts, two of a text at most, are looked up in the counts.

Defined cases: a null text is an empty one; an empty text, or one without lexicon terms, has a fingerprint by its digest; rows of equal doc_id (null first) follow each other by a
hash of their text; the last row is followed by the first, a row that is alone by itself; texts of any length are whole; an empty table gives no rows; extra columns are ignored, also such as bear a result's name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, null_as_empty, picked, stored, table

#: The band: documents that a term is in at least (two, so what falls short is in one alone), and one of how many at most (LEAST_DOCS in small tables).
LEAST_DOCS, SELDOM = 2, 20
#: Terms of a text above which its first levels would be left out: more than any array holds, so none are. Subsets on each level; the highest level.
TERMS, SUBSETS, LEVELS = 1 << 40, 16, 40
#: Documents of a range that a window looks through, and the bounds that ranges are laid between.
RANGE_ROWS, BOUNDS = 1 << 12, 256


def _words(text: Column) -> Column:
    return F.split(F.lower(text), f"{SPACE}+")


def _hashed(words: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def terms(text: Column) -> Column:
    """The hashes of a text's distinct words in lower case."""
    return _hashed(_words(text))


def level(term: Column) -> Column:
    """The level of a term: how many zeros its hash ends with."""
    return F.least(F.lit(LEVELS), F.bit_count(term.bitwiseAND(-term) - 1)).cast("int")


def _dealer(docs: DataFrame, rows: int) -> Callable[[DataFrame], DataFrame]:
    """What puts part to rows with at and key: parts ascend with at, then key, and hold about RANGE_ROWS of docs. Between two bounds parts are laid evenly; a value of at that is many bounds is
    laid out by its keys."""
    n = max(1, rows // RANGE_ROWS, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // 64))
    spans = min(n, BOUNDS)
    each = -(-n // spans)
    found = sorted(int(b) for b in docs.approxQuantile("at", [k / spans for k in range(spans + 1)], 0.1 / spans)) if rows else [0, 0]
    bounds = F.array(*(F.lit(b).cast("long") for b in found))

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("bounds", bounds)
        below = F.size(F.filter("bounds", lambda b: b < F.col("at")))
        same = F.size(F.filter("bounds", lambda b: b == F.col("at")))
        rows = rows.withColumns({"below": below, "same": same})
        low, high = F.get("bounds", F.col("below") - 1), F.get("bounds", "below")
        between = F.coalesce((F.col("at").cast("double") - low) / (high.cast("double") - low), F.lit(0.0))
        spread = F.col("same") > 1
        share = F.when(spread, (F.col("key") / F.lit(2.0**64) + 0.5) * (F.col("same") - 1)).otherwise(between)
        wide = F.when(spread, F.col("same") - 1).otherwise(F.lit(1))
        within = F.least(F.floor(share * each), (wide * each - 1).cast("long"))
        start = (F.col("below") + F.when(spread, 1).otherwise(0)).cast("long") * each
        return rows.withColumn("part", start + F.greatest(within, F.lit(0))).drop("bounds", "below", "same")

    return dealt


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.xxhash64("text"))


def _ranged(docs: DataFrame, rows: int) -> DataFrame:
    """docs (at, text) with key, a hash of the text, and part (see _dealer)."""
    return _dealer(docs, rows)(_keyed(docs))


def lexicon(docs: DataFrame, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs (at, key, text): the terms of the band; those that too many documents have; and, as only, those that the document of an at and key has alone."""
    found = docs.select("at", "key", F.explode(terms(F.col("text"))).alias("term"))
    counts = found.groupBy("term").agg(F.count("*").alias("docs"), F.min("at").alias("at"), F.min("key").alias("key"))
    seldom = F.col("docs") < LEAST_DOCS
    counts = stored(counts.select("term", "docs", *(F.when(seldom, F.col(c)).alias(c) for c in ("at", "key"))), "terms")
    most = max(LEAST_DOCS, rows // SELDOM)
    alone = counts.filter(seldom).groupBy("at", "key").agg(F.collect_list("term").alias("only"))
    return counts.filter(~seldom & (F.col("docs") <= most)).select("term"), counts.filter(F.col("docs") > most).select("term"), alone


def followed(docs: DataFrame, rows: int, alone: DataFrame, printed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of docs (doc_id, text, at, key): doc_id, text, only (see lexicon), own, which printed adds to these two, id, and next, next_only and next_own of the row that follows by ascending doc_id; the last is followed by the
    first. rows is how many there are."""
    dealt = _dealer(docs, rows)
    ranged = dealt(docs)
    firsts = ranged.groupBy("part").agg(F.min_by(F.struct("at", "key", "text"), F.struct("at", "key")).alias("first")).select("part", "first.*")
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A row a range; the first range's row goes behind the last range.
    before = ranged.select("part").distinct().withColumn("before", F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(every)))
    theirs = alone.join(F.broadcast(firsts.select("at", "key")), ["at", "key"], "left_semi")
    ghosts = firsts.join(theirs, ["at", "key"], "left").join(before, "part").select(F.col("before").alias("part"), "text", "only", F.col("part").alias("ghost"))
    # What a document has alone stands in a row of its own, without text, right before it: no other document of its at has its key.
    rows_in = ranged.unionByName(dealt(alone), allowMissingColumns=True).unionByName(ghosts, allowMissingColumns=True).withColumns({"last": F.col("ghost").isNotNull(), "held": F.col("text").isNotNull()})
    order = Window.partitionBy("part").orderBy("last", "at", "key")
    with_only = rows_in.withColumn("only", F.coalesce("only", F.lag("only").over(order.orderBy("last", "at", "key", "held")), F.array().cast("array<long>"))).filter("held")
    placed = printed(with_only).withColumns({"k": F.row_number().over(order)} | {f"next{n}": F.lead(c).over(order) for n, c in (("", "text"), ("_only", "only"), ("_own", "own"))})
    return placed.filter("ghost is null").select("doc_id", "text", "only", "own", (F.shiftleft("part", 32) + F.col("k")).alias("id"), "next", "next_only", "next_own")


def _kept(text: Column) -> Column:
    return F.left(text, (F.char_length(text) - _quarter(text)).cast("int"))


def _quarter(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4).cast("int")


def edited(text: Column, following: Column) -> Column:
    """text whose last quarter of characters gives way to as many, or all, from the start of the text that follows."""
    return F.concat(_kept(text), F.left(following, _quarter(text)))


def _code(term: Column) -> Column:
    """The subset of the lexicon that a term belongs to."""
    return level(term) * SUBSETS + F.pmod(F.shiftrightunsigned(term, 48), F.lit(SUBSETS)).cast("int")


def _once(value: Column, made: Callable[[Column], Column]) -> Column:
    """made of value, which is worked out once, also where made looks at it in each step of a loop."""
    return F.transform(F.array(value), made)[0]


def subset_hashes(found: Column) -> Column:
    """Of each subset that holds some of these terms its number, in the upper half, and a hash of its sorted terms, in the lower one. Terms are looked through level by level, then subset by subset."""
    placed = F.transform(F.sort_array(found), lambda t: F.struct(level(t).alias("level"), _code(t).alias("code"), t.alias("term")))
    held = lambda x, name: F.sort_array(F.array_distinct(F.transform(x, lambda p: p[name])))
    hashed = lambda x, code: F.xxhash64(F.transform(F.filter(x, lambda p: p["code"] == code), lambda p: p["term"]))
    subsets = lambda x: F.transform(held(x, "code"), lambda code: F.shiftleft(code.cast("long"), 32).bitwiseOR(hashed(x, code).bitwiseAND(F.lit(0xFFFFFFFF))))
    return _once(placed, lambda all_: F.flatten(F.transform(held(all_, "level"), lambda k: _once(F.filter(all_, lambda p: p["level"] == k), subsets))))


def likeness(one: Column, other: Column) -> Column:
    """0 to 1 for two structs of subsets (see subset_hashes) and digest (of the whole text)."""
    a, b = one["subsets"], other["subsets"]
    held = F.size(F.array_union(F.transform(a, lambda v: F.shiftright(v, 32)), F.transform(b, lambda v: F.shiftright(v, 32))))
    share = F.size(F.array_intersect(a, b)) / F.nullif(held, F.lit(0))
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(one["digest"] == other["digest"], F.lit(1.0)).when(none, F.lit(0.0)).otherwise(F.coalesce(share, F.lit(0.0)))


def as_text(print_: Column) -> Column:
    """A fingerprint as a string: its first level, which is 0, and the subsets' numbers and hashes, or the digest of a text without terms of the lexicon."""
    subsets = F.array_join(F.transform(print_["subsets"], lambda v: F.lower(F.hex(v))), ".")
    return F.when(F.size(print_["subsets"]) == 0, F.concat(F.lit("="), print_["digest"])).otherwise(F.concat(F.lit("0:"), subsets))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, the structs print and edited_print (subsets, digest), and near_next, how like print is to that of the next row."""
    narrow = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), null_as_empty(F.col("text")).alias("text"))
    rows = narrow.count()
    keyed = _keyed(narrow.withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63)))))
    band, common, alone = lexicon(keyed, rows)
    # A row, of which the plan has the value.
    common = F.coalesce(common.agg(F.collect_list("term")).scalar(), F.array().cast("array<long>"))
    own = F.struct(subset_hashes(F.array_except(terms(F.col("text")), "lacking")).alias("subsets"), F.sha2("text", 256).alias("digest"))
    both = followed(keyed, rows, alone, lambda x: x.withColumn("lacking", F.concat(common, "only")).withColumn("own", own).drop("lacking")).withColumns({"edited": edited(F.col("text"), F.col("next")), "before": F.regexp_count(_kept(F.col("text")), F.lit(f"{SPACE}+"))})
    both = both.withColumn("words", _words(F.col("edited")))
    # The word at the seam and the last one may be in neither text; all others are words of one of the two, so of them it is known what the lexicon lacks.
    whole = F.concat(F.slice("words", F.lit(1), F.col("before")), F.slice("words", F.col("before") + 2, F.greatest(F.size("words") - F.col("before") - 2, F.lit(0))))
    both = both.withColumns({"whole": _hashed(whole), "made": _hashed(F.array(F.get("words", "before"), F.element_at("words", -1))), "lacking": F.concat(common, F.col("only"), F.col("next_only"))})
    both = both.withColumns({"known": F.array_except("whole", "lacking"), "asked": F.array_except("made", F.concat("whole", "lacking"))})
    # Subsets that a word asked for may be in wait for the answer.
    both = both.withColumn("codes", F.transform("asked", _code)).withColumn("open", F.filter("known", lambda t: F.array_contains("codes", _code(t))))
    heads = stored(both.select("doc_id", "id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("own").alias("print"), likeness(F.col("own"), F.col("next_own")).alias("near_next"), subset_hashes(F.array_except("known", "open")).alias("closed"), "open", "asked"), "heads")
    found = heads.select("id", F.explode("asked").alias("term")).join(band, "term").groupBy("id").agg(F.collect_list("term").alias("found"))
    subsets = F.sort_array(F.concat("closed", subset_hashes(F.concat("open", F.coalesce("found", F.array().cast("array<long>"))))))
    return heads.join(found, "id", "left").select("doc_id", "n_chars", "edited_sha256", "print", F.struct(subsets.alias("subsets"), F.col("edited_sha256").alias("digest")).alias("edited_print"), "near_next")


def op13_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints before and after an edit, and how alike they are to the edited and to the next one."""
    found = fingerprints(table(spark, sf_dir, "documents"))
    one, other = F.col("print"), F.col("edited_print")
    return found.select("doc_id", "n_chars", "edited_sha256", as_text(one).alias("fingerprint"), as_text(other).alias("edited_fingerprint"), likeness(one, other).alias("near_edited"), "near_next")
