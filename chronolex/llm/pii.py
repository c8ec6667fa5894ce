"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from four fixed patterns. The method looks at them and at looser candidates, among them a fifth kind, secrets (keys and tokens). Five
labelers (a strict pattern, a check of digits, gazetteers of domains, networks, issuers, number plans and keys, the words before a span, and its shape) vote
that a candidate is personal data (1), is not (-1), or abstain (0). Spark counts the vote patterns; for each kind expectation-maximisation estimates how
reliable each labeler is, and its posteriors train a logistic span classifier on votes and digits. Candidates that it accepts are added unless they touch a
base span; base spans stay.

Starts and ends are code points, ends exclusive. Defined cases: a null or empty text has no spans; texts of any length are whole; a null doc_id is a row like
others; repeated rows each give a row; equal base spans of two kinds are both told; without any candidate the classifier accepts nothing; an empty table gives
no rows; extra columns, also of clashing names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import null_as_empty, picked, place, placed, stored, table
from .weak_labels import estimate, train

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: The contract's patterns. A run of its first class can only match from the run's start or where the last match ended, which spares the
#: engine quadratic retries, and possessive repeats take what plain ones take, as no repeat can be followed by what it holds.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"[\[({<]\x20?at\x20?[\])}>]", r"[\[({<]\x20?(?:dot|\.)\x20?[\])}>]"
#: Looser candidates: addresses whose signs are written with words, brackets or spaces; numbers of networks, cards and telephones with other separators or
#: without a plus sign; and long words of letters and digits, as keys and tokens are.
LOOSE = {
    "email": rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}(?:\x20?(?:{_AT})\x20?[{_HOST}]{{1,63}}(?:\x20?(?:\.|{_DOT}|\x20dot\x20)\x20?[{_HOST}]{{1,63}}){{1,8}}|\x20at\x20[{_HOST}]{{1,63}}(?:(?:\.|\x20dot\x20)[{_HOST}]{{1,63}}){{1,8}}|\x20@\x20?[{_HOST}]{{1,63}}(?:\.[{_HOST}]{{1,63}}){{1,8}})",
    "ip": rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?:(?:{_DOT}|\x20?\.\x20?|\x20dot\x20)[0-9]{{1,3}}){{3}}(?![0-9.])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{4}){2}[\x20._/-]{1,2}[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.,_/-])(?:00[1-9][0-9]{0,2}[\x20./-]?)?\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,8}){1,4}(?![0-9A-Za-z_])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9][A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,512}+={0,2}(?![A-Za-z0-9+/_=-])",
}
ALL_KINDS = (*KINDS, "secret")
#: What a text must hold for a pattern to be tried.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_TRIED = {"email": r"(?i)\bat\b|\x20@", "ip": r"(?i)[0-9][\x20\[({<]{0,2}(?:\.|dot)", "card": r"[0-9]{4}[\x20._/-]{1,2}[0-9]{4}", "phone": r"[0-9]\)?[\x20./-]{1,2}[0-9]{2}", "secret": r"[A-Za-z0-9+/_-]{20}"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Gazetteers (fixed values): generic top-level domains, beside which any two letters name a country; first numbers of networks that no host on the Internet
#: has; issuers' first digits; country codes; how keys and tokens of well-known services start.
_DOMAINS = r"(?i)(?:\.|dot\x20?[\])}>]?\x20?|[\])}>]\x20?)(?:com|org|net|edu|gov|mil|int|info|biz|name|pro|mobi|travel|museum|aero|coop|jobs|cat|tel|asia|post|app|dev|blog|shop|site|online|store|tech|cloud|xyz|club|live|news|email|world|space|agency|company|digital|group|life|network|systems|today|wiki|[a-z]{2})$"
_PRIVATE = r"^0*(?:0|10|127|2[2-5][0-9])[^0-9]"
_ISSUERS = r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|(?:6011|65|64|35)[0-9]{12,15}|3[068][0-9]{12})$"
_COUNTRIES = r"^(?:\+|00)\s?\(?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9])"
_NATIONAL = r"^(?:\(?[2-9][0-9]{2}\)?[\x20./-]{1,2}[2-9][0-9]{2}[\x20./-][0-9]{4}|\(?0[1-9][0-9]{1,4}\)?[\x20./-]{1,2}[0-9]{2,8}(?:[\x20./-][0-9]{2,5}){0,3})$"
_KEYS = r"^(?:AKIA[0-9A-Z]{16}|gh[opsu]_\w{30,}|xox[abp]-.+|sk_(?:live|test)_\w+|sk-\w{20,}|AIza.{30,}|eyJ.+)$"
#: Words before a span that speak for it or against it.
_FOR = {
    "email": r"(?i)(?:mail|contact|write|courriel|correo|kontakt|reach)",
    "ip": r"(?i)(?:\bip\b|host|server|address|adresse|client|login|ping)",
    "card": r"(?i)(?:card|karte|carte|tarjeta|visa|master|credit|pay)",
    "phone": r"(?i)(?:phone|\btel|\bcall|\bfax|mobil|\bcell|\bruf|appel|llam)",
    "secret": r"(?i)(?:token|secret|key|passw(?:or)?d|pwd|bearer|credential|auth)[\w\x20\"']{0,12}[=:]?[\x20\"']{0,3}$",
}
_AGAINST = r"(?i)(?:version|\bv\.?\s*$|isbn|issn|order|invoice|section|figure|table|no\.\s*$|#\s*$|id\s*[=:]\s*$|date|since|sha[0-9]*|md5|checksum|commit|hash|https?:\S*$)"
_BEFORE = 32
#: The classifier's threshold for spans that the base patterns don't have.
ACCEPT = 0.75
_SPAN = "struct<kind:string,s:int,e:int,t:string>"
#: Items that one step of a scan takes in.
_TOGETHER = 256


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), which is computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scanned(items: Column, step: Callable[[Column, Column], tuple[Column, Column]], made: str) -> Column:
    """A scan from 0: step gives the next number and an array of what comes out, from the number and an item. Chunks of items go into arrays of their own, so
    that time and memory grow in proportion to the items."""
    empty = F.array().cast(f"array<{made}>")

    def one(state: Column, x: Column) -> Column:
        at, out = step(state["at"], x)
        return F.struct(at.cast("int").alias("at"), F.concat(state["out"], out).alias("out"))

    def chunk(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state["at"].alias("at"), empty.alias("out")), one)
        return _once(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], F.array(r["out"])).alias("out")))

    def whole(a: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _TOGETHER).cast("int")), lambda k: F.slice(a, k * _TOGETHER + 1, F.lit(_TOGETHER)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{made}>>").alias("out"))
        return F.when(F.size(a) > 0, F.flatten(F.aggregate(parts, start, chunk)["out"])).otherwise(empty)

    return _once(items, whole)


def _found(text: Column, kind: str, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches with their places: what stands between the matches gives the offsets."""
    hits, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(at: Column, one: Column) -> tuple[Column, Column]:
        s = at + F.length(one["gap"])
        e = s + F.length(one["hit"])
        span = F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), one["hit"].alias("t")).cast(_SPAN)
        return e, F.array(span) if keep is None else F.when(keep(one["hit"]), F.array(span)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    pairs = F.filter(F.arrays_zip(between.alias("gap"), hits.alias("hit")), lambda x: x["hit"].isNotNull())
    return _scanned(pairs, step, _SPAN)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backward = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(backward, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _holds(kind: str, t: Column) -> Column:
    n = F.length(_digits(t))
    if kind == "ip":
        return t.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(t))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """The contract's spans, by kind as listed, then start."""
    none = F.array().cast(f"array<{_SPAN}>")

    def of(kind: str) -> Column:
        found = _found(text, kind, BASE[kind], lambda t: _holds(kind, t))
        return F.when(text.contains("@") if kind == "email" else text.rlike(_NEEDS[kind]), found).otherwise(none)

    return F.concat(*map(of, KINDS))


def loose_spans(text: Column) -> Column:
    none = F.array().cast(f"array<{_SPAN}>")
    size = lambda k: (lambda t: F.length(_digits(t)).between(9 if k == "phone" else 13, 15 if k == "phone" else 19)) if k in ("phone", "card") else None
    return F.concat(*(F.when(text.rlike(_TRIED[k]), _found(text, k, LOOSE[k], size(k))).otherwise(none) for k in LOOSE))


def _by_kind(x: Column, of: dict[str, Column], otherwise: Column) -> Column:
    for k, v in of.items():
        otherwise = F.when(x["kind"] == k, v).otherwise(otherwise)
    return otherwise


def _candidate(text: Column, x: Column, base: bool) -> Column:
    """A span with the votes of five labelers and its shape. A labeler that knows nothing of a kind, or of a span, abstains."""
    before = F.substring(text, F.greatest(x["s"] - _BEFORE, F.lit(0)) + 1, F.least(x["s"], F.lit(_BEFORE)))
    t, digits = x["t"], _digits(x["t"])
    yes, no, nothing = F.lit(1), F.lit(-1), F.lit(0)
    octets = F.regexp_replace(t, r"(?i)[^0-9]+", ".").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    check = _by_kind(x, {"email": F.when(t.rlike(_DOMAINS), nothing).otherwise(no), "ip": F.when(octets, nothing).otherwise(no), "card": F.when(_luhn(digits), yes).otherwise(no)}, nothing)
    gazetteer = _by_kind(x, {
        "email": F.when(t.rlike(_DOMAINS), yes).otherwise(nothing), "ip": F.when(t.rlike(_PRIVATE), no).otherwise(nothing), "card": F.when(digits.rlike(_ISSUERS), yes).otherwise(no),
        "phone": F.when(t.rlike(_COUNTRIES) | t.rlike(_NATIONAL), yes).when(t.startswith("+"), nothing).otherwise(no), "secret": F.when(t.rlike(_KEYS), yes).otherwise(nothing),
    }, nothing)
    context = F.when(before.rlike(_AGAINST), no).when(_by_kind(x, {k: before.rlike(v) for k, v in _FOR.items()}, F.lit(False)), yes).otherwise(nothing)
    dull = digits.rlike(r"^([0-9])\1*$") | digits.rlike("^(?:0?123456789|9876543210?)")
    date = t.rlike(r"^(?:(?:19|20)[0-9]{2}[\x20./-](?:0?[1-9]|1[0-2])[\x20./-][0-9]{1,2}|[0-9]{1,2}[\x20./-][0-9]{1,2}[\x20./-](?:19|20)[0-9]{2})")
    mixed = t.rlike("[0-9].*[0-9]") & t.rlike("[A-Za-z].*[A-Za-z]") & ~t.rlike("[a-z]{8}") & ~t.rlike("/.*/")
    shape = _by_kind(x, {
        "email": F.when(t.rlike(r"[\[({<]|@"), yes).otherwise(nothing),
        "ip": F.when(t.rlike(r"^[0-9]\D+[0-9]\D+[0-9]\D+[0-9]$"), no).when(octets & t.rlike("[0-9]{2}.*[0-9]{2}"), yes).otherwise(nothing), "card": F.when(dull, no).otherwise(nothing), "phone": F.when(dull | date, no).otherwise(nothing),
        "secret": F.when(t.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.when(F.length(t).isin(32, 40, 64), yes).otherwise(nothing)).when(mixed, yes).otherwise(no),
    }, nothing)
    return F.struct(
        x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(base).alias("base"), F.lit(1 if base else 0).cast("int").alias("strict"), check.cast("int").alias("check"),
        gazetteer.cast("int").alias("gazetteer"), context.cast("int").alias("context"), shape.cast("int").alias("shape"), F.least(F.length(digits) / 4, F.lit(4)).cast("int").alias("digits"),
    )


_VOTES = ("strict", "check", "gazetteer", "context", "shape")
#: How often each labeler is taken to be right before the data speak.
_START = (0.97, 0.97, 0.85, 0.95, 0.85)
_SHAPE = ("kind", *_VOTES, "digits")


def candidates(docs: DataFrame, text: Column, keep: Column) -> DataFrame:
    """keep as row, and the candidate spans of each text: base ones first, then loose ones that touch none."""
    staged = docs.select(keep.alias("row"), null_as_empty(text).alias("text")).withColumns({"base": base_spans(F.col("text")), "loose": loose_spans(F.col("text"))})
    apart = lambda x: ~F.exists("base", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    spans = F.concat(F.transform("base", lambda x: _candidate(F.col("text"), x, True)), F.transform(F.filter("loose", apart), lambda x: _candidate(F.col("text"), x, False)))
    return staged.select("row", spans.alias("spans"))


def _features(row: dict) -> list[float]:
    """What the span classifier sees: the votes but for the strict one, which all base spans have, and the number of digits."""
    out = []
    for v in _VOTES[1:]:
        out += [float(row[v] > 0), float(row[v] < 0)]
    return [*out, *(float(row["digits"] == n) for n in range(5))]


def classifier(found: DataFrame) -> Callable[[Column], Column]:
    """Whether a candidate is personal data. For each kind: EM over counted votes, then a span classifier trained on its posteriors."""
    shapes = found.select(F.explode("spans").alias("x")).groupBy(*(F.col("x")[n].alias(n) for n in _SHAPE)).count().collect()  # at most 5 * 243 * 5 rows
    rows = sorted((r.asDict() for r in shapes), key=str)
    weights = {}
    for kind in sorted({r["kind"] for r in rows}):
        mine = [r for r in rows if r["kind"] == kind]
        votes = lambda r: tuple(r[v] for v in _VOTES)
        model = estimate([(votes(r), r["count"]) for r in mine], len(_VOTES), 0.5, _START, 1.0)
        weights[kind] = train([(_features(r), model.posterior(votes(r)), r["count"]) for r in mine])

    def accept(x: Column) -> Column:
        named = [c for v in _VOTES[1:] for c in (x[v] > 0, x[v] < 0)] + [x["digits"] == n for n in range(5)]
        sure = F.lit(False)
        for kind, (constant, *each) in weights.items():
            odds = F.lit(constant)
            for c, w in zip(named, each, strict=True):
                odds = odds + F.when(c, F.lit(w)).otherwise(F.lit(0.0))
            sure = F.when(x["kind"] == kind, F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)) >= ACCEPT).otherwise(sure)
        return sure

    return accept


def _ordered(x: Column) -> Column:
    kind = F.array_position(F.array(*map(F.lit, ALL_KINDS)), x["kind"]).cast("int")
    return F.struct(kind.alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"), x["kind"].alias("kind"))


def accepted(found: DataFrame, fitted_on: DataFrame | None = None) -> DataFrame:
    """row and spans (k, s, e, base, kind): all base spans and the accepted others, by kind as listed, then start. Of accepted ones that touch, the
    earliest kind's stays. The classifier is fitted on these candidates unless others are given."""
    accept = classifier(found if fitted_on is None else fitted_on)
    taken = F.filter("spans", lambda x: x["base"] | accept(x))
    ordered = found.select("row", F.array_sort(F.transform(taken, _ordered)).alias("all"))
    first = lambda x: x["base"] | ~F.exists("all", lambda y: ~y["base"] & (y["k"] < x["k"]) & (y["s"] < x["e"]) & (x["s"] < y["e"]))
    return ordered.select("row", F.filter("all", first).alias("spans"))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def masked_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs with each span of their texts replaced by its kind in brackets; spans that overlap become one, of the first one's kind. n_chars, where
    there is such a column, is the new length; a null text stays null."""
    whole, name = placed(docs), place(docs, "text")
    found = accepted(stored(candidates(whole, F.col(name), F.struct(*whole.columns)), "masked"))
    text = F.col("row")[name]
    made = "struct<a:int,s:int,kind:string>"
    in_order = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))

    def outermost(at: Column, x: Column) -> tuple[Column, Column]:
        piece = F.array(F.struct(at.alias("a"), x["s"].alias("s"), x["kind"].alias("kind")).cast(made))
        return F.greatest(at, -x["e"]), F.when(x["s"] >= at, piece).otherwise(F.array().cast(f"array<{made}>"))

    merged = found.withColumns({"merged": _scanned(in_order, outermost, made), "end": F.coalesce(F.array_max(F.transform("spans", lambda x: x["e"])), F.lit(0))})
    pieces = F.transform("merged", lambda x: F.concat(F.substring(text, x["a"] + 1, x["s"] - x["a"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    masked = F.when(F.size("spans") == 0, text).otherwise(F.concat(F.array_join(pieces, ""), F.substring(text, F.col("end") + 1, F.length(text))))
    value = {name: F.col("text")}
    if "n_chars" in docs.columns:
        size = place(docs, "n_chars")
        value[size] = F.coalesce(F.length("text").cast("long"), F.col("row")[size])
    changed = merged.select("row", masked.alias("text"))
    return changed.select(*(value.get(c, F.col("row")[c]).alias(c) for c in whole.columns)).toDF(*docs.columns)


def op6_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the number of base spans of each kind, the base spans' digest, all spans, and how many of these the method added."""
    docs = picked(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = accepted(stored(candidates(docs, F.col("text"), F.col("doc_id")), "pii"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    base = _told(F.filter("spans", lambda x: x["base"]))
    added = F.size(F.filter("spans", lambda x: ~x["base"])).cast("long").alias("n_added")
    return found.select(F.col("row").alias("doc_id"), *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), added)
