"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: tags, and the texts between block tags, each with the path of elements above it. A token's occurrence vector says how
often each page of its host holds it; Spark sums it up over all pages of the host, wherever they lie, as an exclusive or of numbers that pages and counts give, so
equal vectors have equal sums. Tokens with equal vectors on half of the pages or more form a class. A class is valid if it has enough
tokens (a text counts as its words do) and crosses no other's span; valid classes nest into the host's template. Its elements are slots, and each knows
how many words, links apart, all pages of the host have in it.

The main slot is the deepest element of the template, once on a page, that holds nearly all of the host's words, or most of them if it is an
``article`` or ``main``: names of elements and classes are evidence beside the words. On each page that has the template's tokens in their order, the text of
the main slot is extracted, without slots under elements that bear menus, headers, footers, sidebars, notices, adverts, forms or reader comments, and without
the template's own texts. A text is the template's if it stands beside LEAST_BODIES different rests of pages or more, on half of the host's pages, or, in an ``article`` or ``main`` element, on
NAMED_PAGES of them; so pages that are copies of each other have no such texts, and none goes if half of the slot would. Where no name tells the main slot, it is narrowed on each page to the elements inside that hold MOST of its words. Pages of hosts with fewer than LEAST_PAGES pages, and pages of another form than their
host's, are read by the evidence of element names alone.

Character references are decoded, white space in a block becomes one space, and blocks are joined in page order by two line feeds. Nothing depends on how
pages are dealt to tasks. What Spark sums for a host's template are the tokens on half of its pages, so about two pages' worth, however many there are.

Defined cases: a null html is an empty page with empty text, and no page of its host's template; a url that is
null or names no host forms a group of its own; pages of any length are whole; repeated rows, also with equal page_id and url, each give a row; unclosed
comments, scripts and tags end with the page; an empty table gives no rows; extra columns, also of clashing names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, null_as_empty, picked, stored, table

#: Pages that a host needs for a template, and a token to be in it; tokens that a class needs.
LEAST_PAGES, LEAST_TOKENS = 3, 3
#: Shares of the host's words that the main slot has: any element, and one that is named as such.
MOST, NAMED_MOST = 0.8, 0.5
#: Different pages, by all texts that are not under elements outside the article, that a text of the template stands on; the share of a host's pages with a text of the template inside an element named as the article; bits that different pages are told by.
LEAST_BODIES, NAMED_PAGES, BODIES = 5, 0.8, 62
#: Bytes of templates that are broadcast; beyond, pages and templates meet in a join over so many salts.
BROADCAST, SALTS = 32 << 20, 16
#: Tokens after which a task hands its sums on.
HELD = 1 << 19

_PIECE = re.compile(
    r"<!--(?:.*?-->|.*)|<![^>]*>|<\?[^>]*>"
    r"|<(script|style|noscript|template|textarea|iframe|svg|select|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_SPACED = frozenset("br td th img".split())
_MAIN = frozenset(("article", "main"))
#: Elements, roles and words of class names that mark what isn't the article.
_OUTSIDE = frozenset("nav footer aside form button dialog menu head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments "
    "respond disqus login search pagination pager toolbar widget masthead".split()
)
_NAME = re.compile(r"[A-Za-z]+")
#: Elements that the next of their kind closes.
_CLOSES_ITSELF = frozenset(("p", "li", "dt", "dd", "tr", "option"))


#: Elements that can be the main slot.
_CONTAINERS = frozenset("html body main article section div td table tbody tr center form".split())


@dataclass
class Block:
    """A stretch of text between two block tags: the elements around it, whether one is outside the article, or is the article."""

    under: tuple[int, ...]
    outside: bool
    inside: bool
    within: tuple[int, ...] = ()  # the numbers, on the page, of the containers around it
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def words(self) -> list[str]:
        return entities.unescape("".join(self.parts)).split()


@dataclass
class Page:
    tokens: list  # in order: pairs of a path and a tag or a block
    blocks: list[Block]


def _is_outside(name: str, attributes: str, in_main: bool) -> bool:
    if name in _OUTSIDE or name == "header" and not in_main:
        return True
    if "=" not in attributes:
        return False
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value = next(filter(None, values), "").lower()
        if kind.lower() == "role" and value in _ROLES or kind.lower() != "role" and not _NAMES.isdisjoint(_NAME.findall(value)):
            return name not in ("body", "html", "article", "main")
    return False


def read(page: str) -> Page:
    """The page's tags and blocks of text. Tags are (path, tag, depth of a container or 0, whether it is named as the article)."""
    stack: list[tuple] = [("", False, False, "", (), ())]  # name, outside, inside, path, tokens and numbers of the containers around
    tokens: list = []
    blocks: list[Block] = []
    block: Block | None = None
    at = links = 0

    def add(text: str) -> None:
        nonlocal block
        if block is None:
            if not text.strip():
                return
            block = Block(stack[-1][4], stack[-1][1], stack[-1][2], stack[-1][5])
            blocks.append(block)
            tokens.append((stack[-1][3], block))
        block.parts.append(text)
        if links:
            block.linked += len(text.split())

    for m in _PIECE.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not (name := m[3]):
            continue
        name = name.lower()
        if name in _SPACED:
            add(" ")
        if name in _BLOCKS:
            block, links = None, 0
        _, outside, inside, path, under, within = stack[-1]
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            if name == "a":
                links = 0
            tokens.append((stack[-1][3], f"</{name}>", 0, False))
        elif name in _VOID:
            tokens.append((path, f"<{name}>", 0, False))
        else:
            if name in _CLOSES_ITSELF and stack[-1][0] == name:
                stack.pop()
                _, outside, inside, path, under, within = stack[-1]
            if name in _MAIN and not inside and outside and not any(s[0] not in ("nav", "header", "div", "ul", "li") and s[1] for s in stack[1:]):
                outside = False  # an article ends a menu that was never closed
            attributes = m[4]
            tag = f"<{name}{attributes.strip() if 'class' in attributes or 'id' in attributes else ''}>"
            inside = inside or name in _MAIN and not outside
            outside_too = outside or _is_outside(name, attributes, inside)
            links += name == "a"
            container = name in _CONTAINERS and len(stack) < 40
            tokens.append((path, tag, len(stack) if container and not outside_too else 0, name in _MAIN))
            # Inline elements share their parent's path: words keep one place whatever is set in bold.
            stack.append((name, outside_too, inside, f"{path}/{name}" if name in _BLOCKS and len(stack) < 40 else path, *(((*under, key(path, tag)), (*within, m.start())) if container else (under, within))))
    if at < len(page):
        add(page[at:])
    return Page(tokens, blocks)


_keys: dict[tuple[str, str], int] = {}


def key(path: str, token: str) -> int:
    """The number of a token, not 0."""
    found = _keys.get((path, token))
    if found is None:
        if len(_keys) >= 1 << 16:
            _keys.clear()
        found = _keys[path, token] = (xxhash.xxh64_intdigest(f"{path}\0{token}") >> 1) | 1
    return found


#: What a token's row holds: pages with it, how often in all, the sum of its vector, of its first places, and of words in it; its depth as a container, whether it
#: is named as the article, how many words it has as a text, and bits for the different pages that have it as a text.
_SUMS = "host long, token long, pages long, n long, vector long, place double, mass long, depth int, named int, words int, bodies long"
_SUMS_ARROW = pa.schema([("host", pa.int64()), ("token", pa.int64()), ("pages", pa.int64()), ("n", pa.int64()), ("vector", pa.int64()), ("place", pa.float64()), ("mass", pa.int64()), ("depth", pa.int32()), ("named", pa.int32()), ("words", pa.int32()), ("bodies", pa.int64())])
_HOW = {"pages": np.add, "n": np.add, "vector": np.bitwise_xor, "place": np.add, "mass": np.add, "depth": np.maximum, "named": np.maximum, "words": np.maximum, "bodies": np.bitwise_or}


def seen(host: int, source: str, number: int) -> list[tuple]:
    """The rows of one page: of each token, and of the page as token 0. number stands for the page in vectors."""
    page = read(source)
    count, first, shape, mass, body = Counter(), {}, {}, Counter(), xxhash.xxh64()
    for k, (path, token, *rest) in enumerate(page.tokens):
        if isinstance(token, Block):
            words = token.words()
            if not words:
                continue
            t, kind = key(path, " ".join(words)) if len(words) < 64 else (xxhash.xxh64_intdigest(f"{path}\0{' '.join(words)}") >> 1) | 1, (0, 0, len(words))
            if not token.outside:
                body.update(" ".join(words) + "\0")
            if not token.outside and (own := len(words) - token.linked) > 0:
                mass[0] += own
                for u in dict.fromkeys(token.under):
                    mass[u] += own
        else:
            t, kind = key(path, token), (rest[0], int(rest[1]), 0)
        count[t] += 1
        first.setdefault(t, k)
        shape.setdefault(t, kind)
    if not count:
        return []
    total = len(page.tokens)
    vector = {n: xxhash.xxh64_intdigest(n.to_bytes(4, "little"), seed=number) - (1 << 63) for n in set(count.values())}
    bit = 1 << body.intdigest() % BODIES
    return [(host, 0, 1, 1, 0, 0.0, mass[0], 0, 0, 0, 0)] + [(host, t, 1, n, vector[n], first[t] / total, mass[t], *shape[t], bit if shape[t][2] else 0) for t, n in count.items()]


def summed(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of pages summed by host and token."""
    columns = {c: np.array(v, dtype=_SUMS_ARROW.field(c).type.to_pandas_dtype()) for c, v in zip(_SUMS_ARROW.names, zip(*rows, strict=True), strict=True)}
    order = np.lexsort((columns["token"], columns["host"]))
    columns = {c: v[order] for c, v in columns.items()}
    starts = np.flatnonzero(np.append(True, (np.diff(columns["host"]) != 0) | (np.diff(columns["token"]) != 0)))
    return pa.RecordBatch.from_arrays([pa.array(_HOW[c].reduceat(v, starts) if c in _HOW else v[starts]) for c, v in columns.items()], schema=_SUMS_ARROW)


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for batch in batches:
        for host, source, number in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "number")), strict=True):
            held += seen(host, source, number & 0xFFFFFFFFFFFFFFFF)
            if len(held) >= HELD:
                yield summed(held)
                held = []
    if held:
        yield summed(held)


@dataclass
class Template:
    """A host's main slot, whether its name says so too, the tokens of its class in order, and the texts of the template."""

    main: int | None = None
    named: bool = False
    frame: list[int] = field(default_factory=list)
    texts: list[int] = field(default_factory=list)


def classes(rows: list[dict]) -> list[list[dict]]:
    """Valid classes of a host's tokens, in order of their places; together they nest."""
    found: dict[int, list[dict]] = defaultdict(list)
    for r in rows:
        found[r["vector"]].append(r)
    valid: list[list[dict]] = []
    for members in sorted(found.values(), key=lambda m: (-max(r["pages"] for r in m), -len(m), min(r["token"] for r in m))):
        if sum(1 + r["words"] for r in members) < LEAST_TOKENS:
            continue
        members.sort(key=lambda r: (r["place"] / r["pages"], r["token"]))
        low, high = members[0]["place"] / members[0]["pages"], members[-1]["place"] / members[-1]["pages"]
        spans = [(c[0]["place"] / c[0]["pages"], c[-1]["place"] / c[-1]["pages"]) for c in valid]
        if all(high <= x or y <= low or x <= low and high <= y or low <= x and y <= high for x, y in spans):
            valid.append(members)
    return valid


def deduced(rows: list[dict]) -> Template:
    """The template from a host's rows: those of the tokens on half of its pages or more, and of token 0."""
    pages, total = next((r["pages"], r["mass"]) for r in rows if r["token"] == 0)
    out = Template()
    if pages < LEAST_PAGES:
        return out
    valid = classes([r for r in rows if r["token"] != 0 and 2 * r["pages"] >= pages])
    slots = [(r["depth"], r["mass"], r, c) for c in valid for r in c if r["depth"] and r["n"] == r["pages"] and r["mass"] >= (NAMED_MOST if r["named"] else MOST) * total]
    if total and slots:
        _, _, main, members = max(slots, key=lambda x: (x[2]["named"], x[0], x[1], x[2]["token"]))
        out.main, out.named = main["token"], bool(main["named"])
        out.frame = [r["token"] for r in members if not r["words"] and r["n"] == r["pages"]]
        often = pages * (NAMED_PAGES if out.named else 0.5)
        out.texts = [r["token"] for c in valid for r in c if r["words"] and r["pages"] >= often and r["bodies"].bit_count() >= LEAST_BODIES]
    return out


def by_template(page: Page, template: Template) -> list[str] | None:
    """The blocks of the main slot, or None if the page has another form than the template."""
    first: dict[int, int] = {}
    for k, (path, token, *_) in enumerate(page.tokens):
        if not isinstance(token, Block):
            first.setdefault(key(path, token), k)
    places = [first[t] for t in template.frame if t in first]
    if template.main not in first or any(a > b for a, b in zip(places, places[1:], strict=False)):
        return None
    own, kept, left_out = set(template.texts), [], 0
    inner = None if template.named else narrowed([b for b in page.blocks if not b.outside and template.main in b.under])
    for path, block in ((p, t) for p, t, *_ in page.tokens if isinstance(t, Block)):
        if block.outside or not path.endswith("/h1") and (template.main not in block.under or inner is not None and inner not in block.within):
            continue
        words = block.words()
        if words:
            text = " ".join(words)
            shared = bool(own) and (key(path, text) if len(words) < 64 else (xxhash.xxh64_intdigest(f"{path}\0{text}") >> 1) | 1) in own
            left_out += shared and len(words)
            kept.append((text, shared, len(words)))
    copies = 2 * left_out > sum(n for _, _, n in kept)
    return [text for text, shared, _ in kept if copies or not shared]


def narrowed(blocks: list[Block]) -> int | None:
    """The number of the innermost element that holds MOST of the words of these blocks, links apart, level by level; None if there is none inside theirs."""
    found, mass = None, {id(b): max(len(b.words()) - b.linked, 0) for b in blocks}
    level = min((len(b.within) for b in blocks), default=0)
    while level and len({b.within[:level] for b in blocks}) > 1:  # up to the element that is around all of them
        level -= 1
    while blocks:
        inside: dict[int, int] = defaultdict(int)
        for b in blocks:
            if len(b.within) > level:
                inside[b.within[level]] += mass[id(b)]
        best = max(inside, key=inside.get, default=None)
        if best is None or not inside[best] or inside[best] < MOST * sum(mass[id(b)] for b in blocks):
            return found
        found, level, blocks = best, level + 1, [b for b in blocks if len(b.within) > level and b.within[level] == best]
    return found


def by_names(page: Page) -> list[str]:
    """The blocks that elements' names and classes leave: those of an article or main element if there is one."""
    main = any(b.inside and not b.outside for b in page.blocks)
    found = (" ".join(b.words()) for b in page.blocks if not b.outside and (b.inside or not main))
    return [text for text in found if text]


def main_blocks(source: str, template: Template) -> tuple[list[str], bool]:
    """A page's blocks, and whether the template told them."""
    page = read(source)
    found = by_template(page, template) if template.main is not None else None
    return (by_names(page), False) if found is None else (found, True)


def texts(pages: list[str]) -> list[str]:
    """The main text of each of some pages of one host."""
    rows = [r for k, p in enumerate(pages) for r in seen(0, p, k)]
    template = deduced(summed(rows).to_pylist()) if rows else Template()
    return ["\n\n".join(main_blocks(p, template)[0]) for p in pages]


_TEMPLATE = "host long, main long, named boolean, frame array<long>, texts array<long>"
_TEMPLATE_ARROW = pa.schema([("host", pa.int64()), ("main", pa.int64()), ("named", pa.bool_()), ("frame", pa.list_(pa.int64())), ("texts", pa.list_(pa.int64()))])


def _deduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for host, rows in zip(batch.column("host").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            t = deduced(rows)
            if t.main is not None:
                yield pa.RecordBatch.from_pylist([{"host": host, "main": t.main, "named": t.named, "frame": t.frame, "texts": t.texts}], schema=_TEMPLATE_ARROW)


def templates(rows: DataFrame) -> DataFrame:
    """The template of each host that has one, from rows (host, html, number)."""
    found = rows.select("host", "html", "number").mapInArrow(_observed, _SUMS)
    how = {"pages": F.sum, "n": F.sum, "vector": F.bit_xor, "place": F.sum, "mass": F.sum, "depth": F.max, "named": F.max, "words": F.max, "bodies": F.bit_or}
    sums = found.groupBy("host", "token").agg(*(f(c).alias(c) for c, f in how.items()))
    often = stored(sums.filter((F.col("pages") >= LEAST_PAGES) | (F.col("token") == 0)), "tokens")
    hosts = often.filter(f"token = 0 and pages >= {LEAST_PAGES}").select("host", F.col("pages").alias("all"))
    half = often.join(hosts, "host").filter("2 * pages >= all").drop("all")
    # A token counts if half of the host's pages have it, so a host's list is as long as two of its pages at most.
    listed = half.groupBy("host").agg(F.collect_list(F.struct(*(c for c in half.columns if c != "host"))).alias("rows"))
    out = stored(listed.mapInArrow(_deduced, _TEMPLATE), "templates")
    forget(often)
    return out


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("by_template", pa.bool_())])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for source, main, named, frame, own in zip(*(batch.column(c).to_pylist() for c in ("html", "main", "named", "frame", "texts")), strict=True):
            found.append(main_blocks(source, Template(main, named or False, frame or [], own or [])))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(["\n\n".join(b) for b, _ in found], pa.string()), pa.array([t for _, t in found], pa.bool_())], schema=_OUT)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each page, and whether its host's template told it (by_template)."""
    pages = picked(pages, "page_id", "url", "html")
    url = F.col("url").cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    source = null_as_empty(F.col("html"))
    rows = pages.select(F.xxhash64(host).alias("host"), F.xxhash64("page_id", url, source).alias("number"), F.col("page_id").cast("long").alias("page_id"), url.alias("url"), source.alias("html"))
    found = templates(rows)
    size = found.select(F.sum(64 + 8 * (F.size("frame") + F.size("texts")))).first()[0] or 0
    if size <= BROADCAST:
        met = rows.join(F.broadcast(found), "host", "left")
    else:
        salt = F.pmod("number", F.lit(SALTS))
        met = rows.withColumn("salt", salt).join(found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["host", "salt"], "left")
    narrow = met.select("page_id", "url", "html", "main", "named", "frame", "texts")
    return narrow.mapInArrow(_extracted, "page_id long, url string, text string, by_template boolean")


def op1_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by_template")
