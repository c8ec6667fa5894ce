"""Boolean and concordance requests as users type them, read into trees that tell their conditions as columns.

Tokens are words with an attribute or without (``Haus``, ``$p=NN``, ``p=NN``, ``a|b``, ``{a,b}``, ``Haus*``, ``*haus``, ``*au*``, ``/re/i``, ``$l``, ``*``), each with a match id at will (``Haus=2``).
What binds closest comes first: ``!``, then ``WITH`` and ``WITHOUT`` (``&=``, ``&!=``) on one token, then ``&&`` on one document, then ``||``; brackets group. A comma is a WITH; what merely stands
side by side is a WITH too, unless the request has a ``&&`` somewhere. ``near(a,b,3)`` and ``"a #2 b #>4 c"`` are tokens around and after each other. ``#has[field,value]`` and ``!#has[...]`` tell of documents;
``#date[1900,1909]`` of dates; ``#fmin 2``, ``#dmax 3``, ``#coef 4``, ``#limit 5`` and ``#sample 6`` are options. A match id of brackets holds for the tokens inside that have none.

str() of a tree is the canonical form, which reads back as the same tree."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import predicates as P

#: An attribute's column.
Columns = Callable[[str], Column]


def quoted(word: str) -> str:
    """A word with what could be read as something else behind backslashes."""
    plain = re.sub(r"([^\w.\-])", r"\\\1", word)
    return "\\" + plain if re.fullmatch("with|without|and|or|not|near", plain, re.I) else plain


class Tree:
    """A part of a request."""

    match: int = 0

    def _marked(self, text: str) -> str:
        return f"{text}={self.match}" if self.match else text

    def parts(self) -> tuple[Tree, ...]:
        return ()

    def tokens(self) -> list[Token]:
        return [self] if isinstance(self, Token) else [t for p in self.parts() for t in p.tokens()]

    def condition(self, of: Columns, default: str) -> Column:
        """Whether a token is taken in."""
        raise ValueError(f"{self} can't be told from one token")


@dataclass(frozen=True)
class Token(Tree):
    kind: str  # exact, set, regex, prefix, suffix, infix or any
    values: tuple[str, ...] = ()
    attribute: str | None = None
    match: int = 0

    def predicate(self) -> P.Predicate:
        made = {"exact": lambda v: P.exact(v[0]), "set": P.any_of, "regex": lambda v: P.regex(*v), "prefix": P.prefix, "suffix": P.suffix, "infix": P.infix, "any": lambda v: P.anything()}
        return made[self.kind](self.values)

    def condition(self, of: Columns, default: str) -> Column:
        return self.predicate()(of(self.attribute or default))

    def __str__(self) -> str:
        words = [quoted(v) for v in self.values]
        value = {"any": lambda: "*", "exact": lambda: words[0], "set": lambda: "{" + ",".join(words) + "}", "prefix": lambda: words[0] + "*", "suffix": lambda: "*" + words[0], "infix": lambda: f"*{words[0]}*",
                 "regex": lambda: "/" + re.sub(r"(\\.)|/", lambda m: m[1] or r"\/", self.values[0], flags=re.S) + "/" + self.values[1]}[self.kind]()
        return self._marked(f"${quoted(self.attribute)}={value}" if self.attribute else value)


@dataclass(frozen=True)
class Pair(Tree):
    """op: WITH and WITHOUT on one token, && and || on one document."""

    op: str
    a: Tree
    b: Tree
    match: int = 0

    def parts(self) -> tuple[Tree, ...]:
        return self.a, self.b

    def condition(self, of: Columns, default: str) -> Column:
        if self.op == "&&":
            return super().condition(of, default)
        a, b = self.a.condition(of, default), self.b.condition(of, default)
        return {"WITH": lambda: a & b, "WITHOUT": lambda: a & ~b, "||": lambda: a | b}[self.op]()

    def __str__(self) -> str:
        return self._marked(f"({self.a} {self.op} {self.b})")


@dataclass(frozen=True)
class Not(Tree):
    a: Tree

    def parts(self) -> tuple[Tree, ...]:
        return (self.a,)

    def condition(self, of: Columns, default: str) -> Column:
        return ~self.a.condition(of, default)

    def __str__(self) -> str:
        return f"!{self.a}"


@dataclass(frozen=True)
class Near(Tree):
    """Two tokens with between others between them at most, in any order."""

    a: Tree
    b: Tree
    between: int

    def parts(self) -> tuple[Tree, ...]:
        return self.a, self.b

    def __str__(self) -> str:
        return f"near({self.a},{self.b},{self.between})"


@dataclass(frozen=True)
class Sequence(Tree):
    """Tokens in order; gaps has for each but the first how many others stand before it: (op, n) for at most, ``<``, more than, ``>``, or exactly, ``=``."""

    items: tuple[Tree, ...]
    gaps: tuple[tuple[str, int], ...]

    def parts(self) -> tuple[Tree, ...]:
        return self.items

    def __str__(self) -> str:
        out = [str(self.items[0])]
        for (op, n), item in zip(self.gaps, self.items[1:], strict=True):
            out += [*([] if (op, n) == ("<", 0) else [f"#{'' if op == '<' else op}{n}"]), str(item)]
        return '"' + " ".join(out) + '"'


@dataclass(frozen=True)
class Has:
    """What a field of a document's metadata is, or, negated, isn't."""

    field: str
    value: Token
    negated: bool = False

    def predicate(self) -> P.Predicate:
        return P.negated(self.value.predicate()) if self.negated else self.value.predicate()

    def __str__(self) -> str:
        return f"{'!' if self.negated else ''}#has[{quoted(self.field)},{self.value}]"


OPTIONS = ("fmin", "dmax", "coef", "limit", "sample")


@dataclass(frozen=True)
class Request:
    """tree is None for a request of documents alone."""

    tree: Tree | None
    filters: tuple[Has, ...] = ()
    options: dict[str, float] = field(default_factory=dict)
    dates: tuple | None = None  # the first and the last, or None for an open end

    def where(self, default: str) -> Callable[[Columns], Column]:
        """The condition on a token, given the attributes' columns."""
        return lambda of: F.lit(True) if self.tree is None else self.tree.condition(of, default)

    def __str__(self) -> str:
        options = [f"#{k} {v:g}" for k, v in sorted(self.options.items())]
        if self.dates is not None:
            options.insert(0, f"#date[{','.join('*' if x is None else str(x) for x in self.dates)}]")
        return " ".join([str(self.tree) if self.tree is not None else "*", *map(str, self.filters), *options])


_WORD = r"(?:\\.|[^\s,|&!()\[\]{}\"#=*\\])+"
_NAME = re.compile(rf"\s*(?:\$(?P<sure>(?:\\.|[\w.\-])+)(?:\s*=(?!\s*=))?|(?P<maybe>(?:\\.|[\w.\-])+)\s*=(?!\s*\d+(?![^\s,|&)\]\"])))\s*")
_SET = re.compile(r"\s*\{((?:\\.|[^}\\])*)\}", re.S)
_OF_SET = re.compile(r"(?:\\.|[^\s,\\])(?:(?:\\.|[^,\\])*(?:\\.|[^\s,\\]))?", re.S)
_REGEX = re.compile(r"\s*/((?:\\.|[^/\\])*)/([a-z]*)", re.S)
_VALUE = re.compile(rf"\s*@?(\*?)({_WORD})?(\*?)((?:\s*\|(?!\|)\s*{_WORD})*)")
_GAP = re.compile(r"\s*#([<>=]?)\s*(\d+)")
_HAS = re.compile(r"\s*(!?)\s*#has\s*\[\s*((?:\\.|[^,\\\]])+?)\s*,", re.I)
_OPTION = re.compile(r"\s*#(fmin|cfmin|dmax|distmax|coef|fcoef|limit|sample|samp|sep(?:arate)?(?:_hits)?|nojoin(?:_hits)?)\b\s*\[?\s*([\d.]+(?:e[+-]?\d+)?)?\s*\]?", re.I)
_DATE = re.compile(r"\s*#date\s*\[\s*(\d+|\*)\s*,\s*(\d+|\*)\s*\]", re.I)
_ALIAS = {"cfmin": "fmin", "distmax": "dmax", "fcoef": "coef", "samp": "sample"}


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.filters, self.options, self.dates = text, 0, [], {}, None

    def accept(self, pattern: str) -> re.Match | None:
        m = re.compile(rf"\s*(?:{pattern})", re.I).match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def peek(self, pattern: str) -> bool:
        return re.compile(rf"\s*(?:{pattern})", re.I).match(self.text, self.at) is not None

    def need(self, pattern: str) -> re.Match:
        m = self.accept(pattern)
        if m is None:
            raise ValueError(f"can't read the request from {self.text[self.at:]!r} on")
        return m

    def extras(self) -> None:
        """Filters and options, which may stand after any part."""
        while True:
            if m := _HAS.match(self.text, self.at):
                self.at = m.end()
                value = self.value(None)
                self.need(r"\]")
                self.filters.append(Has(_plain(m[2]).strip(), value, bool(m[1])))
            elif m := _DATE.match(self.text, self.at):
                self.at = m.end()
                self.dates = tuple(None if x == "*" else int(x) for x in m.groups())
            elif m := _OPTION.match(self.text, self.at):
                self.at = m.end()
                if m[2] is not None:
                    self.options[_ALIAS.get(m[1].lower(), m[1].lower())] = float(m[2])
            else:
                return

    def any_of(self, comma: bool) -> Tree:
        out = self.all_of(comma)
        while self.accept(r"\|\||OR\b"):
            out = Pair("||", out, self.all_of(comma))
        return out

    def all_of(self, comma: bool) -> Tree:
        out = self.on_token()
        while True:
            self.extras()
            if self.accept(r"&&|AND\b"):
                out = Pair("&&", out, self.on_token())
            elif comma and self.accept(","):
                if not self.peek(r"$|\)|\]"):
                    out = Pair("WITH", out, self.on_token())
            elif not self.peek(r"$|\)|\]|\"|,|\|\||OR\b|=|#"):
                out = Pair("&&", out, self.on_token())
            else:
                return out

    def on_token(self) -> Tree:
        out = self.unary()
        while True:
            if self.accept(r"&!=|WITHOUT\b"):
                out = Pair("WITHOUT", out, self.unary())
            elif self.accept(r"&=|WITH\b"):
                out = Pair("WITH", out, self.unary())
            else:
                return out

    def unary(self) -> Tree:
        self.extras()
        if self.accept(r"!|NOT\b"):
            return Not(self.unary())
        return self.primary()

    def primary(self) -> Tree:
        if m := self.accept(r"[(\[]"):
            out = self.any_of(True)
            self.need({"(": r"\)", "[": r"\]"}[m[0].strip()])
            return self.marked(out)
        if self.accept(r"near\s*\("):
            a = self.any_of(False)
            self.need(",")
            b = self.any_of(False)
            n = self.need(r",\s*(\d+)\s*\)")
            return Near(a, b, int(n[1]))
        if self.accept('"'):
            items, gaps = [self.on_token()], []
            while not self.accept('"'):
                m = _GAP.match(self.text, self.at)
                self.at = m.end() if m else self.at
                gaps.append((m[1] or "<", int(m[2])) if m else ("<", 0))
                items.append(self.on_token())
            return items[0] if len(items) == 1 else Sequence(tuple(items), tuple(gaps))
        name = _NAME.match(self.text, self.at)
        attribute = None
        if name:
            self.at = name.end()
            attribute = _plain(name["sure"] or name["maybe"])
            if name["sure"] and "=" not in name[0]:
                return Token("any", (), attribute)
        return self.marked(self.value(attribute))

    def value(self, attribute: str | None) -> Token:
        for pattern, made in ((_SET, lambda m: ("set", tuple(map(_plain, _OF_SET.findall(m[1]))))), (_REGEX, lambda m: ("regex", (m[1].replace("\\/", "/"), m[2])))):
            if m := pattern.match(self.text, self.at):
                self.at = m.end()
                return Token(*made(m), attribute)
        m = _VALUE.match(self.text, self.at)
        if not m or not (m[1] or m[2]):
            raise ValueError(f"can't read the request from {self.text[self.at:]!r} on")
        self.at = m.end()
        if m[4]:
            return Token("set", tuple(_plain(w) for w in (m[2], *re.findall(_WORD, m[4]))), attribute)
        if not m[2]:
            return Token("any", (), attribute)
        kind = {(True, True): "infix", (True, False): "suffix", (False, True): "prefix", (False, False): "exact"}[bool(m[1]), bool(m[3])]
        return Token(kind, (_plain(m[2]),), attribute)

    def marked(self, tree: Tree) -> Tree:
        m = self.accept(r"=\s*(\d+)(?![^\s,|&)\]\"])")
        return _with_match(tree, int(m[1])) if m else tree


def _with_match(tree: Tree, match: int) -> Tree:
    """tree with a match id for all tokens in it that have none."""
    if isinstance(tree, Token):
        return tree if tree.match else replace(tree, match=match)
    if isinstance(tree, Pair):
        return replace(tree, a=_with_match(tree.a, match), b=_with_match(tree.b, match))
    return Not(_with_match(tree.a, match)) if isinstance(tree, Not) else tree


def _on_one_token(tree: Tree) -> Tree:
    """tree with WITH in place of &&."""
    if isinstance(tree, Pair):
        return replace(tree, op="WITH" if tree.op == "&&" else tree.op, a=_on_one_token(tree.a), b=_on_one_token(tree.b))
    return Not(_on_one_token(tree.a)) if isinstance(tree, Not) else tree


def parse(text: str) -> Request:
    """The tree of a request."""
    reader = _Reader(text)
    reader.extras()
    tree = None if reader.peek("$") else reader.any_of(True)
    reader.extras()
    reader.need("$")
    if tree is not None and "&&" not in text:
        tree = _on_one_token(tree)
    if isinstance(tree, Token) and tree.kind == "any" and not tree.match and reader.filters:
        tree = None  # all tokens of some documents
    return Request(tree, tuple(reader.filters), reader.options, reader.dates)


def is_boolean(text: str) -> bool:
    """Whether a request is more than clauses that all hold on one token."""
    return re.search(r"[()\[{\"!#]|&&|&=|\|\||\bWITHOUT\b|\bOR\b|=\s*\d+\s*(?:$|[\s,])", re.sub(r"\\.|/(?:\\.|[^/\\])*/", "", text), re.I) is not None
