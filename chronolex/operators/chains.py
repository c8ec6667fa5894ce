"""Hits of token chains, as a concordance service counts them: phrases, sequences with gaps, tokens near each other.

A chain is matched in the blocks of relations.windows by dynamic steps: for each token the number of ways in which the chain's first items lead to it and its last ones go on from it. No token is met with another as a row, so hits of
a chain of any length cost a step an item, and a token's hits are counted in the block that owns it. Blocks overlap by the sum of the gaps."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import querytree as Q
from ..functions.predicates import dates
from ..functions.text import sliced
from . import relations
from .profiles import FARTHEST, scored

Condition = Callable[[Q.Columns], Column]


@dataclass(frozen=True)
class Chain:
    """items: conditions on tokens; steps: for each but the first the distances from the one before, as (low, high, both): both sides or after it alone; told: the item that is grouped by; targets: the items of the target (match id 1)."""

    items: tuple[Condition, ...]
    steps: tuple[tuple[int, int, bool], ...]
    told: int
    targets: tuple[int, ...]

    @property
    def reach(self) -> int:
        return sum(high for _, high, _ in self.steps)

    @property
    def ways(self) -> int:
        """How many chains of any tokens start at one: what makes counts of tokens comparable with hits."""
        out = 1
        for low, high, both in self.steps:
            out *= (high - low + 1) * (2 if both else 1)
        return out

    def target(self) -> Chain:
        """The chain of the target alone: other items may be anything."""
        anything = lambda of: F.lit(True)
        items = tuple(c if k in self.targets else anything for k, c in enumerate(self.items))
        return Chain(items, self.steps, self.targets[0], self.targets)


def chain_of(request: Q.Request, default: str, having: Condition | None = None, distance: int = 5) -> Chain:
    """The chain of a request. Without an item of match id 2 the items told are those near it, distance tokens away at most (#dmax). having restricts the items told."""
    tree = request.tree if request.tree is not None else Q.Token("any")
    wanted = lambda t: (lambda of: t.condition(of, default))
    if isinstance(tree, Q.Sequence):
        items = list(tree.items)
        steps = [{"<": (1, n + 1, False), ">": (n + 2, FARTHEST, False), "=": (n + 1, n + 1, False)}[op] for op, n in tree.gaps]
    elif isinstance(tree, Q.Near):
        items, steps = [tree.a, tree.b], [(1, tree.between + 1, True)]
    else:
        items, steps = [tree], []
    ids = [{t.match for t in item.tokens()} for item in items]
    told = [k for k, x in enumerate(ids) if 2 in x]
    conditions = [wanted(item) for item in items]
    if not told:
        if len(items) > 1:
            raise ValueError("which item is told? mark it with =2")
        reach = int(request.options.get("dmax", distance))
        conditions.append(lambda of: F.lit(True))
        steps.append((1, max(reach, 1), True))
        told, ids = [1], [*ids, {2}]
    if len(told) > 1:
        raise ValueError("one item alone can have the match id 2")
    if having is not None:
        own = conditions[told[0]]
        conditions[told[0]] = lambda of: own(of) & having(of)
    targets = tuple(k for k, x in enumerate(ids) if 2 not in x)
    return Chain(tuple(conditions), tuple(steps), told[0], targets or (told[0],))


def _led(t: Column, matched: Callable[[Column], Column], before: Column | None, step: tuple[int, int, bool] | None, back: bool) -> Column:
    """For each token of t that is matched the ways that lead to it: the sum of before over the tokens that the step takes in on one side (back: on the left) or on both."""
    if before is None:
        return F.transform(t, lambda x: F.when(matched(x), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    low, high, both = step
    offsets = [d for d in range(-high, high + 1) if low <= abs(d) and (both or (d < 0) == back)]
    gaps = F.array(*(F.lit(d) for d in offsets))

    def ways(x: Column, i: Column) -> Column:
        same = lambda d: F.get(t, i + d)["sentence"].eqNullSafe(x["sentence"])
        inside = lambda d: (i + d >= 0) & (i + d < F.size(t)) & same(d)
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, d: total + F.when(inside(d), F.get(before, i + d)).otherwise(F.lit(0).cast("long")))

    return F.transform(t, lambda x, i: F.when(matched(x), ways(x, i)).otherwise(F.lit(0).cast("long")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hits(blocks: DataFrame, chain: Chain, attributes: Sequence[str]) -> DataFrame:
    """date, attributes of the item told and n, its hits, for each token that has any."""
    t = F.col("t")
    matched = [(lambda x, c=c: c(lambda a: x[a])) for c in chain.items]
    last = len(chain.items) - 1

    def after(k: int, use: Callable[[Column], Column]) -> Column:
        """use(the ways from item k on)."""
        if k == last:
            return _once(_led(t, matched[k], None, None, False), use)
        return after(k + 1, lambda ways: _once(_led(t, matched[k], ways, chain.steps[k], False), use))

    def before(k: int, use: Callable[[Column], Column]) -> Column:
        """use(the ways up to item k)."""
        if k == 0:
            return _once(_led(t, matched[k], None, None, True), use)
        return before(k - 1, lambda ways: _once(_led(t, matched[k], ways, chain.steps[k - 1], True), use))

    def rows(up: Column, on: Column) -> Column:
        made = F.transform(t, lambda x, i: F.struct(x["date"].alias("date"), *(x[a].alias(a) for a in attributes), F.when(x["own"], F.get(up, i) * F.get(on, i)).otherwise(F.lit(0).cast("long")).alias("n")))
        return F.filter(made, lambda r: r["n"] > 0)

    found = before(chain.told, lambda up: after(chain.told, lambda on: rows(up, on)))
    return blocks.select(F.explode(found).alias("r")).select("r.*")


def chain_profile(
    tokens: DataFrame, request: str | Q.Request, group_by: Sequence[str], attributes: Sequence[str], *, size: int = 0, date: str | int | None = None, having: Condition | None = None, distance: int = 5,
    name: str = "f", eps: float = 0.0, docs: DataFrame | None = None, sentence: Sequence[str] = ("doc_id", "sent_id"), order: Sequence[str] = ("pos",),
) -> DataFrame:
    """The profile of a request over tokens, with hits as f12. f2 and N are counts of tokens times the ways in which a chain can start at one; f1 is the target's hits times what is left of that factor. The first of attributes is the default of the
    request; #fmin is a threshold for f12, #coef another factor, #limit the most rows. docs (doc_id and metadata) is needed by #has. A request that tells no item of match id 2 takes any near it."""
    asked = Q.parse(request) if isinstance(request, str) else request
    items, chain = list(group_by), chain_of(asked, attributes[0], having, distance)
    if asked.filters:
        if docs is None:
            raise ValueError("#has needs the documents")
        kept = docs
        for f in asked.filters:
            kept = kept.filter(f.predicate()(F.col(f.field)))
        searched = tokens.join(kept.select("doc_id").distinct(), "doc_id", "left_semi")
    else:
        searched = tokens
    blocks = relations.windows(searched, attributes, chain.reach, sentence, order)
    if date is None and asked.dates is not None:
        date = "-".join("*" if x is None else str(x) for x in asked.dates)
    within = dates(date)(F.col("date"))
    cut = lambda rows: rows.filter(within).withColumn("slice", sliced(F.col("date"), size))
    f12 = cut(hits(blocks, chain, items)).groupBy("slice", *items).agg(F.sum("n").alias("f12")).filter(F.col("f12") >= int(asked.options.get("fmin", 1)))
    target, coef = chain.target(), asked.options.get("coef", chain.ways)
    coef = int(coef) if coef == int(coef) else coef
    if len(chain.targets) == 1:
        one = chain.items[chain.targets[0]](F.col)
        f1 = cut(searched.filter(one)).groupBy("slice").agg((F.count("*") * coef).alias("f1"))
    else:
        f1 = cut(hits(blocks, target, [])).groupBy("slice").agg((F.sum("n") * coef / chain.ways).cast("long" if coef == chain.ways else "double").alias("f1"))
    f2 = cut(searched).groupBy("slice", *items).agg((F.count("*") * coef).alias("f2"))
    n = tokens.withColumn("slice", sliced(F.col("date"), size)).groupBy("slice").agg((F.count("*") * coef).alias("N"))
    counts = f12.join(f2, ["slice", *items]).join(f1, "slice").join(n, "slice").withColumn("N", F.greatest("N", "f1"))
    out = scored(counts, name, eps).select("slice", *items, "N", "f1", "f2", "f12", "score")
    return out if "limit" not in asked.options else out.orderBy(F.desc("f12"), "slice", *items).limit(int(asked.options["limit"]))
