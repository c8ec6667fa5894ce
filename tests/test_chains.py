"""Chains of tokens against a version that tries all positions."""

import itertools
import random
from collections import Counter

import pytest

from chronolex.functions import querytree as Q
from chronolex.operators import chains, relations

ATTRS = ("l", "p")


def made(seed, sentences=40):
    rnd = random.Random(seed)
    return [(s // 3, s, k, 1900 + s % 4, rnd.choice("abc"), rnd.choice("XY")) for s in range(sentences) for k in range(rnd.randint(1, 14))]


def brute(rows, chain, holds, items):
    """Counter of (date, items of the token told): all tuples of positions."""
    sentences = {}
    for doc, s, k, date, l, p in rows:
        sentences.setdefault((doc, s), []).append((date, {"l": l, "p": p}))
    out = Counter()
    for tokens in sentences.values():
        for where in itertools.product(range(len(tokens)), repeat=len(chain.items)):
            steps = zip(where, where[1:], chain.steps)
            if all(low <= (abs(b - a) if both else b - a) <= high for a, b, (low, high, both) in steps) and all(h(tokens[i][1]) for h, i in zip(holds, where)):
                date, token = tokens[where[chain.told]]
                out[(date, *(token[c] for c in items))] += 1
    return out


CASES = [
    ('"a #1 b=2 #>0 c"', [lambda t: t["l"] == "a", lambda t: t["l"] == "b", lambda t: t["l"] == "c"]),
    ('"$p=X=2 #2 * #=1 (b || c)"', [lambda t: t["p"] == "X", lambda t: True, lambda t: t["l"] in "bc"]),
    ('"a *=2"', [lambda t: t["l"] == "a", lambda t: True]),
    ("near(a,$p=Y=2,1)", [lambda t: t["l"] == "a", lambda t: t["p"] == "Y"]),
    ("a #dmax 2", [lambda t: t["l"] == "a", lambda t: True]),
    ('"a a=2 #1 a"', [lambda t: t["l"] == "a"] * 3),
]


@pytest.mark.parametrize(("request_", "holds"), CASES)
@pytest.mark.parametrize("block", [3, 2048])
def test_hits(spark, monkeypatch, request_, holds, block):
    monkeypatch.setattr(relations, "BLOCK", block)
    rows = made(block)
    tokens = spark.createDataFrame(rows, "doc_id long, sent_id long, pos int, date int, l string, p string").repartition(3)
    chain = chains.chain_of(Q.parse(request_), "l")
    found = chains.hits(relations.windows(tokens, ATTRS, chain.reach), chain, ATTRS)
    got = {(r["date"], r["l"], r["p"]): r["n"] for r in found.groupBy("date", "l", "p").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert got == dict(brute(rows, chain, holds, ATTRS))


def test_ways_targets_and_matches():
    chain = chains.chain_of(Q.parse('"a=1 #2 b=2 #>3 c=1 #=5 d"'), "l")
    assert chain.ways == 3 * (32 - 4) * 1 and chain.told == 1 and chain.targets == (0, 2, 3) and chain.reach == 3 + 32 + 6
    assert chains.chain_of(Q.parse("near(a,b=2,4)"), "l").ways == 10
    assert chains.chain_of(Q.parse("a"), "l", distance=3).ways == 6
    for wrong in ('"a b c"', '"a=2 b=2"', 'near(a,b,2)', '"a && b c=2"'):
        with pytest.raises(ValueError):
            chains.hits(None, chains.chain_of(Q.parse(wrong), "l"), ATTRS)


def test_plan_has_no_joins_of_tokens(spark):
    tokens = spark.createDataFrame(made(1), "doc_id long, sent_id long, pos int, date int, l string, p string")
    chain = chains.chain_of(Q.parse('"a #1 b=2 #2 c"'), "l")
    plan = chains.hits(relations.windows(tokens, ATTRS, chain.reach), chain, ["l"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 1 and plan.count("Relation") == 1
