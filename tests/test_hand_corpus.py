"""A corpus of four documents whose counts and scores are worked out by hand."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronolex.functions import predicates as P
from chronolex.operators import compare, documents, profiles, relations, trim

TEXTS = {
    "d1": (1990, "news", "a/N b/N a/N c/V | b/N c/V"),
    "d2": (1990, "lit", "a/N c/V c/V"),
    "d3": (1995, "news", "a/N b/N | c/V b/V a/N b/N"),
    "d4": (2001, "lit", "b/N b/N d/V a/N"),
}


@pytest.fixture(scope="module")
def tokens(spark):
    rows = []
    for doc, (date, _, text) in TEXTS.items():
        for sent, part in enumerate(text.split("|")):
            for pos, word in enumerate(part.split()):
                rows.append((doc, sent, pos, date, *word.split("/")))
    return spark.createDataFrame(rows, "doc_id string, sent_id int, pos int, date int, l string, p string").cache()


@pytest.fixture(scope="module")
def tables(tokens):
    every = relations.cooccurrences(tokens, ("l", "p"), 2).cache()
    return every, relations.marginals(every, ("l", "p")).cache()


def rows(df, *names):
    return {tuple(r[n] for n in names[:1]) if len(names) == 1 else r[names[0]]: tuple(r[n] for n in names[1:]) for r in df.collect()}


def near(a, b):
    return a == b or abs(a - b) < 1e-5


def test_unigrams(tokens):
    got = {(r["l"], r["p"], r["date"]): r["f"] for r in relations.unigrams(tokens, ("l", "p")).collect()}
    assert got[("a", "N", 1990)] == 3 and got[("b", "N", 2001)] == 2 and got[("c", "V", 1990)] == 4 and got[("d", "V", 2001)] == 1


def test_marginals(tables):
    got = {(r["l"], r["p"], r["date"]): r["f1"] for r in tables[1].collect()}
    assert [got[("a", "N", y)] for y in (1990, 1995, 2001)] == [7, 4, 2]
    assert [got[("b", "N", y)] for y in (1990, 1995, 2001)] == [4, 3, 5]
    assert got[("b", "V", 1995)] == 3 and got[("c", "V", 1990)] == 7 and got[("c", "V", 1995)] == 2 and got[("d", "V", 2001)] == 3
    assert {r["date"]: r["n"] for r in relations.totals_by_date(tables[1], "f1").collect()} == {1990: 18, 1995: 12, 2001: 10}


@pytest.mark.parametrize(
    ("how", "want"),
    [
        ({}, {"a": (40, 13, 13, 2, 11.299560, -0.872428), "b": (40, 13, 15, 6, 12.777608, 0.265615), "c": (40, 13, 9, 4, 12.540568, 0.311110), "d": (40, 13, 3, 1, 11.0, 0.000511)}),
        ({"having": {"p": "N"}}, {"a": (40, 13, 13, 2, 11.299560, -0.872428), "b": (40, 13, 12, 5, 12.678072, 0.278672)}),
        ({"date": "1990:1995"}, {"a": (40, 11, 11, 2, None, None), "b": (40, 11, 10, 5, None, None), "c": (40, 11, 9, 4, None, None)}),
        ({"minimum": 2}, {"a": (40, 13, 13, 2, 11.299560, -0.872428), "b": (40, 13, 15, 4, 12.192645, -0.173162), "c": (40, 13, 9, 3, 12.125531, 0.001831)}),
        ({"one_pass": True}, {"a": (40, 13, 7, 2, 11.678072, None), "b": (40, 13, 15, 6, None, None), "c": (40, 13, 9, 4, None, None), "d": (40, 13, 3, 1, None, None)}),
    ],
)
def test_profile(tables, how, want):
    pairs = relations.thresholded(tables[0], how.pop("minimum", 1))
    for k, name in ((4, "ld"), (5, "ll")):
        got = rows(profiles.cof_profile(pairs, tables[1], {"l": "a"}, ["l"], size=0, name=name, **how), "l", "N", "f1", "f2", "f12", "score")
        assert {x: v[:4] for x, v in got.items()} == {x: v[:4] for x, v in want.items()}
        assert all(v[k] is None or near(got[x][4], v[k]) for x, v in want.items())


def test_slices(tables):
    got = profiles.cof_profile(*tables, {"l": "a"}, ["l"], size=10, name="ld").collect()
    assert {(r["slice"], r["l"]): (r["N"], r["f1"], r["f2"], r["f12"]) for r in got} == {
        (1990, "a"): (30, 11, 11, 2), (1990, "b"): (30, 11, 10, 5), (1990, "c"): (30, 11, 9, 4), (2000, "b"): (10, 2, 5, 1), (2000, "d"): (10, 2, 3, 1),
    }


@pytest.mark.parametrize(
    ("name", "plain", "smooth"),
    [("f", 6, 6), ("fm", 150000, 150000), ("lf", 2.584963, 2.700440), ("lfm", 17.194603, 17.292159), ("milf", 0.774352, 1.183120), ("mi1", 0.299560, 0.331206), ("mi3", 5.469485, 5.732085), ("ld", 12.777608, 12.842459), ("ll", 0.265615, 0.452192)],
)
def test_scores(tables, name, plain, smooth):
    for eps, want in ((0.0, plain), (0.5, smooth)):
        got = rows(profiles.cof_profile(*tables, {"l": "a"}, ["l"], size=0, name=name, eps=eps), "l", "score")
        assert near(got["b"][0], want)


@pytest.mark.parametrize(
    ("op", "want"),
    [
        ("diff", {"a": -1.241008, "b": 0.777608, "c": 0.710493, "d": 11.0}), ("sum", {"a": 23.840128, "b": 24.777608, "c": 24.370643, "d": 11.0}), ("min", {"a": 11.299560, "b": 12.0, "c": 11.830075}),
        ("max", {"a": 12.540568, "b": 12.777608, "c": 12.540568, "d": 11.0}), ("avg", {"a": 11.920064, "b": 12.388804, "c": 12.185322}), ("havg", {"a": 11.903914, "b": 12.382703, "c": 12.180143}),
        ("gavg", {"a": 11.911983, "b": 12.385753, "c": 12.182732}), ("lavg", {"a": 11.903903, "b": 12.382701, "c": 12.180142}),
    ],
)
def test_comparison(tables, op, want):
    a, b = (profiles.cof_profile(*tables, {"l": x}, ["l"], size=0, name="ld") for x in "ac")
    got = rows(compare.compared(a, b, ["l"], op), "l", "diff")
    assert got.keys() == want.keys() and all(near(got[k][0], v) for k, v in want.items())


@pytest.mark.parametrize(
    ("items", "want"),
    [
        (["l"], {("a",): (6, 6), ("b",): (5, 7), ("c",): (4, 5), ("d",): (1, 1)}), (["genre"], {("news",): (4, 12), ("lit",): (2, 7)}),
        (["l", "genre"], {("a", "news"): (4, 4), ("b", "news"): (5, 5), ("c", "news"): (3, 3), ("a", "lit"): (2, 2), ("b", "lit"): (1, 2), ("c", "lit"): (1, 2), ("d", "lit"): (1, 1)}),
    ],
)
def test_documents(spark, tokens, items, want):
    docs = spark.createDataFrame([(k, v[1]) for k, v in TEXTS.items()], "doc_id string, genre string")
    matrix = documents.Matrix(relations.term_segments(tokens, ("l", "p"), least=1, document_min=1), docs, ("l", "p"))
    got = documents.tdf_profile(documents.terms(matrix, {"l": "a"}), items).collect()
    assert {tuple(r[i] for i in items): (r["f12"], r["f2"]) for r in got} == want
    assert {(r["N"], r["f1"]) for r in got} == {(19, 6)}


def test_pairs_are_symmetric_and_sum_to_marginals(tables):
    every, margin = tables
    whole = every.groupBy("l1", "l2").agg(F.sum("f12").alias("n"))
    got = {(r["l1"], r["l2"]): r["n"] for r in whole.collect()}
    assert all(got[b, a] == n for (a, b), n in got.items())
    assert margin.agg(F.sum("f1")).first()[0] == sum(got.values()) == 40


def test_empty_target_and_trim(tables):
    assert profiles.cof_profile(*tables, {"l": "nothing"}, ["l"]).count() == 0
    found = profiles.cof_profile(*tables, {"l": P.regex("^[ab]$")}, ["l"], size=0, name="ld")
    top = trim.best(found, ["l"], 2)
    assert top.count() == 2 and trim.cut_off(found, math.inf).count() == 0
    assert {r["l"] for r in trim.kept(found, top, ["l"]).collect()} == {r["l"] for r in top.collect()}
    assert trim.dropped(found, top, ["l"]).count() == found.count() - 2


def test_pairs_of_a_long_sentence_are_dealt_to_many_tasks(spark, monkeypatch):
    rnd = random.Random(2)
    sentences = {("x", 0): 700, ("x", 1): 1, (None, 0): 9, ("y", 0): 23, ("z", None): 5}
    rows = [(d, s, rnd.randrange(200), 1990, rnd.choice("abcd")) for (d, s), n in sentences.items() for _ in range(n)]
    want = Counter()
    for key in sentences:
        words = [r[4] for r in sorted(r for r in rows if r[:2] == key)] if None not in key else [r[4] for r in sorted((r for r in rows if r[:2] == key), key=lambda r: r[2:])]
        want.update((x, words[k], k - i) for i, x in enumerate(words) for k in range(max(i - 5, 0), min(i + 6, len(words))) if k != i)
    frame = spark.createDataFrame(rows, "doc_id string, sent_id int, pos int, date int, l string").repartition(5)
    monkeypatch.setattr(relations, "BLOCK", 3, raising=False)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = relations.pairs(frame, ("l",), 5).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert Counter((r["l1"], r["l2"], r["gap"]) for r in found) == want
    tasks = Counter(r["task"] for r in found)
    assert len(tasks) == 4 and max(tasks.values()) < len(found) / 2  # the long sentence has 95 % of all rows
    assert relations.pairs(frame.limit(0), ("l",), 5).count() == 0
