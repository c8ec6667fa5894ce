"""Boolean requests: what they are read as, that their canonical form reads back, and what they take in."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronolex.functions import querytree as Q
from chronolex.functions.querytree import Has, Near, Not, Pair, Sequence, Token

exact = lambda v, a=None, m=0: Token("exact", (v,), a, m)
READ = [
    ("Mann|Frau", Token("set", ("Mann", "Frau"))),
    ("Katze && Maus", Pair("&&", exact("Katze"), exact("Maus"))),
    ("Katze && Maus && Hund", Pair("&&", Pair("&&", exact("Katze"), exact("Maus")), exact("Hund"))),
    ("Mann with $p=NN", Pair("WITH", exact("Mann"), exact("NN", "p"))),
    ("Mann, p=NN", Pair("WITH", exact("Mann"), exact("NN", "p"))),
    ("Mann $p=NN", Pair("WITH", exact("Mann"), exact("NN", "p"))),
    ("function &= $p=/^N/", Pair("WITH", exact("function"), Token("regex", ("^N", ""), "p"))),
    ("a WITHOUT (b || c)", Pair("WITHOUT", exact("a"), Pair("||", exact("b"), exact("c")))),
    ("a && b || c && !d", Pair("||", Pair("&&", exact("a"), exact("b")), Pair("&&", exact("c"), Not(exact("d"))))),
    ("/optics/", Token("regex", ("optics", ""))),
    (r"l=/x\/y/gi", Token("regex", ("x/y", "gi"), "l")),
    ("$l", Token("any", (), "l")),
    ("$p=ADJA=2 Haus", Pair("WITH", exact("ADJA", "p", 2), exact("Haus"))),
    ('"$p=ADJA=2 Mann"', Sequence((exact("ADJA", "p", 2), exact("Mann")), (("<", 0),))),
    ('"$p=ADJA=2 @Maus" #fmin 1', Sequence((exact("ADJA", "p", 2), exact("Maus")), (("<", 0),))),
    ('"(ge* &= $p=ADJA)=2 $l=@Maschine" #fmin 1', Sequence((Pair("WITH", Token("prefix", ("ge",), None, 2), exact("ADJA", "p", 2)), exact("Maschine", "l")), (("<", 0),))),
    ('"a #2 b=2 #>4 c #=1 d"', Sequence((exact("a"), exact("b", None, 2), exact("c"), exact("d")), (("<", 2), (">", 4), ("=", 1)))),
    ("near(flood,{frequency,uncertainty,risk}=2,8) #fmin 1", Near(exact("flood"), Token("set", ("frequency", "uncertainty", "risk"), None, 2), 8)),
    ("Haus=2 || Garten=1 #fmin 1", Pair("||", exact("Haus", None, 2), exact("Garten", None, 1))),
    ('"*=2 Mansch"', Sequence((Token("any", (), None, 2), exact("Mansch")), (("<", 0),))),
    (r"a\|b, \with", Pair("WITH", exact("a|b"), exact("with"))),
    ("[l=*haus* WITH p=*N]", Pair("WITH", Token("infix", ("haus",), "l"), Token("suffix", ("N",), "p"))),
]


@pytest.mark.parametrize(("text", "tree"), READ)
def test_read_and_canonical_form(text, tree):
    found = Q.parse(text)
    assert found.tree == tree and Q.parse(str(found)) == found


def test_filters_and_options():
    found = Q.parse("* #has[author,/Habermas/] !#has[genre,{a,b}] #fmin 3 #dmax[7] #sep")
    assert found == Q.Request(None, (Has("author", Token("regex", ("Habermas", ""))), Has("genre", Token("set", ("a", "b")), True)), {"fmin": 3, "dmax": 7})
    assert Q.parse("Zahnstange #has[basename,fischer_w*]") == Q.Request(exact("Zahnstange"), (Has("basename", Token("prefix", ("fischer_w",))),))
    assert Q.parse("$p=NN !#has[textClass,/politik/i]") == Q.Request(exact("NN", "p"), (Has("textClass", Token("regex", ("politik", "i")), True),))
    assert Q.parse(str(found)) == found


words = st.text(st.characters(codec="utf-8", exclude_categories=("Cs", "Cc", "Zs", "Zl", "Zp")), min_size=1, max_size=6)
tokens = st.builds(lambda kind, v, a, m: Token(kind, (v,), a, m), st.sampled_from(["exact", "prefix", "suffix", "infix"]), words, st.none() | st.sampled_from(["l", "p", "doc.x"]), st.integers(0, 3))
sets = st.builds(lambda v, a: Token("set", tuple(v), a), st.lists(words, min_size=2, max_size=3), st.none() | st.just("l"))
trees = st.recursive(tokens | sets, lambda inner: st.builds(lambda op, a, b: Pair(op, a, b), st.sampled_from(["WITH", "WITHOUT", "||", "&&"]), inner, inner) | st.builds(Not, inner), max_leaves=6)
chains = st.builds(lambda items, gap: Sequence(tuple(items), tuple([gap] * (len(items) - 1))), st.lists(tokens, min_size=2, max_size=4), st.tuples(st.sampled_from("<>="), st.integers(0, 9)))


@settings(max_examples=300, deadline=None)
@given(trees | chains | st.builds(Near, tokens, tokens, st.integers(0, 9)))
def test_any_tree_reads_back(tree):
    found = Q.parse(str(tree))
    same = "&&" in str(tree)
    assert same is False or found.tree == tree
    assert Q.parse(str(found)) == found
    if not same:
        assert found.tree == tree


@pytest.mark.parametrize(("text", "words"), [(r"{0,\}}", ("0", "}")), (r"{a\,b,c\\}", ("a,b", "c\\")), (r"{c\\,d}", ("c\\", "d")), (r"{ a b , \  ,}", ("a b", " "))])
def test_sets_of_words_behind_backslashes(text, words):
    found = Q.parse(text)
    assert found.tree == Token("set", words) and Q.parse(str(found)) == found


@pytest.mark.parametrize("text", ["(a", 'a "b', "near(a,b)", "a &&", "{", "#has[x", "a )"])
def test_what_can_not_be_read(text):
    with pytest.raises(ValueError):
        Q.parse(text)


def test_is_boolean():
    assert all(map(Q.is_boolean, ["a && b", "(a)", "a WITHOUT b", "!a", "* #has[x,y]", "a || b", '"a b"', "a=2"]))
    assert not any(map(Q.is_boolean, ["a", "l=a|b, p=c", r"Brand\#1", "/(a|b)/i", "$l=a WITH $p=b", "doc.genre=news"]))


@pytest.mark.parametrize(("text", "want"), [("Haus*", "12"), ("Haus* WITHOUT Hausboot", "1"), ("!Haus*", "345"), ("Haus || p=V", "13"), ("(l=Haus || l=Mann) WITH !p=V", "14"), ("Haus* $p=N", "12"), ("$p", "12345")])
def test_conditions(spark, text, want):
    rows = spark.createDataFrame([("1", "Haus", "N"), ("2", "Hausboot", "N"), ("3", "ging", "V"), ("4", "Mann", "N"), ("5", "x", "Y")], "k string, l string, p string")
    assert "".join(sorted(r["k"] for r in rows.filter(Q.parse(text).where("l")(F.col)).collect())) == want
