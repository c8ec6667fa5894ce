import json

import pytest

from chronolex.operators import corpus, profiles, relations
from chronolex.plans.database import create, link_template, open_database
from chronolex.sources import readers, sinks


def words(found):
    return [(r["sent_id"], r["w"], r["p"], r["l"]) for r in found.tokens.orderBy("doc_id", "pos").collect()]


WANT = [(0, "Das", "ART", "die"), (0, "Haus", "NN", "Haus"), (1, "Es", "PPER", "es")]


def test_tabs(spark, tmp_path):
    (tmp_path / "a.tabs").write_text(
        "%%$X:meta.basename=a\n%%$X:meta.date_=1999-01-02\n%%$X:meta.author=Doe, J. (1900-1950)\n%%$X:meta.textClass=Prose: Novel\n%%$X:index[0]=Token w\n%%$X:index[1]=Lemma l\n%%$X:index[2]=Pos p\n"
        "%%$X:PAGE=3\nDas\tdie\tART\nHaus\tHaus\tNN\n\n%%$X:BREAK.p\nEs\tes\tPPER\n"
    )
    found = readers.read(spark, str(tmp_path / "*.tabs"), "tabs")
    assert words(found) == WANT
    doc = found.docs.first()
    assert (doc["label"], doc["date"], doc["meta"]["author"], doc["genre"]) == ("a", 1999, "Doe, J.", "Prose")
    rows = found.tokens.orderBy("pos").collect()
    assert [r["seg_id"] for r in rows] == [0, 0, 1] and {r["page"] for r in rows} == {"3"}


def test_json(spark, tmp_path):
    tokens = [{"w": "Das", "p": "ART", "l": "die"}, {"w": "Haus", "p": "NN", "l": "Haus"}, None, "#p", {"w": "Es", "p": "PPER", "l": "es"}]
    (tmp_path / "a.json").write_text(json.dumps({"label": "a", "date": 1999, "meta": {"k": "v"}, "tokens": tokens}))
    found = readers.read(spark, str(tmp_path / "a.json"), "json")
    assert words(found) == WANT and found.docs.first()["meta"] == {"k": "v"}


def test_tcf(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<D xmlns="urn:d"><MetaData><source type="meta:date">1999</source><source type="meta:k">v</source></MetaData><TextCorpus><tokens><token ID="w1">Das</token><token ID="w2">Haus</token><token ID="w3">Es</token></tokens>'
        '<sentences><sentence tokenIDs="w1 w2"/><sentence tokenIDs="w3"/></sentences><POStags><tag tokenIDs="w1">ART</tag><tag tokenIDs="w2">NN</tag><tag tokenIDs="w3">PPER</tag></POStags>'
        '<lemmas><lemma tokenIDs="w1">die</lemma><lemma tokenIDs="w2">Haus</lemma><lemma tokenIDs="w3">es</lemma></lemmas></TextCorpus></D>'
    )
    found = readers.read(spark, str(tmp_path / "a.xml"), "tcf")
    assert words(found) == WANT and found.docs.first()["date"] == 1999


def test_tei(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<TEI><teiHeader><title>T</title><author>Doe (x)</author><date>1999-05-01</date></teiHeader><text><p><s><w type='ART' lemma='die'>Das</w> <w type='NN' lemma='Haus'>Haus</w></s></p>"
        "<p><s><w type='PPER' lemma='es'>Es</w></s></p></text></TEI>"
    )
    found = readers.read(spark, str(tmp_path / "a.xml"), "tei")
    assert [(s - 1, *rest) for s, *rest in words(found)] == WANT and found.docs.first()["date"] == 1999


@pytest.fixture
def tokens(spark):
    text = "a b a c b c a b d a b c a a b"
    return spark.createDataFrame([(k // 5, 0, k, 1990 + k // 5, w) for k, w in enumerate(text.split())], "doc_id int, sent_id int, pos int, date int, l string")


def test_text_round_trips(spark, tokens, tmp_path):
    xf, every = relations.unigrams(tokens, ("l",)), relations.cooccurrences(tokens, ("l",), 2)
    cof, margin = relations.thresholded(every, 2), relations.marginals(every, ("l",))
    sinks.write_unigrams(xf, ("l",), str(tmp_path / "xf"))
    assert sorted(sinks.read_unigrams(spark, str(tmp_path / "xf"), ("l",)).collect()) == sorted(xf.collect())
    sinks.write_cooccurrences(cof, margin, ("l",), str(tmp_path / "cof"))
    cof2, margin2 = sinks.read_cooccurrences(spark, str(tmp_path / "cof"), ("l",))
    assert sorted(cof2.collect()) == sorted(cof.collect()) and sorted(margin2.collect()) == sorted(margin.collect())


def test_database(spark, tokens, tmp_path):
    docs = spark.createDataFrame([(k, f"g{k % 2}") for k in range(3)], "doc_id int, genre string")
    db = create(tokens, docs, ("l",), tuple_min=1, cof_min=1, segment_least=1, document_min=1)
    db.write(str(tmp_path / "db"))
    again = open_database(spark, str(tmp_path / "db"))
    for relation in ("xf", "cof", "tdf"):
        a, b = (sorted(map(str, d.profile(relation, {"l": "a"}, ["l"], k=3, fill=True, name="ld").select("slice", "l", "f12", "f2").collect())) for d in (db, again))
        assert a == b and a
    two = open_database(spark, str(tmp_path / "db"), str(tmp_path / "db"))
    assert {r["l"]: r["f12"] for r in two.profile("cof", {"l": "a"}, ["l"], size=0).collect()} == {r["l"]: 2 * r["f12"] for r in db.profile("cof", {"l": "a"}, ["l"], size=0).collect()}
    assert again.compare("cof", {"where": {"l": "a"}}, {"where": {"l": "b"}}, ["l"], "adiff", 2, name="ld").count() == 2
    assert {r["name"] for r in again.info().collect()} == {"xf", "cof", "marginal", "tdf"}
    found = db.profile("cof", {"l": "a"}, ["l"], size=0, name="ld")
    assert "<td>" in sinks.as_html(found, ["l"]) and sinks.as_json(found, ["l"]).count() == 1
    sinks.write_text(found, ["l"], str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == found.count()
    keys = spark.createDataFrame([(0, "a"), (0, "zz")], "slice int, l string")
    assert {r["l"] for r in db.extend("cof", {"l": "a"}, ["l"], keys, size=0).collect()} == {"a"}
    assert link_template({"l": "a"}, ["l"]) == "near($l=a , $l={l})"


def test_filters(spark, tokens, tmp_path):
    assert corpus.frequent(tokens, ("l",), 2).filter("l = 'd'").count() == 0
    (tmp_path / "stop").write_text("# words\na\n\nb\n")
    assert {r["l"] for r in corpus.listed(tokens, "l", corpus.list_file(spark, str(tmp_path / "stop")), keep=False).select("l").distinct().collect()} == {"c", "d"}
    assert corpus.sample(tokens, 4, 1, "pos").collect() == corpus.sample(tokens.repartition(3), 4, 1, "pos").collect()
    marks = spark.createDataFrame([(0, k, x) for k, x in enumerate("a | b c | d".split())], "doc_id int, pos int, l string")
    assert [r["sent_id"] for r in corpus.segments(marks, marks["l"] == "|").orderBy("pos").collect()] == [0, 1, 1, 2]


def test_shards_add_up(spark, tokens):
    tables = [(relations.cooccurrences(t, ("l",), 2), ) for t in (tokens.filter("doc_id = 0"), tokens.filter("doc_id > 0"))]
    parts = [profiles.cof_profile(c, relations.marginals(c, ("l",)), {"l": "a"}, ["l"], size=0) for (c,) in tables]
    every = relations.cooccurrences(tokens, ("l",), 2)
    whole = profiles.cof_profile(every, relations.marginals(every, ("l",)), {"l": "a"}, ["l"], size=0)
    total = {r["l"]: r["f12"] for r in profiles.summed(parts, ["l"]).collect()}
    assert total == {r["l"]: r["f12"] for r in whole.collect()}
