"""Small documents share files: as lines or as cells of a table."""

from pathlib import Path

import pytest

from chronolex import catalogue
from chronolex.sources import readers

DATA = "/root/testdata/sf0.001"
TEI = "<TEI><teiHeader><date>{y}-01-02</date></teiHeader><text><p><s><w type='N' lemma='a'>A</w><w type='V' lemma='b'>B</w></s></p></text></TEI>"


@pytest.mark.parametrize("kind", ["tabs", "json", "tcf", "tei", "xml"])
def test_conversations_share_files(spark, kind):
    path = catalogue._chat_files(spark, DATA, kind).split("/*")[0]
    files = [p for p in Path(path.removeprefix("file:")).rglob("*") if p.name.startswith("part-")]
    conversations = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id").distinct().count()
    assert 0 < len(files) < conversations / 2


@pytest.mark.parametrize("kind", ["tei", "xml"])
def test_cells_read_as_files_do(spark, tmp_path, kind):
    texts = {str(k): TEI.format(y=1990 + k) for k in range(5)}
    for k, t in texts.items():
        (tmp_path / f"{k}.xml").write_text(t)
    spark.createDataFrame([*texts.items()], "doc_id string, value string").write.parquet(str(tmp_path / "table"))
    told = lambda c: sorted(map(tuple, c.tokens.select("sent_id", "seg_id", "pos", "date", "w", "p", "l").collect()))
    cells, files = readers.read(spark, str(tmp_path / "table"), kind, cells=True), readers.read(spark, str(tmp_path / "*.xml"), kind)
    assert told(cells) == told(files) and len(told(cells)) == 10
    assert {r["date"] for r in cells.docs.collect()} == {r["date"] for r in files.docs.collect()} == {1990 + k for k in range(5)}
    assert {r["doc_id"] for r in cells.tokens.collect()} == set(texts)


def test_json_documents_of_a_line_each(spark, tmp_path):
    (tmp_path / "some.json").write_text('{"label":"a","date":1990,"tokens":[{"w":"x","p":"N","l":"x"},null,{"w":"y","p":"N","l":"y"}]}\n{"label":"b","tokens":["#p",{"w":"z"}]}\n')
    found = readers.read_json(spark, str(tmp_path / "some.json"), lines=True)
    assert sorted(tuple(r)[1:] for r in found.tokens.collect()) == [(0, 0, 0, 1990, "x", "N", "x"), (0, 1, 1, 0, "z", "", ""), (1, 0, 2, 1990, "y", "N", "y")]
    assert found.docs.count() == 2
