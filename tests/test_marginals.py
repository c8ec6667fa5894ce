"""Marginals are told from the ends of a window: as many look-ups as sides, not a walk through it."""

from collections import Counter

import pytest

from chronolex.operators import relations

SCHEMA = "doc_id long, sent_id long, pos long, date int, l string"


@pytest.mark.parametrize("distance", [1, 3, 5])
def test_marginals_are_the_sums_of_pairs(spark, monkeypatch, distance):
    monkeypatch.setattr(relations, "BLOCK", 8)
    lengths = [1, 2, 3, 1, 7, 30, 5, 6, 11, 1, 1, 4]
    rows = [(k % 4 if k % 5 else None, k, i, 1990 + k % 3, "abc"[(k + i) % 3]) for k, n in enumerate(lengths) for i in range(n)]
    blocks = relations.windows(spark.createDataFrame(rows, SCHEMA), ("l",), distance)
    found = Counter(map(tuple, relations.marginals_of(blocks, ("l",), distance).select("l", "date", "f1").collect()))
    pairs = relations.marginals(relations.cooccurrences_of(blocks, ("l",), distance), ("l",))
    assert found == Counter(map(tuple, pairs.select("l", "date", "f1").collect()))
    assert sum(n for _, _, n in found) == sum(min(distance, i) + min(distance, n - 1 - i) for n in lengths for i in range(n))


def test_no_window_is_walked_through(spark):
    blocks = relations.windows(spark.createDataFrame([(1, 1, 0, 1990, "a"), (1, 1, 1, 1990, "b")], SCHEMA), ("l",))
    plan = relations.marginals_of(blocks, ("l",))._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan


@pytest.mark.parametrize("distance", [1, 3, 5])
def test_sentences_of_a_row_each_need_no_shuffle_and_no_file(spark, monkeypatch, distance):
    """Blocks cut from whole sentences give the pairs and marginals of windows over their tokens; no exchange stands before the sums, and nothing is written."""
    monkeypatch.setattr(relations, "BLOCK", 8)
    texts = [(k if k % 5 else 20 + k, 1990 + k % 3, [("abc"[(k + i) % 3],) for i in range(n)]) for k, n in enumerate([1, 2, 3, 0, 7, 8, 30, 5, 6, 11, 16, 17, 4])]
    tokens = spark.createDataFrame([(d, 0, i, y, w) for d, y, t in texts for i, (w,) in enumerate(t)], SCHEMA)
    sentences = spark.createDataFrame([(y, t) for _, y, t in texts] + [(1990, None)], "date int, tokens array<struct<l: string>>")
    windows = relations.windows(tokens, ("l",), distance)
    monkeypatch.setattr(relations, "written", None)
    blocks = relations.blocks_of(sentences, ("l",), distance)
    for made in (relations.marginals_of, relations.cooccurrences_of):
        assert Counter(map(tuple, made(blocks, ("l",), distance).collect())) == Counter(map(tuple, made(windows, ("l",), distance).collect()))
    assert Counter(map(tuple, relations.sentence_marginals(sentences, ("l",), distance).collect())) == Counter(map(tuple, relations.marginals_of(windows, ("l",), distance).collect()))
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cof_global_T", "rollup_slices_T"])
def test_texts_are_not_written_by_tokens(spark, monkeypatch, name):
    """Of what these queries write, nothing has a row or an element a token: marginals by word and largest slice, and their sums by level."""
    from chronolex import catalogue
    from chronolex.operators import profiles

    seen, kept = [], relations.written
    for module in (relations, profiles):
        monkeypatch.setattr(module, "written", lambda df: seen.append((df.columns, df.count())) or kept(df))
    data = "/root/testdata/sf0.001"
    assert catalogue.queries()[name](spark, data).count() > 0
    words = spark.read.parquet(f"{data}/documents.parquet").selectExpr(r"explode(regexp_extract_all(lower(text), '\\p{L}+', 0)) l").distinct().count()
    assert seen[0][0] == ["l", "date", "f1"] and seen[0][1] <= words * (1 if name == "cof_global_T" else 10)
    assert all("t" not in c and "pos" not in c for c, _ in seen)
