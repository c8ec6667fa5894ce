"""Operator 12 against its SQL and against counts in plain Python."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa

from chronolex.llm import phrases, queries

SCHEMA = "text string, lang string"


def brute(rows, least=30, best=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    kept = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    out = []
    for (lang, w), a in kept.items():
        inside = [b for (g, v), b in kept.items() if g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if not any(100 * b >= 80 * a for b in inside):
            score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:best]
        ranked += [(lang, k + 1, *x[1:]) for k, x in enumerate(mine)]
    return sorted(ranked)


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_op12(spark, data):
    got = sorted(map(tuple, phrases.op12_suffix_sigma(spark, data).collect()))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert got == sorted(duckdb.sql(queries.oracle_sql()["op12_suffix_sigma"]).fetchall()) and len(got) > 20
    texts = duckdb.sql("SELECT text, lang FROM documents").fetchall()
    assert got == brute(texts)


def test_ranges_spans_and_batches(spark, monkeypatch):
    """Few words that make many frequent phrases, over languages, with cuts of texts and of batches anywhere."""
    rnd = random.Random(3)
    rows = [("".join(rnd.choice(["a", "b", "bb", "Ü", "\x01", "a\x00"]) + rnd.choice([" ", " ", " ", "\t ", ". ", "\n"]) for _ in range(rnd.randint(0, 300))), rnd.choice(["en", "en", "e", None])) for _ in range(200)]
    rows += [("hot pair " * 3000, "en")]
    want = brute(rows)
    for span, words, least_range in ((1 << 22, 1 << 19, 1 << 20), (64, 50, 300)):
        monkeypatch.setattr(phrases, "SPAN", span)
        monkeypatch.setattr(phrases, "WORDS_AT_ONCE", words)
        monkeypatch.setattr(phrases, "RANGE_ROWS", least_range)
        assert sorted(map(tuple, phrases.collocations(made(spark, rows).repartition(3)).collect())) == want
        filled = pa.RecordBatch.from_pydict({"text": [t for t, _ in rows], "lang": [g or "und" for _, g in rows]})
        suffixes = [b for b in phrases._suffixes(iter([filled]), [b"en\xffa", b"en\xffh"])]  # what a worker does, with these limits
        total = Counter()
        for b in suffixes:
            for part, key, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                total[key] += n
                assert part == (key >= b"en\xffa") + (key >= b"en\xffh")
        ordered = sorted(total.items(), reverse=True)
        for size in (1, 7, 10**6):
            pieces = [pa.RecordBatch.from_pydict({"key": [k for k, _ in ordered[i : i + size]], "n": [n for _, n in ordered[i : i + size]]}) for i in range(0, len(ordered), size)]
            found = Counter()
            for b in phrases._counted(iter(pieces), 30):
                for lang, phrase, k, f in zip(*(b.column(c).to_pylist() for c in ("lang", "phrase", "k", "f")), strict=True):
                    found[lang, phrase, k] += f
            assert all(found[r[0], r[2], len(r[2].split(" "))] == r[3] and found[r[0], "", 0] == r[6] for r in want)


def test_limits_and_least(spark):
    rows = [(f"p{k} q{k} r{k % 3}. " * (k % 5 + 2), "en") for k in range(60)]
    for least, best in ((2, 2000), (3, 7)):
        assert sorted(map(tuple, phrases.collocations(made(spark, rows), least, best).collect())) == brute(rows, least, best)


def test_large_counts_are_exact(spark):
    huge = 9 * 10**15
    found = phrases.scored(spark.createDataFrame([("x", "a b", 2, huge), ("x", "a", 1, huge), ("x", "b", 1, huge + 1), ("x", "", 0, 4 * huge)], "lang string, phrase string, k int, f long")).collect()
    assert [tuple(r) for r in found] == [("x", "a b", huge, huge, huge + 1, 4 * huge, 2000000 * huge // (2 * huge + 1))]


def test_odd_rows(spark, odd, empty):
    from tests.llm.conftest import ODD

    assert sorted(map(tuple, phrases.collocations(odd).collect())) == brute([(t, "en") for _, t in ODD])
    assert phrases.collocations(empty).count() == 0
