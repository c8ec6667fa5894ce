"""Operator 13 against a version in plain Python."""

import hashlib
import math
from collections import Counter, defaultdict

import xxhash

from chronolex.llm import imatch

SCHEMA = "doc_id long, text string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def word_hash(w):
    return signed(xxhash.xxh64_intdigest(w.encode(), seed=42))


def terms(text):
    words = text.lower()
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    return {word_hash(w) for w in words.split(" ") if w}


def level(t):
    return min(imatch.LEVELS, next((k for k in range(64) if t >> k & 1), 64))


def printed(text, band):
    found = terms(text)
    first = max(0, math.ceil(math.log2(max(len(found), 1) / imatch.TERMS)))
    subsets = defaultdict(list)
    for t in sorted(t for t in found & band if level(t) >= first):
        subsets[level(t) * imatch.SUBSETS + ((t % (1 << 64)) >> 48) % imatch.SUBSETS].append(t)
    hashes = set()
    for code, members in subsets.items():
        h = 42
        for t in members:
            h = xxhash.xxh64_intdigest((t % (1 << 64)).to_bytes(8, "little"), seed=h % (1 << 64))
        hashes.add((code, h & 0xFFFFFFFF))
    return first, hashes, hashlib.sha256(text.encode()).hexdigest()


def as_text(p):
    return f"{p[0]}:" + ".".join(f"{c << 32 | h:x}" for c, h in sorted(p[1])) if p[1] else "=" + p[2]


def likeness(a, b):
    if a[2] == b[2]:
        return 1.0
    if not a[1] or not b[1]:
        return 0.0
    start = max(a[0], b[0]) * imatch.SUBSETS
    x, y = ({(c, h) for c, h in p[1] if c >= start} for p in (a, b))
    held = {c for c, _ in x | y}
    return len(x & y) / len(held) if held else 0.0


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, word_hash(r[1])))
    docs = Counter(t for _, text in rows for t in terms(text))
    most = max(imatch.LEAST_DOCS, len(rows) // imatch.SELDOM)
    band = {t for t, n in docs.items() if imatch.LEAST_DOCS <= n <= most}
    out = []
    for k, (d, text) in enumerate(rows):
        after, q = rows[(k + 1) % len(rows)][1], len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b, c = (printed(x, band) for x in (text, edited, after))
        out.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(a), as_text(b), round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, df.collect())), key=str)


def result(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    return rows_of(imatch.op13_imatch_fingerprints(spark, str(path)))


def test_op13(spark, data, texts):
    got = rows_of(imatch.op13_imatch_fingerprints(spark, data))
    assert got == brute(texts.items())
    near = [r[5] for r in got if r[1] >= 100]
    assert sum(near) / len(near) > 0.4 and sum(r[6] for r in got) / len(got) < 0.1
    assert sum(r[5] > r[6] for r in got) > 0.95 * len(got)


def test_copies_and_repeated_ids(spark, tmp_path, texts):
    some = [t for t in texts.values() if len(t) > 50][:40]
    rows = [(7, t) for t in some] + [(7, some[3])] * 3 + [(k, some[k % 5]) for k in range(100, 160)] + [(None, t) for t in some[:9]]
    got = result(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), tmp_path)
    assert got == brute(rows)
    assert all(r[6] == 1.0 for r in got if r[0] == 7 and got.count(r) > 2)


def test_hot_id_is_laid_out_over_ranges(spark, texts):
    some = list(texts.values())
    rows = [(k if k % 3 else 1000, some[k % len(some)] + str(k)) for k in range(1500)] + [(5000 + k, "x") for k in range(600)]
    docs = spark.createDataFrame(rows, "at long, text string")
    ranged = imatch._ranged(docs, len(rows)).collect()
    ordered = sorted(ranged, key=lambda r: (r["at"], r["key"]))
    assert [r["part"] for r in ordered] == sorted(r["part"] for r in ranged)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        parts = Counter(r["part"] for r in imatch._ranged(docs, len(rows)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert max(parts.values()) < 4 * len(rows) / 32


def test_odd_rows(spark, odd, empty, tmp_path):
    from tests.llm.conftest import ODD

    assert result(spark, odd, tmp_path / "odd") == brute(ODD)
    assert result(spark, empty, tmp_path / "empty") == []
    assert result(spark, spark.createDataFrame([(3, "abcdefgh")], SCHEMA), tmp_path / "one") == brute([(3, "abcdefgh")])


def test_no_python_workers(spark, data):
    plan = imatch.op13_imatch_fingerprints(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_every_term_of_long_texts_counts(spark, tmp_path):
    """Texts of 2,000 words that differ in words of the densest level alone, all of them in the lexicon, have other fingerprints."""
    words = [f"w{k}" for k in range(2000)]
    dense = [w for w in words if level(word_hash(w)) == 0][:3]
    rows = [(1, " ".join(words)), (2, " ".join(w for w in words if w not in dense)), (3, " ".join(dense))]
    got = result(spark, spark.createDataFrame(rows, SCHEMA), tmp_path)
    assert got == brute(rows)
    a, b, c = (next(r for r in got if r[0] == k) for k in (1, 2, 3))
    assert a[3] != b[3] and 0.5 < a[6] < 1.0 and not c[3].startswith("=")


def test_words_made_at_seams(spark, tmp_path):
    """Short texts of few letters and many kinds of blanks: words that an edit makes are looked up, and what one text has alone isn't in the lexicon."""
    import random

    rnd = random.Random(5)
    rows = [(rnd.choice([None, 1, 2, 3, *range(10, 200)]), "".join(rnd.choices("aAbc \n\t", k=rnd.choice([0, 1, 3, 4, 5, 9, 20, 60])))) for _ in range(400)]
    got = result(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), tmp_path)
    assert got == brute(rows)
