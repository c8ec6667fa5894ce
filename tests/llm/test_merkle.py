"""Operator 11 against trees built one by one."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from chronolex.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def lower(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(values):
    """The last node, and for each value its siblings (before, after) upwards."""
    levels = [values]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    steps = []
    for k in range(len(values)):
        path = []
        for nodes in levels[:-1]:
            run = k // 16 * 16
            path.append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + 16])))
            k //= 16
        steps.append(path)
    return levels[-1][0], steps


def brute(rows):
    """Sorted result rows of (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for d, text, lang, source, n in rows:
        chosen = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        groups[(source is not None, (source or "").encode())].append((d is not None, d or 0, leaf(d, source, lang, n, text), leaf(d, source, lang, n, lower(text) if chosen else text), d))
    trees = [(sorted(groups[k]), *tree([x[2] for x in sorted(groups[k])])) for k in sorted(groups)]
    root, tops = tree([t[1] for t in trees])
    out = []
    for (leaves, subroot, steps), top in zip(trees, tops, strict=True):
        for (_, _, value, tampered, d), path in zip(leaves, steps, strict=True):
            fold = tampered
            for before, after in path + top:
                fold = sha(before, fold, after)
            out.append((d, value, subroot, root, sha(*(b + a for b, a in path + top)), fold, fold == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def result(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return rows_of(merkle.op11_mountain_manifest(spark, str(tmp_path)))


def test_op11(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = rows_of(merkle.op11_mountain_manifest(spark, data))
    assert got == brute(rows) and 0 < sum(not r[-1] for r in got) < len(got) / 4


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (16, 17), (15, 1, 256, 257, 33), (4097,)])
@pytest.mark.parametrize("parts", [1, 9])
def test_sizes_and_edges(spark, tmp_path, sizes, parts):
    rows = [(10_000 * s + k, f"Text {k}", "en", f"s{s}", k) for s, n in enumerate(sizes) for k in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert result(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), tmp_path) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_sources_nulls_and_repeated_rows(spark, tmp_path):
    rows = [(k, "A text", "en", f"ü{k % 300}" if k % 301 else None, 6) for k in range(700)] + [(5, "Other", None, "ü5", None), (5, "Other", None, "ü5", None), (None, None, None, None, None), (7, "", "", "", 0), (8, "X" * 100_000, "de", "Z", 1)]
    assert result(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), tmp_path) == brute(rows)


def test_odd_rows(spark, odd, empty, tmp_path):
    from tests.llm.conftest import ODD

    assert result(spark, odd, tmp_path / "odd") == brute([(d, t, "en", None, len(t or "")) for d, t in ODD])
    assert result(spark, empty, tmp_path / "empty") == []
    found = merkle.manifest(merkle.document_leaves(empty), "doc_id")
    assert found.root() is None


def test_written_manifests_tell_what_changed(spark, tmp_path):
    rows = [(k, f"t{k}", "en", f"s{k % 7}", 2) for k in range(200)]
    other = [(k, t + "!" if k == 15 else t, g, s, n) for k, t, g, s, n in rows if s != "s3"] + [(999, "x", "en", "new", 1)]
    for name, x in (("a", rows), ("b", other)):
        merkle.manifest(merkle.document_leaves(spark.createDataFrame(x, SCHEMA)), "doc_id").write(str(tmp_path / name))
    a, b = (merkle.Manifest.read(spark, str(tmp_path / n)) for n in "ab")
    assert a.root() != b.root() and a.root() == brute(rows)[0][3]
    assert sorted(map(tuple, merkle.changed(a, b).collect())) == [("=new", "added"), ("=s1", "changed"), ("=s3", "gone")]
    assert merkle.changed(a, a).count() == 0


def test_stack_merges_any_cut():
    """Peaks and nodes of a tree that is cut anywhere hold each node of the whole once, but for those of cut runs."""
    values = [sha(str(k)) for k in range(300)]
    whole, last = {}, tree(values)[0]

    def into(found):
        return lambda level, idx, value, end, peak: None if peak else found.__setitem__((level, idx), value)

    stack = merkle.MountainRange(into(whole))
    for k, v in enumerate(values):
        stack.push(k, v, k == 299)
    assert whole[(3, 0)] == last and len(whole) == 19 + 2 + 1
    for cut in (1, 16, 17, 255, 256, 299):
        found, peaks = {}, []
        for part in (range(cut), range(cut, 300)):
            stack = merkle.MountainRange(lambda level, idx, value, end, peak: (peaks.append if peak else lambda x: found.__setitem__(x[:2], x[2]))((level, idx, value)))
            for k in part:
                stack.push(k, values[k], k == 299)
            stack.over()
        assert found.items() <= whole.items() and all(level == 0 or whole[(level, idx)] == v for level, idx, v in peaks) and len(peaks) <= 90
