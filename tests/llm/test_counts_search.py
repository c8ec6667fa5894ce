"""Operators 3 and 10 against brute force."""

import math
from collections import Counter

import pytest

from chronolex.llm import bm25, byte_bpe, token_rollup
from chronolex.llm.common import tokenizer


def told(df):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in df.collect()}


def test_op3(spark, data):
    import duckdb

    want, bpe = {}, tokenizer(byte_bpe.default_files()[0])
    for source, lang, text in duckdb.sql(f"SELECT source, lang, text FROM '{data}/documents.parquet'").fetchall():
        words = len((text or "").encode().split())
        if words >= 10:
            for name, n in (("words", words), ("byte_bpe_50k", len(bpe.encode(text, add_special_tokens=False).ids) + 1)):
                a, b = want.get((source, lang, name), (0, 0))
                want[source, lang, name] = (a + 1, b + n)
    assert told(token_rollup.op3_delta_rollup(spark, data)) == want


def test_batches(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame(r, "source string, lang string, tokenizer string, n_tokens long")
    load = token_rollup.inserts(rows(("a", "en", "v1", 5), ("a", "en", "v1", 7), (None, None, "v1", None), ("b", "de", "v1", 4)))
    assert token_rollup.commit(store, "b1", load) and not token_rollup.commit(store, "b1", load)
    assert told(token_rollup.totals(spark, store)) == {("a", "en", "v1"): (2, 12), (None, None, "v1"): (1, 0), ("b", "de", "v1"): (1, 4)}
    moved = spark.createDataFrame([("a", "en", "v1", 5, "b", "en", "v2", 6)], ", ".join(f"{s}{c}" for s in ("old_", "new_") for c in ("source string", "lang string", "tokenizer string", "n_tokens long")))
    assert token_rollup.commit(store, "b2", token_rollup.revisions(moved)) and token_rollup.commit(store, "b3", token_rollup.deletes(rows(("b", "de", "v1", 4))))
    assert token_rollup.commit(store, "b4", load.limit(0))
    assert told(token_rollup.totals(spark, store)) == {("a", "en", "v1"): (1, 7), (None, None, "v1"): (1, 0), ("b", "en", "v2"): (1, 6)}
    with pytest.raises(ValueError):
        token_rollup.commit(store, "../x", load)


def test_two_writers_and_a_crash(spark, tmp_path):
    """Two writers of one batch, both past the look for it, count once; a writer that dies before its manifest counts not at all."""
    store = str(tmp_path / "store")
    rows = lambda n: spark.createDataFrame([("a", "en", "v1", n)], "source string, lang string, tokenizer string, n_tokens long")
    staged = [token_rollup._staged(store, "b1", token_rollup.inserts(rows(5))) for _ in range(2)]
    assert told(token_rollup.totals(spark, store)) == {}
    assert [token_rollup._published(spark, store, "b1", *x, []) for x in staged] == [True, False]
    assert told(token_rollup.totals(spark, store)) == {("a", "en", "v1"): (1, 5)}
    token_rollup._staged(store, "b2", token_rollup.inserts(rows(7)))  # and then it dies
    assert told(token_rollup.totals(spark, store)) == {("a", "en", "v1"): (1, 5)}
    assert token_rollup.commit(store, "b2", token_rollup.inserts(rows(7))) and not token_rollup.commit(store, "b2", token_rollup.inserts(rows(7)))
    with pytest.raises(ValueError, match="other sums"):
        token_rollup.commit(store, "b2", token_rollup.inserts(rows(8)))
    for more in ("b3", "b4"):
        assert token_rollup.compact(spark, store) and told(token_rollup.totals(spark, store))["a", "en", "v1"][0] == (2 if more == "b3" else 3)
        assert token_rollup.commit(store, more, token_rollup.inserts(rows(1))) and not token_rollup.commit(store, "b1", token_rollup.inserts(rows(5)))
    assert told(token_rollup.totals(spark, store)) == {("a", "en", "v1"): (4, 14)}


def test_counted_odd_rows(spark, odd, empty):
    rows = sorted((r["words"], r["ids"]) for r in token_rollup.counted(odd, *byte_bpe.default_files()).collect())
    assert len(rows) == 12 and rows[0] == (0, 0) and rows[-1][0] == 30_000 and token_rollup.counted(empty, *byte_bpe.default_files()).count() == 0


def brute(docs, queries, k=bm25.K):
    bags = [(d, Counter((t or "").encode().lower().split())) for d, t in docs]
    df, n = Counter(w for _, b in bags for w in b), len(bags)
    mean = sum(sum(b.values()) for _, b in bags) / max(1, n) or 1.0
    out = {}
    for q, text in queries:
        terms, scores = set((text or "").encode().lower().split()), []
        for d, bag in bags:
            if d is None or d == q:
                continue
            length = sum(bag.values())
            s = math.fsum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * length / mean)) for w in terms if w in bag)
            if s > 0:
                scores.append((-round(s, 6), d))
        out[q] = [(d, -s) for s, d in sorted(scores)[:k]]
    return out


def same(got, want):
    """Equal ranks and scores; where scores tie in six places either order will do."""
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    assert found.keys() == {q for q, v in want.items() if v}
    for q, rows in found.items():
        assert [round(s, 5) for _, s in rows] == [round(s, 5) for _, s in want[q]]
        assert len({d for d, _ in rows}) == len(rows)
        assert {d for d, s in rows if s > rows[-1][1] + 1e-5} == {d for d, s in want[q] if s > rows[-1][1] + 1e-5}


def test_op10(spark, data, texts):
    same(bm25.op10_block_max_wand(spark, data).collect(), brute(list(texts.items()), [(d, t) for d, t in texts.items() if d % 100 == 0]))


def test_pruning_in_small_shards(spark, data, texts, monkeypatch):
    docs = list(texts.items())
    batch = lambda: iter([__import__("pyarrow").RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]})])
    monkeypatch.setattr(bm25, "SHARD_POSTINGS", 4000)
    rows = [r for b in bm25._indexed(batch()) for r in b.to_pylist()]
    assert len(rows) > 5 and sum(r["n_docs"] for r in rows) == len(docs)
    shard = bm25.Shard(rows[0], 100.0)
    terms, _ = bm25.terms_of(docs[3][1])
    import numpy as np

    ask = lambda k: next(shard.search(np.array([-1]), np.array([0, len(terms)]), terms, np.ones(len(terms)), k, np.zeros(1)))
    all_ids, all_scores = ask(10_000)
    ids, scores = ask(3)
    assert ids.tolist() == all_ids[:3].tolist() and np.allclose(scores, all_scores[:3])


def test_blocks_are_skipped_unread():
    """Where few documents hold a query's rare word, most documents and blocks are skipped unscored, more so with a threshold from other shards, and the answer is
    that of scoring all."""
    import random

    import numpy as np
    import pyarrow as pa

    rnd = random.Random(9)
    docs = [(k, " ".join(rnd.choices(["the", "of", "and", "to"], k=20) + rnd.choices([f"w{j}" for j in range(300)], k=10) + (["rare"] if k % 97 == 5 else []))) for k in range(3000)]
    rows = [r for b in bm25._indexed(iter([pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]})])) for r in b.to_pylist()]
    assert len(rows) == 1
    queries = [(-1, "rare the of and"), (5, docs[5][1]), (-2, "the of"), (-3, "nothing of this kind")]
    want = brute(docs, queries)
    df, n = Counter(w for _, t in docs for w in set(t.split())), len(docs)
    mean = sum(len(t.split()) for _, t in docs) / n
    for q, text in queries:
        words = {int(bm25.terms_of(w)[0][0]): w for w in set(text.split())}
        terms = np.array(sorted(words))
        idf = np.array([math.log(1 + (n - df[words[t]] + 0.5) / (df[words[t]] + 0.5)) for t in terms.tolist()])
        shard, floor = bm25.Shard(rows[0], mean), 0.0
        ids, scores = next(shard.search(np.array([q]), np.array([0, len(terms)]), terms, idf, 10, np.array([floor])))
        assert len(scores) == len(want[q]) and np.allclose(scores, [s for _, s in want[q]], atol=2e-6)
        assert {d for d, s in zip(ids.tolist(), scores.tolist(), strict=True) if s > scores[-1] + 1e-5} == {d for d, s in want[q] if s > scores[-1] + 1e-5}
        first = dict(shard.seen)
        if q == -1:
            assert first["scored_documents"] < 0.1 * first["documents"] and first["skipped_blocks"] > 0.3 * first["blocks"]
        if len(scores) == 10:
            again, same_scores = next(shard.search(np.array([q]), np.array([0, len(terms)]), terms, idf, 10, scores[-1:]))
            assert again.tolist() == ids.tolist() and np.allclose(same_scores, scores)
            assert shard.seen["scored_documents"] - first["scored_documents"] <= first["scored_documents"]


def test_lists_before_the_pivot_are_skipped():
    """With a threshold that weak lists can't reach, these are read for candidates alone, and no answer changes."""
    import random

    import numpy as np
    import pyarrow as pa

    rnd = random.Random(4)
    docs = [(k, " ".join([f"w{j}" for j in rnd.sample(range(400), 12)] + ["key", "lock"] * (k % 50 == 7))) for k in range(2000)]
    rows = [r for b in bm25._indexed(iter([pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]})])) for r in b.to_pylist()]
    text = "key lock " + " ".join(f"w{j}" for j in range(40))
    words = {int(bm25.terms_of(w)[0][0]): w for w in text.split()}
    terms = np.array(sorted(words))
    idf = np.array([5.0 if words[t] in ("key", "lock") else 0.01 for t in terms.tolist()])
    for loose in (0.0, 0.02, 0.5):
        shard = bm25.Shard(rows[0], 12.0)
        old, bm25.LOOSE = bm25.LOOSE, loose
        try:
            ids, scores = next(shard.search(np.array([-1]), np.array([0, len(terms)]), terms, idf, 10, np.array([9.0])))
        finally:
            bm25.LOOSE = old
        if loose == 0:
            want = ids.tolist(), scores.tolist()
        assert ids.tolist() == want[0] and np.allclose(scores, want[1])
        assert (shard.seen["skipped_postings"] > 0) == (loose > 0)


def test_odd_rows(spark, odd, empty):
    from tests.llm.conftest import ODD

    queries = odd.selectExpr("doc_id as query_id", "text").filter("query_id is not null").dropDuplicates(["query_id"])
    asked = [(d, t) for d, t in dict(x for x in ODD if x[0] is not None).items()]
    want = brute(ODD, asked)
    got = bm25.top_k(odd, queries).collect()
    for q, rows in want.items():
        assert [round(r["score"], 5) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [round(s, 5) for _, s in rows]
    assert bm25.top_k(empty, empty.selectExpr("doc_id as query_id", "text")).count() == 0


def test_few_documents_are_scored_under_a_known_threshold():
    """Of whole documents as queries, over subjects in words as frequent as in prose, one document in twenty is scored at most once the k-th best score is known, and the answer is that of no threshold."""
    import random

    import numpy as np
    import pyarrow as pa

    rnd = random.Random(3)
    words, weights = [f"w{j}" for j in range(5000)], [1 / (j + 3) for j in range(5000)]
    subjects = [rnd.sample(words[50:], 60) for _ in range(80)]
    docs = [(k, " ".join(rnd.choices(words, weights, k=(n := rnd.choice([40, 150, 400]))) + rnd.choices(subjects[k % 80], k=n // 3))) for k in range(2000)]
    rows = [r for b in bm25._indexed(iter([pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]})])) for r in b.to_pylist()]
    assert len(rows) == 1
    df, n = Counter(t for _, text in docs for t in bm25.terms_of(text)[0].tolist()), len(docs)
    asked = [bm25.terms_of(docs[k][1])[0] for k in range(0, 2000, 100)]
    offsets, terms = np.cumsum([0, *map(len, asked)]), np.concatenate(asked)
    idf = np.array([math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in terms.tolist()])
    search = lambda shard, floors: list(shard.search(np.arange(0, 2000, 100), offsets, terms, idf, 10, floors))
    mean = sum(len(t.split()) for _, t in docs) / n
    want = search(bm25.Shard(rows[0], mean), np.zeros(20))
    shard = bm25.Shard(rows[0], mean)
    got = search(shard, np.array([scores[-1] for _, scores in want]))
    assert [a.tolist() for a, _ in got] == [a.tolist() for a, _ in want] and all(np.allclose(a, b) for (_, a), (_, b) in zip(got, want, strict=True))
    assert 20 * shard.seen["scored_documents"] <= shard.seen["documents"]
