"""Operator 2 against all pairs."""

import random
from collections import Counter

import numpy as np

from chronolex.llm import near_dup


def brute(texts):
    """doc -> (set size, class) by comparing all pairs of sets of word tuples."""
    sets = {}
    for doc, text in texts:
        words = (text or "").encode().lower().split()
        sets.setdefault(doc, frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else []))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(sets)
    for k, a in enumerate(docs):
        for b in docs[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in docs}


def test_op2(spark, data, texts):
    want = brute(list(texts.items()))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.op2_lsh_forest(spark, data).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_large_group_of_near_copies(spark):
    rnd = random.Random(11)
    words = [f"v{k}" for k in range(3000)]
    base = rnd.choices(words, k=150)
    rows = []
    for k in range(400):  # a common text, a few words of which differ
        copy = list(base)
        for at in rnd.sample(range(150), rnd.choice([0, 1, 2, 3])):
            copy[at] = rnd.choice(words)
        rows.append((1000 + k, " ".join(copy)))
    shared = rnd.choices(words, k=60)
    rows += [(5000 + k, " ".join(shared + rnd.choices(words, k=60))) for k in range(150)]  # a common passage is no copy
    rows += [(9000 + k, rows[k][1].upper()) for k in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == {d: c for d, (_, c) in brute(rows).items()}


def test_chain_of_links(spark):
    """Each text is a link of the next only; all are one class."""
    rows = [(k, " ".join(f"c{j}" for j in range(8 * k, 8 * k + 204))) for k in range(40)]
    got = {r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0} and {c for _, c in brute(rows).values()} == {0}


def test_odd_rows(spark, odd, empty):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(odd).collect()), key=str)
    want = [(1, 0, 1, True), (10, 197, 9, False), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (9, 196, 9, True), (None, 1, None, True)]
    assert [g for g in got if g[0] != 8] == sorted(want, key=str)
    assert near_dup.near_duplicates(empty).count() == 0


def test_signatures_estimate_similarity():
    a, b = (near_dup.shingles(" ".join(f"w{k}" for k in range(x, x + 1000))) for x in (0, 100))
    share = (near_dup.signature(a) == near_dup.signature(b)).mean()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(share - true) < 0.12 and len(near_dup.shingles("")) == 0


def test_among_keeps_exactly_the_wanted(spark):
    rows = spark.range(-3000, 3000).selectExpr("id as doc", "cast(id as string) as text").unionByName(spark.sql("SELECT cast(NULL as long) doc, 'x' text"))
    wanted = [-2999, -64, -1, 0, 7, 8, 32767, 2500] + list(range(100, 400))
    got = near_dup._among(rows, spark.createDataFrame([(k,) for k in wanted], "doc long"))
    assert sorted(map(tuple, got.collect())) == sorted((k, str(k)) for k in wanted if k < 3000)
    assert near_dup._among(rows, spark.createDataFrame([], "doc long")).count() == 0


def test_links_within_a_family_that_is_alike(spark):
    """Thousands of texts alike at 0.7 to 0.84 and, far apart in any order, pairs of them at 0.85 to 0.9."""
    rnd, fresh = random.Random(5), iter(range(10**9))
    own = lambda n: [f"o{next(fresh)}" for _ in range(n)]
    common, rows = own(160), []
    for k in range(2400):
        rows.append((k, common + own(rnd.randint(16, 32))))
    for k in range(100):
        rows.append((5000 + k, common + (tail := own(20))))
        rows.append((8000 + k, common + tail[: -rnd.randint(10, 14)] + own(0)))
        rows[-1][1].extend(own(180 - len(rows[-1][1])))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in rows}
    held = Counter(x for s in sets.values() for x in s)
    place = {x: k for k, x in enumerate(x for x, n in held.items() if n > 1)}
    has, docs = np.zeros((len(rows), len(place)), dtype=np.float32), np.array([d for d, _ in rows])
    for k, d in enumerate(docs):
        has[k, [place[x] for x in sets[d] if x in place]] = 1
    both, size = (has @ has.T).round().astype(np.int64), np.array([len(sets[d]) for d in docs])
    a, b = np.nonzero(np.triu(100 * both >= 85 * (size[:, None] + size - both), 1))
    assert sorted(zip(docs[a].tolist(), docs[b].tolist(), strict=True)) == [(5000 + k, 8000 + k) for k in range(100)]
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame).collect()}
    assert got == {d: d - 3000 if d >= 8000 else d for d, _ in rows}


def brute_rows(rows):
    """(doc_id, set size, class) of each row, where rows that share a doc_id are one document."""
    sets = []
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(sets):
        for j in range(k):
            y = sets[j]
            if x and y and (rows[k][0] == rows[j][0] or 100 * len(x & y) >= 85 * len(x | y)):
                root[find(k)] = find(j)
    name = {}
    for k, (doc, _) in enumerate(rows):
        name[find(k)] = min(doc, name.get(find(k), doc))
    return sorted((doc, len(sets[k]), name[find(k)]) for k, (doc, _) in enumerate(rows))


def test_rows_that_share_a_doc_id(spark):
    """A doc_id with two texts is linked with what is near either; its class goes on through both."""
    rnd = random.Random(2)
    text = lambda k, n=120: [f"{k}x{j}" for j in range(n)]
    a, b = text("a"), text("b")
    four = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*b[:-1], "end"])), (3, " ".join([*a[:-1], "end"]))]
    got = lambda rows: sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got(four) == brute_rows(four) and {c for _, _, c in got(four)} == {1}
    bases, rows = [text(k) for k in range(12)], []
    for _ in range(150):
        words = list(rnd.choice(bases))
        for at in rnd.sample(range(len(words)), rnd.choice([0, 0, 1, 2, 6])):
            words[at] = f"n{rnd.random()}"
        rows.append((rnd.randint(-40, 40), " ".join(words)))
    rows += [(-100, " ".join(text(f"own{k}"))) for k in range(40)] + [(90, ""), (90, " ".join(bases[3]))]
    assert got(rows) == brute_rows(rows)
