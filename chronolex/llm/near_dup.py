"""Near-duplicate classes by an LSH forest.

Each document is a set of five-word shingles. Equal sets fall together by a digest, and one document stands for each. Its MinHash signature
is written in TREES orders; in each order all documents are sorted, and a document's candidates are those that follow it with a common
prefix of LEAST_DEPTH values or more, the nearest first; in a region of many documents, which the exact join below looks through, only the two nearest. So the depth that a candidate must share adapts to the region: where many documents
share a short prefix, the next ones in order share a longer one. In regions of several depths the document that most others share values with, as a
model does with its copies, is a candidate of all. A comparison of whole signatures drops candidates of which fewer than LEAST_SHARE of the values are equal: a link at exactly 85 % is
taken for one of those with a probability of one in a billion, six deviations away.

Links are confirmed on full sets: the two likeliest candidates of each document first, then all whose documents are still in different
components, so that every candidate is either confirmed, refuted or within a component. Components come from repeated contraction
to the smallest neighbour.

A region with more documents than the walk compares, and with more than one component, is crowded. The documents of crowded regions go through an exact join of sets:
their shingles are ordered rare first, a link shares one among the first of both, and places and sizes bound what they can share. Pairs that the
bounds leave, in different components, are confirmed on full sets. So of the pairs that share a region none is left out.

All steps are sorts, sums and joins over narrow tables; a sort splits a group of any size, the forest gives each document a bounded number of
candidates, a join deals the rows of a frequent key to many tasks, and what the join of sets meets at a frequent shingle is dealt likewise.

Defined cases: a null or empty text, or one without words, has no shingles and is linked with nothing; a text of fewer than five words is
one shingle; texts of any length are whole; rows that share a doc_id are one document: each gives a row, all links of all their texts count, and all that have shingles are in one class; a null
doc_id never stands for others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROWS_AT_ONCE, forget, null_as_empty, picked, stored, table

WORDS = 5
#: A pair of 85 % similarity shares four values in one of 16 orders at least, but for seven pairs in a million.
TREES, DEPTH, LEAST_DEPTH = 16, 12, 4
#: Followers in order that a document is compared with, in each order.
FOLLOWERS = 4
#: Of those the nearest ones that do in a region with more documents than they are, as all its pairs are seen by the exact join if these leave it in pieces.
NEAREST = 2
#: Documents that share so many values are a run, if there are enough; the depths of regions that each have a most popular document.
RUN_DEPTH, LEAST_RUN, HUB_DEPTHS = 6, 3, (4, 6, 9, 12)
#: Bits of the map that tells where texts are read which of them candidates may need; 8 MB, however many there are.
FILTER_BITS, _MAP_BITS = 1 << 26, 1 << 15
#: Share of equal signature values under which a pair isn't confirmed: of 192 values a link's share has a deviation of 0.026.
LEAST_SHARE = 0.70
#: Counters of the sketch that orders shingles by frequency, those of a page of it, and the documents of a shingle that one task of the join meets with the others.
SKETCH, _SKETCH_PAGE, POSTS = 1 << 22, 1 << 15, 1024
#: Rows of one key that a task of a join takes.
HOT = 1 << 15
#: Links: LINK[0] * intersection >= LINK[1] * union.
LINK = (100, 85)
_MEMO = 1 << 18

_random = np.random.default_rng(20240229)
_MULTIPLY = _random.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _random.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)
_memo: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; only A-Z are lowered, only ASCII white space parts words."""
    words = text.encode().lower().split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)] if words else [], dtype=np.uint64)
    try:
        hashed = list(map(_memo.__getitem__, words))
    except KeyError:
        if len(_memo) > _MEMO:
            _memo.clear()
        for w in words:
            if w not in _memo:
                _memo[w] = xxhash.xxh64_intdigest(w)
        hashed = list(map(_memo.__getitem__, words))
    h = np.array(hashed, dtype=np.uint64)
    n = len(h) - WORDS + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        out = _mixed(out + h[k : k + n])
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """The smallest of each of the hash functions, low 16 bits."""
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, dtype=np.uint32)
    x = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        part = x[at : at + 2048, None] * _MULTIPLY + _ADD
        part ^= part >> np.uint32(15)
        np.minimum(least, part.min(axis=0), out=least)
    return least.astype(">u2")


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("values", pa.binary())])


def _digest(found: np.ndarray) -> bytes | None:
    """What tells a set of shingles; None of an empty one."""
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            counts, digests, values = [], [], []
            for text in part.column("text").to_pylist():
                found = shingles(text)
                counts.append(len(found))
                digests.append(_digest(found))
                values.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(values, pa.binary())], schema=_SIGNED)


_WALK = "kind int, a long, b long, part int, head boolean, tree int, value binary, n long"
_WALK_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("head", pa.bool_()), ("tree", pa.int32()), ("value", pa.binary()), ("n", pa.int64())])
_PAIR, _EDGE, _RUN, _CROWD = range(4)


def _depth(a: bytes, b: bytes) -> int:
    """Values that two signature orders share from the start."""
    for k in range(0, len(a), 2):
        if a[k : k + 2] != b[k : k + 2]:
            return k // 2
    return len(a) // 2


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a walk along the sorted orders finds: pairs (a, b) of a document and one at most FOLLOWERS places before it that shares LEAST_DEPTH
    values; the first and last rows of each partition, for the pairs that its edges part; for documents that share RUN_DEPTH values with
    others, how many do; and the documents of regions whose pairs it doesn't all see, or that a partition's edge may part. The ids of a run and of a region
    are held until it ends, at most those of a partition."""
    from pyspark import TaskContext

    part, n, held, run, run_key = TaskContext.get().partitionId(), 0, [], array("q"), None
    crowd, crowd_key = array("q"), None
    out: dict[str, list] = {c: [] for c in _WALK_ARROW.names}

    def add(**row) -> None:
        for c, values in out.items():
            values.append(row.get(c))

    def taken() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict(out, schema=_WALK_ARROW)
        for values in out.values():
            values.clear()
        return batch

    def run_over() -> None:
        if len(run) >= LEAST_RUN:
            for doc in run:
                add(kind=_RUN, a=doc, n=len(run))
        del run[:]

    def crowd_over(edge: bool) -> None:
        if len(crowd) > FOLLOWERS + 1 or edge:
            for doc in crowd:
                add(kind=_CROWD, tree=crowd_key[0], value=crowd_key[1], a=doc)
        del crowd[:]

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("tree", "value", "doc")), strict=True):
            tree, value, doc = row
            if run_key != (tree, value[: 2 * RUN_DEPTH]):
                run_over()
                run_key = tree, value[: 2 * RUN_DEPTH]
            run.append(doc)
            if crowd_key != (tree, value[: 2 * LEAST_DEPTH]):
                crowd_over(edge=n == len(crowd))
                crowd_key = tree, value[: 2 * LEAST_DEPTH]
            crowd.append(doc)
            for back, other in enumerate(reversed(held)):
                if other[0] != tree or _depth(other[1], value) < LEAST_DEPTH or back >= NEAREST and len(crowd) > FOLLOWERS + 1:
                    break
                add(kind=_PAIR, a=doc, b=other[2])
            if n < FOLLOWERS:
                add(kind=_EDGE, part=part, head=True, tree=tree, value=value, a=doc)
            held = [*held[1 - FOLLOWERS :], row] if len(held) >= FOLLOWERS else [*held, row]
            n += 1
            if len(out["a"]) >= 4096:
                yield taken()
    run_over()
    crowd_over(edge=True)
    for tree, value, doc in held:
        add(kind=_EDGE, part=part + 1, head=False, tree=tree, value=value, a=doc)
    yield taken()


def _across(edges: DataFrame) -> DataFrame:
    """The pairs that the edges between partitions part: last rows of one, first rows of the next."""
    last, first = edges.filter("not head").alias("l"), edges.filter("head").alias("f")
    shared = F.substring(F.col("l.value"), 1, 2 * LEAST_DEPTH) == F.substring(F.col("f.value"), 1, 2 * LEAST_DEPTH)
    return last.join(first, (F.col("l.part") == F.col("f.part")) & (F.col("l.tree") == F.col("f.tree"))).filter(shared).select(F.col("f.a").alias("a"), F.col("l.a").alias("b"))


def met(rows: DataFrame, table: DataFrame, *key: str, how: str = "inner", n: int | None = None) -> DataFrame:
    """rows joined with table, which has each key once; how is inner or left. A key that more than HOT rows have is dealt to as many tasks as it needs, each with a copy of the table's
    row. Broadcast are such keys with their numbers of copies, one in HOT rows at most. rows are read twice, but for those of which n, their known number, tells that no key has so many."""
    keys = list(key)
    if n is not None and n <= HOT:
        return rows.join(table, keys, how)
    hot = F.broadcast(rows.groupBy(*keys).agg(F.ceil(F.count("*") / HOT).alias("met_copies")).filter("met_copies > 1"))
    copies = F.coalesce("met_copies", F.lit(1).cast("long"))
    dealt = rows.join(hot, keys, "left").withColumn("met_salt", F.pmod(F.xxhash64(*rows.columns), copies)).drop("met_copies")
    copied = table.join(hot, keys, "left").withColumn("met_salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("met_copies")
    return dealt.join(copied, [*keys, "met_salt"], how).drop("met_salt")


def _orders(sets: DataFrame) -> DataFrame:
    trees = F.array(*(F.struct(F.lit(t).alias("tree"), F.substring("values", 2 * DEPTH * t + 1, 2 * DEPTH).alias("value")) for t in range(TREES)))
    return sets.withColumn("x", F.explode(trees)).select("x.tree", "x.value", *(c for c in sets.columns if c != "values"))


def _hubs(sets: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """With two stored tables that they are read from: pairs (a, b) of a document and the most popular one, b, of its regions. Copies that each differ from their model in places of their own are
    closer to it than to each other, so they share more values with it, and more documents do. Only documents in runs are looked at."""
    popular = runs.groupBy("a").agg(F.sum("n").alias("popular")).withColumnRenamed("a", "doc")
    depths = F.array(*(F.struct(F.lit(d).alias("depth"), F.substring("value", 1, 2 * d).alias("prefix")) for d in HUB_DEPTHS))
    regions = _orders(sets.join(popular, "doc")).withColumn("y", F.explode(depths)).select("tree", "y.depth", "y.prefix", "doc", "popular")
    regions = stored(regions, "regions")
    region = ["tree", "depth", "prefix"]
    hubs = stored(regions.groupBy(*region).agg(F.max(F.struct("popular", (-F.col("doc")).alias("doc"))).alias("hub"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_RUN).select(*region, (-F.col("hub.doc")).alias("b")), "hubs")
    return met(regions, hubs, *region).filter("doc <> b").select(F.col("doc").alias("a"), "b"), regions, hubs


def candidates(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forest's candidates, and the regions (tree, value) with their documents, doc, of which it hasn't seen all pairs. Candidates are pairs (a, b), a < b, of the documents that stand for sets (doc, values), each once, with the share of equal signature values and the owner,
    the document that looked for the other; a document owns TREES * (FOLLOWERS + len(HUB_DEPTHS)) pairs at most."""
    ordered = _orders(sets).repartitionByRange("tree", "value", "doc").sortWithinPartitions("tree", "value", "doc")
    found = stored(ordered.mapInArrow(_walked, _WALK), "forest")
    popular, *read = _hubs(sets, found.filter(F.col("kind") == _RUN))
    pairs = found.filter(F.col("kind") == _PAIR).select("a", "b").unionByName(_across(found.filter(F.col("kind") == _EDGE))).unionByName(popular)
    owned = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("a").alias("owner"))
    once = stored(owned.groupBy("a", "b").agg(F.min("owner").alias("owner")), "pairs")
    one, two = sets.select(F.col("doc").alias("a"), F.col("values").alias("va")), sets.select(F.col("doc").alias("b"), F.col("values").alias("vb"))
    both = met(met(once, one, "a"), two, "b").select("a", "b", "owner", "va", "vb").mapInArrow(_shares, "a long, b long, owner long, share double")
    out = stored(both.filter(F.col("share") >= LEAST_SHARE), "candidates")
    crowds = stored(found.filter(F.col("kind") == _CROWD).select("tree", "value", F.col("a").alias("doc")), "crowds")
    for old in (found, once, *read):
        forget(old)
    return out, crowds


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            va, vb = (np.frombuffer(b"".join(batch.column(n).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for n in ("va", "vb"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("owner"), pa.array((va == vb).mean(axis=1))], names=["a", "b", "owner", "share"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of texts, of those that have the digest that is asked for."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            docs, hashes = [], []
            for doc, digest, text in zip(*(batch.column(c).slice(at, ROWS_AT_ONCE).to_pylist() for c in ("doc", "digest", "text")), strict=True):
                found = shingles(text)
                if _digest(found) == digest:
                    docs.append(doc)
                    hashes.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hashes, pa.binary())], names=["doc", "hashes"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for at in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(n)[at].as_py(), dtype=np.uint64) for n in ("sa", "sb"))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(LINK[0] * both >= LINK[1] * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def _among(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """The rows whose key (doc, if none is named) is in wanted, which holds each once, with wanted's other columns. A map of hashed keys, of FILTER_BITS bits at most, is broadcast and drops most others where they are read, so
    that their texts aren't shuffled; the join that follows drops the rest, and does all the work once the keys fill the map.
    It is an inner join, as a semi join would be moved below the map."""
    keys = list(key) or ["doc"]
    spot = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    place = [(spot / _MAP_BITS).cast("int").alias("page"), (spot % _MAP_BITS).alias("at")]
    maps = wanted.select(*place).repartition("page").groupBy("page").agg(F.bitmap_construct_agg("at").alias("map"))
    byte = F.conv(F.hex(F.expr("substring(map, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("long")
    bit = F.expr("cast(pow(2, at % 8) as long)")
    marked = rows.select("*", *place).join(F.broadcast(maps), "page").filter(byte.bitwiseAND(bit) != 0)
    return marked.select(*rows.columns).join(wanted, keys)


def confirmed(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The pairs whose full sets (doc, hashes) are links."""
    one, two = sets.select(F.col("doc").alias("a"), F.col("hashes").alias("sa")), sets.select(F.col("doc").alias("b"), F.col("hashes").alias("sb"))
    narrow = stored(pairs.select("a", "b"), "asked")
    n = narrow.count()
    out = stored(met(met(narrow, one, "a", n=n), two, "b", n=n).select("a", "b", "sa", "sb").mapInArrow(_confirmed, "a long, b long"), name)
    forget(narrow)
    return out


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node that its links reach, for each node of links (a, b)."""
    edges = stored(links.select("a", "b"), "edges")
    n = edges.count()
    of = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "roots")
    nodes = 2 * n  # at most
    while True:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(ways.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "least")
        to = lambda c: least.select(F.col("a").alias(c), F.col("to").alias(f"{c}_to"))
        now = stored(met(of, to("root"), "root", how="left", n=nodes).select("node", F.coalesce("root_to", "root").alias("root")), "roots")
        rest = stored(met(met(edges, to("a"), "a", n=n), to("b"), "b", n=n).filter("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        for old in (of, least, edges):
            forget(old)
        of, edges = now, rest
        n = edges.count()
        if not n:
            return of


def _crowded(crowds: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc and root of the documents in regions that hold more than one component, and a stored table that they are read from."""
    placed = stored(crowds.join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("tree", "value", "doc", F.coalesce("root", "doc").alias("root")), "placed")
    mixed = placed.groupBy("tree", "value").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("tree", "value")
    return met(placed, mixed, "tree", "value", n=placed.count()).select("doc", "root").distinct(), placed


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's counts of shingles by their place in the sketch."""
    counts = np.zeros(SKETCH, dtype=np.uint32)
    for batch in batches:
        for x in batch.column("hashes"):
            np.add.at(counts, np.frombuffer(x.as_py(), dtype=np.uint64) % np.uint64(SKETCH), 1)
    for page in range(SKETCH // _SKETCH_PAGE):
        part = counts[page * _SKETCH_PAGE : (page + 1) * _SKETCH_PAGE]
        if part.any():
            yield pa.RecordBatch.from_pydict({"page": pa.array([page], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summed counts of each page, on a scale of bytes: 0 for none, 1 for one, and from 9 on logarithms."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for page, counts in zip(batch.column("page").to_pylist(), batch.column("counts"), strict=True):
            sums[page] = sums.get(page, 0) + np.frombuffer(counts.as_py(), dtype=np.uint32).astype(np.int64)
    for page, n in sums.items():
        scaled = np.where(n > 0, np.minimum(1 + 8 * np.log2(np.maximum(n, 1)), 255), 0).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"page": pa.array([page], pa.int32()), "counts": pa.array([scaled.tobytes()], pa.binary())})


def _posted(batches: Iterator[pa.RecordBatch], sketch) -> Iterator[pa.RecordBatch]:
    """The first shingles of each set, rare ones first, that a link with a set of the same size or less must share one of. Those that no other set has are left out."""
    frequency = np.frombuffer(sketch.value, dtype=np.uint8)
    for batch in batches:
        for doc, root, hashes in zip(batch.column("doc").to_pylist(), batch.column("root").to_pylist(), batch.column("hashes"), strict=True):
            found = np.frombuffer(hashes.as_py(), dtype=np.uint64)
            n, f = len(found), frequency[found % np.uint64(SKETCH)]
            first = np.lexsort((found, f))[: n + 1 + -LINK[1] * n // LINK[0]]
            at = np.flatnonzero(f[first] > 1)
            if len(at):
                same = lambda x: pa.array(np.full(len(at), x, dtype=np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(found[first[at]].view(np.int64)), same(doc), same(root), same(n), pa.array(at.astype(np.int64))], names=["token", "doc", "root", "n", "at"])


def _met(posts: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of sets in different components that share one of their first shingles, and of which sizes and places don't tell that they share too
    little for a link. The smaller set's part is shorter: a link shares 2 * LINK[1] / (LINK[0] + LINK[1]) of it at least."""
    least, most = 2 * LINK[1], LINK[0] + LINK[1]
    shared = posts.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / POSTS).alias("salts")).filter("low <> high").select("token", "salts")
    kept = posts.join(shared, "token")
    small = kept.filter(f"at <= n + floor(-{least} * n / {most})").select("token", F.pmod(F.xxhash64("doc"), "salts").alias("salt"), *(F.col(c).alias(f"{c}_a") for c in ("doc", "root", "n", "at")))
    large = kept.select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), *(F.col(c).alias(f"{c}_b") for c in ("doc", "root", "n", "at")))
    bound = f"{most} * least(n_a - at_a, n_b - at_b) >= {LINK[1]} * (n_a + n_b)"
    both = small.join(large, ["token", "salt"]).filter(f"root_a <> root_b and n_a <= n_b and {bound}")
    return both.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct()


def unseen_links(crowds: DataFrame, roots: DataFrame, full: DataFrame) -> DataFrame | None:
    """All links between components among the documents of crowded regions, or None if no region has two components."""
    spark = full.sparkSession
    found, placed = _crowded(crowds, roots)
    docs = stored(found, "crowded")
    forget(placed)
    if docs.isEmpty():
        forget(docs)
        return None
    sets = stored(full.join(docs, "doc").select("doc", "root", "hashes"), "crowded-sets")
    counts = bytearray(SKETCH)
    for row in sets.select("hashes").mapInArrow(_counted, "page int, counts binary").repartition("page").mapInArrow(_summed, "page int, counts binary").toLocalIterator():
        counts[row["page"] * _SKETCH_PAGE : (row["page"] + 1) * _SKETCH_PAGE] = row["counts"]
    sketch = spark.sparkContext.broadcast(bytes(counts))
    posts = stored(sets.mapInArrow(lambda batches: _posted(batches, sketch), "token long, doc long, root long, n long, at long"), "posts")
    met = stored(_met(posts), "met")
    found = confirmed(met, sets.select("doc", "hashes"), "links")
    for old in (docs, sets, posts, met):
        forget(old)
    sketch.unpersist()
    return found


def _likeliest(pairs: DataFrame, n: int) -> DataFrame:
    """The n pairs of the largest share of those that each document owns."""
    best = Window.partitionBy("owner").orderBy(F.desc("share"), "a", "b")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).select("a", "b")


def _shared_ids(signed: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links (a, b) between the sets of rows that share a doc_id; None if no rows of different sets do."""
    several = stored(signed.filter("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("doc_id", "low"), "several")
    if several.isEmpty():
        forget(several)
        return None
    # doc_ids of several sets, with the digests of all their rows.
    rows = stored(met(signed.filter("digest is not null").select("doc_id", "digest"), several, "doc_id").filter("digest <> low").select("digest", "low").distinct(), "shared")
    node = lambda digest, name: sets.select(F.col("digest").alias(digest), F.col("doc").alias(name))
    links = stored(met(met(rows, node("digest", "a"), "digest"), node("low", "b"), "low").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "shared-links")
    forget(several)
    forget(rows)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    narrow = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), null_as_empty(F.col("text")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = stored(narrow.mapInArrow(_signed, "doc_id long, text_hash long, n_shingles long, digest binary, values binary"), "signed")
    # A set has a number of its own, doc, up to the end: rows of one doc_id may have several sets.
    least = F.min(F.struct("doc_id", "text_hash")).alias("least")
    sets = signed.filter("digest is not null and doc_id is not null").groupBy("digest").agg(least, F.first("values").alias("values"), F.count("*").alias("copies"))
    sets = stored(sets.select("digest", "least.doc_id", "least.text_hash", "values", "copies").withColumn("doc", F.monotonically_increasing_id()), "sets")
    pairs, crowds = candidates(sets.select("doc", "values"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).unionByName(crowds.select("doc")).distinct()
    texts = _among(narrow, wanted.join(sets.select("doc", "doc_id", "text_hash", "digest"), "doc"), "doc_id", "text_hash")
    full = stored(texts.mapInArrow(_sets, "doc long, hashes binary").groupBy("doc").agg(F.min("hashes").alias("hashes")), "full")
    first = confirmed(_likeliest(pairs, 2), full, "links")
    roots = components(first)
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    n = pairs.count()
    open_pairs = met(met(pairs, root("a"), "a", how="left", n=n), root("b"), "b", how="left", n=n).filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
    more = confirmed(open_pairs, full, "links")
    merged = lambda found: found.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    links = merged(roots).unionByName(more)
    if (shared := _shared_ids(signed, sets)) is not None:
        links = links.unionByName(shared)
    final = components(links)
    if (unseen := unseen_links(crowds, final, full)) is not None:
        seen, final = final, components(merged(final).unionByName(unseen))
        for old in (seen, unseen):
            forget(old)
    for old in (pairs, crowds, full, more, roots, *([] if shared is None else [shared])):
        forget(old)
    placed = stored(sets.join(final.withColumnRenamed("node", "doc"), "doc", "left").select("digest", F.coalesce("root", "doc").alias("root"), "doc_id", "copies"), "placed")
    # A class is named by its smallest doc_id.
    names = placed.groupBy("root").agg(F.min("doc_id").alias("name"))
    classes = met(placed, names, "root", n=placed.count()).filter("copies > 1 or name <> doc_id").select("digest", "name", "copies")
    classes = stored(classes, "classes")
    forget(placed)
    # Digests of very many copies are told from a broadcast table, one in HOT rows at most; rows without a digest meet nothing, each under a key of its own.
    many = classes.filter(F.col("copies") > HOT).select("digest", F.col("name").alias("many"))
    told = signed.select("doc_id", "n_shingles", "digest").join(F.broadcast(many), "digest", "left")
    alone = F.col("digest").isNull() | F.col("many").isNotNull()
    told = told.withColumn("key", F.when(alone, F.monotonically_increasing_id().cast("string").cast("binary")).otherwise(F.col("digest")))
    few = classes.filter(F.col("copies") <= HOT).select(F.col("digest").alias("key"), "name")
    joined = told.join(few, "key", "left").withColumn("name", F.coalesce("many", "name"))
    component: Column = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("name", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their class."""
    return near_duplicates(table(spark, sf_dir, "documents"))
