"""A Merkle manifest of a table: trees of sha256 digests by source, proofs for each row, and what changed between two manifests.

A row's leaf is a digest of its values. The leaves of a source, in order, are a tree of base FANOUT without padding: every FANOUT consecutive nodes become their digest, also a
last run of fewer, even of one, until one node, the subroot, remains. The subroots, in the order of the sources, are a tree of the same kind, whose last node is the root.

Leaves are sorted by ranges of source and order, and each knows its place, from the number of rows of its source that a partition before it ends with; one row a
partition goes through the driver. A partition of placed leaves then goes through a stack of mountain ranges: a level holds the nodes of an unfinished run, and a
full run carries its digest to the next level. A run that the partition's edges cut stays behind as peaks; those of all partitions, a few dozen each, are merged level by level
with sums by run. So a source of any size, a third of all rows too, takes as many tasks as it has partitions, and a run is never more than FANOUT nodes.

Proofs go down from the root: at each level a run meets the proof of its parent by one join on tree and run, so no key is hot.

Defined cases: nulls are values of their own; a null source is the first tree; among equal order values (null first) leaves ascend, so rows that repeat each other have
leaves side by side and proofs of their own; a source of one row has its leaf as subroot, and a table of one source its subroot as root; an empty table has no
nodes, no root and no proofs; texts of any length are hashed whole; extra columns are ignored, also such as bear a result's name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, picked, stored, table

FANOUT = 16
#: The columns that a document's leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*values: Column) -> Column:
    """sha256 of the values, each as `-` if null, else as its length in bytes, a colon and itself."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, values)), 256)


def lowered(text: Column) -> Column:
    """text with A-Z in lower case and all else as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


_PLACED = [("tree", pa.string()), ("part", pa.int32()), ("at", pa.int64()), ("last", pa.bool_())]


def _placed(batches: Iterator[pa.RecordBatch], payload: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the number of rows of their tree before them in this partition, at, and whether they are its last here. The last row of a batch is held back until the next one tells."""
    part, at, held, schema = TaskContext.get().partitionId(), 0, None, pa.schema([*_PLACED, *payload])

    def out(rows: pa.RecordBatch, following: str | None, end: bool) -> pa.RecordBatch:
        nonlocal at
        trees, places, last = rows.column("tree").to_pylist(), [], []
        for tree, after in zip(trees, [*trees[1:], following], strict=True):
            over = end and len(places) + 1 == len(trees) or after != tree
            places.append(at)
            last.append(over)
            at = 0 if over else at + 1
        same = [rows.column(n) for n in payload.names]
        return pa.RecordBatch.from_arrays([rows.column("tree"), pa.array([part] * len(trees), pa.int32()), pa.array(places, pa.int64()), pa.array(last), *same], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield out(held, batch.column("tree")[0].as_py(), False)
        if batch.num_rows > 1:
            yield out(batch.slice(0, batch.num_rows - 1), batch.column("tree")[batch.num_rows - 1].as_py(), False)
        held = batch.slice(batch.num_rows - 1)
    if held is not None:
        yield out(held, None, True)


def indexed(rows: DataFrame, *order: str) -> DataFrame:
    """rows (tree, never null, and others), stored, with idx, their place in their tree by order, and end, whether they are its last."""
    payload = [c for c in rows.columns if c != "tree"]
    empty = rows.sparkSession.createDataFrame([], rows.schema).select(*payload).toArrow().schema
    ordered = rows.select("tree", *payload).repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*payload).schema)
    placed = stored(ordered.mapInArrow(lambda batches: _placed(batches, empty), f"tree string, part int, at long, last boolean, {names}"), "placed")
    ends = placed.filter("last").groupBy("part").agg(F.min(F.struct("tree", "at")).alias("first"), F.max(F.struct("tree", "at")).alias("final")).orderBy("part").collect()
    starts, tree, n = [], None, 0
    for k, row in enumerate(ends):  # a row a partition
        (first, a), (final, b) = row["first"], row["final"]
        start = n if first == tree else 0
        tree, n = final, (start if final == first else 0) + b + 1
        starts.append((row["part"], first, start, final, k + 1 < len(ends) and ends[k + 1]["first"]["tree"] == final))
    edges = rows.sparkSession.createDataFrame(starts, "part int, first string, start long, final string, open boolean")
    place = F.col("at") + F.when(F.col("tree") == F.col("first"), F.col("start")).otherwise(0)
    out = placed.join(F.broadcast(edges), "part").select("tree", place.alias("idx"), (F.col("last") & ~(F.col("open") & (F.col("tree") == F.col("final")))).alias("end"), *payload)
    out.chronolex_path = placed.chronolex_path
    return out


_NODES = "tree string, level int, idx long, digest string, `end` boolean, peak boolean"
_NODES_ARROW = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("end", pa.bool_()), ("peak", pa.bool_())])


class MountainRange:
    """The stack of one tree's consecutive nodes: emit(level, idx, digest, end, peak) is called for the nodes above the leaves and, with peak, for those of runs that an edge cuts."""

    def __init__(self, emit) -> None:
        self.emit, self.levels, self.next = emit, [], None

    def push(self, idx: int, value: str, end: bool, level: int = 0) -> None:
        while True:
            if level == len(self.levels):
                self.levels.append([])
            run = self.levels[level]
            run.append((idx, value, end))
            if not end and (idx + 1) % FANOUT:
                return
            whole = run[0][0] % FANOUT == 0
            if whole and (not end or idx):  # more than one node on this level, so they carry
                self.levels[level] = []
                value = hashlib.sha256("".join(v for _, v, _ in run).encode()).hexdigest()
                idx, level = idx // FANOUT, level + 1
                self.emit(level, idx, value, end, False)
            elif whole:  # the last node of the tree
                self.levels[level] = []
                return
            else:
                self.peaks(level)
                return

    def peaks(self, level: int) -> None:
        for idx, value, end in self.levels[level]:
            self.emit(level, idx, value, end, True)
        self.levels[level] = []

    def over(self) -> None:
        for level in range(len(self.levels)):
            self.peaks(level)


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes above sorted leaves (tree, idx, digest, end), and peaks. Rows that don't follow each other start a new stack, however files are read."""
    out: dict[str, list] = {c: [] for c in _NODES_ARROW.names}
    tree = stack = None

    def emit(level: int, idx: int, value: str, end: bool, peak: bool) -> None:
        for c, v in zip(out.values(), (tree, level, idx, value, end, peak), strict=True):
            c.append(v)

    def taken() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict(out, schema=_NODES_ARROW)
        for values in out.values():
            values.clear()
        return batch

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("tree", "idx", "digest", "end")), strict=True):
            if stack is None or row[0] != tree or row[1] != stack.next:
                if stack is not None:
                    stack.over()
                tree, stack = row[0], MountainRange(emit)
            stack.next = row[1] + 1
            stack.push(*row[1:])
        yield taken()
    if stack is not None:
        stack.over()
    yield taken()


def _run_digest(nodes: DataFrame) -> DataFrame:
    """tree, run and end of the runs of nodes (tree, idx, digest, end) of one level, and what they become."""
    runs = nodes.groupBy("tree", F.expr(f"idx div {FANOUT}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("nodes"), F.max("end").alias("end"))
    return runs.select("tree", F.col("run").alias("idx"), F.sha2(F.array_join(F.col("nodes.digest"), ""), 256).alias("digest"), "end")


def grown(leaves: DataFrame) -> DataFrame:
    """tree, level (1 and more), idx, digest and end of all nodes above indexed leaves (tree, idx, digest, end), stored."""
    stacked = stored(leaves.select("tree", "idx", "digest", "end").mapInArrow(_stacked, _NODES), "nodes")
    nodes, made = stacked.filter("not peak").drop("peak"), [stacked]
    peaks = stacked.filter("peak").drop("peak")
    highest = peaks.agg(F.max("level")).first()[0]
    level, loose = 0, peaks.filter("level = 0").drop("level")
    while highest is not None:
        # A node without a neighbour on its level is its tree's last.
        merged = stored(_run_digest(loose.filter("not (`end` and idx = 0)")), "merged")
        level += 1
        made.append(merged)
        nodes = nodes.unionByName(merged.withColumn("level", F.lit(level)))
        loose = merged.unionByName(peaks.filter(F.col("level") == level).drop("level"))
        if level >= highest and loose.filter("not (`end` and idx = 0)").isEmpty():
            break
    out = stored(nodes.select("tree", "level", "idx", "digest", "end"), "tree")
    for old in made:
        forget(old)
    return out


@dataclass
class Manifest:
    """leaves: tree, idx, digest, end and further columns; nodes: those above them; subroots: tree, idx (the tree's place), digest, end; top: the nodes above those. The trees' names sort like their sources."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    top: DataFrame

    def root(self) -> str | None:
        """The digest of all; None of nothing."""
        last = lambda rows: rows.filter("`end` and idx = 0").select("digest")
        found = last(self.top).unionByName(last(self.subroots)).take(2)
        return found[0]["digest"] if found else None

    def write(self, to: str) -> None:
        for name in ("leaves", "nodes", "subroots", "top"):
            getattr(self, name).write.parquet(f"{to}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Manifest:
        return Manifest(*(spark.read.parquet(f"{path}/{name}") for name in ("leaves", "nodes", "subroots", "top")))


def tree_name(source: Column) -> Column:
    """A name without null that sorts like the source, null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def manifest(leaves: DataFrame, *order: str) -> Manifest:
    """The manifest of leaves (tree, digest and others): within a tree they are in this order, then by digest."""
    once = stored(leaves, "leaves")  # a sort by ranges reads its rows twice
    placed = indexed(once, *order, "digest")
    forget(once)
    nodes = grown(placed)
    last = lambda rows: rows.filter("`end` and idx = 0").select("tree", "digest")
    subroots = last(nodes).unionByName(last(placed)).select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    over = indexed(subroots, "source")
    return Manifest(placed, nodes, over, grown(over))


def _children(level: DataFrame) -> DataFrame:
    """The nodes (tree, idx, digest and others) of a level with the siblings of their run before and after them, joined, by tree and run."""
    others = [c for c in level.columns if c not in ("tree", "idx")]
    runs = level.groupBy("tree", F.expr(f"idx div {FANOUT}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", *others))).alias("nodes"))
    texts = F.col("nodes.digest")
    one = runs.select("tree", "run", texts.alias("digests"), F.posexplode("nodes").alias("k", "node"))
    side = lambda start, n: F.array_join(F.slice("digests", start, n), "")
    step = F.struct(side(F.lit(1), F.col("k")).alias("before"), side(F.col("k") + 2, F.greatest(F.size("digests") - F.col("k") - 1, F.lit(0))).alias("after"))
    return one.select("tree", "run", F.col("node.idx").alias("idx"), *(F.col(f"node.{c}").alias(c) for c in others), step.alias("step"))


def _proved(leaves: DataFrame, nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """The leaves with steps, the siblings before and after them level by level upwards, and what above (tree, steps and others) tells of their tree: its own steps follow."""
    told = [c for c in above.columns if c not in ("tree", "steps")]
    proved = None
    for level in range(levels, -1, -1):
        here = leaves if level == 0 else nodes.filter(F.col("level") == level).select("tree", "idx", "digest", "end")
        others = [c for c in here.columns if c not in ("tree", "idx")]
        lone = here.filter("`end` and idx = 0").join(above, "tree").select("tree", "idx", *others, "steps", *told)
        if proved is not None:
            parents = proved.select("tree", F.col("idx").alias("run"), F.col("steps").alias("upper"), *told)
            met = _children(here.filter("not (`end` and idx = 0)")).join(parents, ["tree", "run"])
            lone = lone.unionByName(met.select("tree", "idx", *others, F.concat(F.array("step"), "upper").alias("steps"), *told))
        proved = lone
    return proved


def proofs(found: Manifest) -> DataFrame:
    """The leaves' columns with steps, subroot and root."""
    height = lambda nodes: nodes.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
    start = found.subroots.select("tree").distinct().select("tree", F.lit(found.root()).cast("string").alias("root"), F.array().cast("array<struct<before: string, after: string>>").alias("steps"))
    sources = _proved(found.subroots, found.top, start, height(found.top)).select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "root", "steps")
    return _proved(found.leaves, found.nodes, sources, height(found.nodes))


def proof_digest(steps: Column) -> Column:
    """sha256 of all siblings, level by level upwards, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(steps, leaf, lambda value, s: F.sha2(F.concat(s["before"], value, s["after"]), 256))


def changed(old: Manifest, new: Manifest) -> DataFrame:
    """Which sources differ, as tree and change: added, gone or changed. Only subroots are read."""
    a, b = (m.subroots.select(F.col("source").alias("tree"), F.col("digest").alias(c)) for m, c in ((old, "a"), (new, "b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "gone").otherwise("changed")
    return a.join(b, "tree", "full").filter("not (a <=> b)").select("tree", change.alias("change"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, digest and tampered of documents: the last is the leaf after A-Z of the text are lowered, for those that the check tampers with, else null."""
    rows = picked(docs, *FIELDS)
    fields = [F.col(c) for c in FIELDS]
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    tampered = F.when(chosen, digest(*fields[:-1], lowered(F.col("text"))))
    return rows.select(tree_name(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), digest(*fields).alias("digest"), tampered.alias("tampered"))


def op11_mountain_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their leaf, subroot, root and proof, and whether the proof holds for the row as it may have been tampered with."""
    found = manifest(document_leaves(table(spark, sf_dir, "documents")), "doc_id")
    proved = proofs(found).withColumn("folded_root", folded(F.coalesce("tampered", "digest"), F.col("steps")))
    checked = proved.withColumn("verified", F.col("folded_root") == F.col("root"))
    return checked.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", "verified")
