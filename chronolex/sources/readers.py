"""Readers: each gives docs (doc_id, label, date, meta) and tokens (doc_id, sent_id, seg_id, pos, date, w, p, l, and page for tab files).

A document is a file, whose path is its doc_id; Spark lists paths and globs. Where documents are small and many, listing and opening files takes longer than reading them: cells reads
Parquet tables of doc_id and value instead, a document a row, and lines reads JSON documents of a line each. Sentences and breaks become numbers that grow in a document."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

_ATTRIBUTES = ("w", "p", "l")
#: Rows that a parser hands on at once, the last document's on top.
_ROWS = 1 << 14


@dataclass
class Corpus:
    docs: DataFrame
    tokens: DataFrame

    def union(self, other: Corpus) -> Corpus:
        return Corpus(self.docs.unionByName(other.docs, allowMissingColumns=True), self.tokens.unionByName(other.tokens, allowMissingColumns=True))

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """A compiled corpus: filters and parsing are done once."""
        self.docs.write.mode(mode).parquet(f"{path}/docs")
        self.tokens.write.mode(mode).partitionBy("date").parquet(f"{path}/tokens")


def _files(spark: SparkSession, path: str | list[str], cells: bool = False) -> DataFrame:
    if cells:
        return spark.read.parquet(*([path] if isinstance(path, str) else path)).select(F.col("doc_id").cast("string").alias("doc_id"), "value")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value"))


def _numbered(rows: DataFrame, sentence_end: Column, segment_break: Column) -> DataFrame:
    """Rows of marks and tokens in order pos, numbered by the ends and breaks before them, without the marks."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumns({"__end": F.coalesce(sentence_end, F.lit(False)), "__break": F.coalesce(segment_break, F.lit(False))})
    counted = marked.withColumns({"sent_id": F.sum(F.col("__end").cast("int")).over(before), "seg_id": F.sum(F.col("__break").cast("int")).over(before)})
    return counted.filter("not __end and not __break").drop("__end", "__break")


def read_tabs(spark: SparkSession, path: str | list[str], break_class: str | None = None, *, cells: bool = False) -> Corpus:
    """Tab-separated files: a token a line (word, part of speech, lemma, and the page if it is new), an empty line after a sentence, and lines that begin
    with ``%%`` for metadata (``meta.NAME=VALUE``, ``date=YEAR``), columns (``index[N]=NAME SHORT``), breaks (``BREAK.CLASS``) and pages (``PAGE=N``)."""
    lines = _files(spark, path, cells).select("doc_id", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    line = F.col("line")
    parsed = lines.withColumns(
        {
            "name": F.regexp_extract(line, r"^%%(?:\$\w+:)?(?:meta\.)([\w.]+?)_?=", 1),
            "value": F.trim(F.regexp_extract(line, r"^%%[^=]*=(.*)$", 1)),
            "index": F.regexp_extract(line, r"^%%\$\w+:index\[(\d+)\]=\S+\s+(\w+)", 1),
            "short": F.regexp_extract(line, r"^%%\$\w+:index\[(\d+)\]=\S+\s+(\w+)", 2),
            "broken": F.regexp_extract(line, r"^%%\$\w+:BREAK\.(\w+)", 1),
            "page_mark": F.regexp_extract(line, r"^%%\$\w+:PAGE=(.*)$", 1),
        }
    )
    named = F.when(line.rlike(r"^%%\s*date="), F.lit("date")).otherwise(F.col("name"))
    pairs = F.filter(F.collect_list(F.when(named != "", F.struct(named.alias("k"), F.col("value").alias("v")))), lambda x: x.isNotNull())
    columns = F.filter(F.collect_list(F.when(F.col("short") != "", F.struct(F.col("short").alias("k"), F.col("index").cast("int").alias("v")))), lambda x: x.isNotNull())
    last = lambda a: F.map_from_entries(F.filter(a, lambda x, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda y: y["k"] == x["k"])))  # noqa: E731  a name's last value counts
    heads = parsed.filter(line.startswith("%%")).groupBy("doc_id").agg(pairs.alias("pairs"), columns.alias("columns"))
    files = parsed.select("doc_id").distinct().join(heads, "doc_id", "left")
    none = F.create_map().cast("map<string,string>")
    docs = files.select("doc_id", F.coalesce(last(F.col("pairs")), none).alias("meta"), F.coalesce(last(F.col("columns")), F.create_map().cast("map<string,int>")).alias("columns"))
    docs = docs.withColumn("date", F.coalesce(text.leading_year(F.col("meta")["date"]), F.lit(0)))
    split = F.split(line, "\t")
    fields = {a: F.coalesce(F.get(split, F.coalesce(F.try_element_at("columns", F.lit(a)), F.lit(k))), F.lit("")) for k, a in enumerate(_ATTRIBUTES)}
    in_file = parsed.filter(~line.startswith("%%") | (F.col("broken") != "") | (F.col("page_mark") != "")).join(docs.select("doc_id", "date", "columns"), "doc_id")
    forward = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    page = F.last(F.when(F.col("page_mark") != "", F.col("page_mark")).otherwise(F.nullif(F.get(split, F.lit(3)), F.lit(""))), ignorenulls=True).over(forward)
    paged = in_file.withColumn("page", page).filter(F.col("page_mark") == "")
    breaks = F.col("broken") != "" if break_class is None else F.col("broken") == break_class.lstrip("#")
    tokens = _numbered(paged, F.trim(line) == "", breaks).filter("broken = ''")
    meta = F.transform_values("meta", lambda k, v: F.when(k == "author", text.author(v)).otherwise(v))
    docs = docs.select("doc_id", F.coalesce(F.col("meta")["basename"], F.regexp_extract("doc_id", r"([^/]+)$", 1)).alias("label"), "date", meta.alias("meta"), text.genre(F.col("meta")["textClass"]).alias("genre"))
    return Corpus(docs, tokens.select("doc_id", "sent_id", "seg_id", "pos", "date", *(v.alias(a) for a, v in fields.items()), "page"))


def read_json(spark: SparkSession, path: str | list[str], break_class: str | None = None, *, lines: bool = False) -> Corpus:
    """Documents as JSON: label, date, meta, and tokens, where null ends a sentence and a string with a number sign is a break. lines: a document is a line, and each in a file has a label of its own."""
    schema = "label string, date int, meta map<string,string>, tokens array<string>"
    read = spark.read.schema(schema).option("multiLine", not lines).json(path).withColumn("doc_id", F.concat_ws("#", F.col("_metadata.file_path"), "label"))
    docs = read.select("doc_id", "label", F.coalesce("date", F.lit(0)).alias("date"), "meta")
    each = read.select("doc_id", F.coalesce("date", F.lit(0)).alias("date"), F.posexplode("tokens").alias("pos", "t"))
    token = F.from_json("t", "w string, p string, l string")
    broken = F.col("t").startswith("#") if break_class is None else F.col("t") == f"#{break_class.lstrip('#')}"
    rows = _numbered(each, F.col("t").isNull(), broken).filter(~F.col("t").startswith("#")).withColumn("x", token)
    return Corpus(docs, rows.select("doc_id", "sent_id", "seg_id", "pos", "date", *(F.coalesce(F.col(f"x.{a}"), F.lit("")).alias(a) for a in _ATTRIBUTES)))


def _xpath(path: str) -> Column:
    return F.xpath("value", F.lit(path))


def _named(*names: str) -> str:
    return "".join(f"//*[local-name()='{n}']" for n in names)


def read_tcf(spark: SparkSession, path: str | list[str], *, cells: bool = False) -> Corpus:
    """Layered XML: tokens by ID, and sentences, tags and lemmas that name IDs. Layers are joined by document and ID."""
    files = _files(spark, path, cells)
    ids = lambda a: F.split(F.trim(a), r"\s+")
    tokens = files.select("doc_id", F.posexplode(F.arrays_zip(_xpath(f"{_named('token')}/@ID").alias("id"), _xpath(f"{_named('token')}/text()").alias("w"))).alias("pos", "x")).select("doc_id", "pos", "x.id", "x.w")
    sentences = files.select("doc_id", F.posexplode(_xpath(f"{_named('sentence')}/@tokenIDs")).alias("sent_id", "ids")).select("doc_id", "sent_id", F.explode(ids(F.col("ids"))).alias("id"))

    def layer(element: str, name: str) -> DataFrame:
        zipped = F.arrays_zip(_xpath(f"{_named(element)}/@tokenIDs").alias("ids"), _xpath(f"{_named(element)}/text()").alias("v"))
        return files.select("doc_id", F.explode(zipped).alias("x")).select("doc_id", F.explode(ids(F.col("x.ids"))).alias("id"), F.col("x.v").alias(name))

    source = lambda k: F.get(_xpath(f"{_named('source')}[@type='meta:{k}']/text()"), F.lit(0))
    keys = F.transform(_xpath(f"{_named('source')}[starts-with(@type,'meta:')]/@type"), lambda t: F.substring(t, 6, F.length(t)))
    values = _xpath(f"{_named('source')}[starts-with(@type,'meta:')]/text()")
    docs = files.select("doc_id", F.regexp_extract("doc_id", r"([^/]+)$", 1).alias("label"), F.coalesce(text.leading_year(source("date")), F.lit(0)).alias("date"), F.map_from_entries(F.arrays_zip(keys, values)).alias("meta"))
    joined = tokens.join(sentences, ["doc_id", "id"], "left").join(layer("tag", "p"), ["doc_id", "id"], "left").join(layer("lemma", "l"), ["doc_id", "id"], "left").join(docs.select("doc_id", "date"), "doc_id")
    return Corpus(docs, joined.select("doc_id", F.coalesce("sent_id", F.lit(0)).alias("sent_id"), F.lit(0).alias("seg_id"), "pos", "date", "w", F.coalesce("p", F.lit("")).alias("p"), F.coalesce("l", F.lit("")).alias("l")))


def read_tei(spark: SparkSession, path: str | list[str], *, word: str = "w", lemma: str = "lemma", tag: str = "type", sentence: str = "s", breaks: tuple[str, ...] = ("p", "div", "pb"), date: str = "date", cells: bool = False) -> Corpus:
    """Marked-up text: words in reading order with their attributes; elements named in breaks begin a segment, the sentence element a sentence."""

    def local(name: str) -> str:
        return name.rsplit("}", 1)[-1]

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        columns, found = ["doc_id", "sent_id", "seg_id", "pos", "w", "p", "l"], []
        for frame in frames:
            for doc, xml in zip(frame["doc_id"], frame["value"], strict=True):
                rows, sent, seg = [], 0, 0
                root = ElementTree.fromstring(xml)
                for body in (e for e in root.iter() if local(e.tag) == "text"):
                    for e in body.iter():
                        name = local(e.tag)
                        sent, seg = sent + (name == sentence), seg + (name in breaks)
                        if name == word:
                            rows.append((doc, sent, seg, len(rows), "".join(e.itertext()).strip(), e.get(tag, ""), e.get(lemma, "")))
                found += rows
                if len(found) >= _ROWS:
                    yield pd.DataFrame(found, columns=columns)
                    found = []
        yield pd.DataFrame(found, columns=columns)

    files = _files(spark, path, cells)
    head = lambda name: F.get(_xpath(f"{_named('teiHeader', name)}/text()"), F.lit(0))
    meta = F.create_map(F.lit("title"), head("title"), F.lit("author"), text.author(text.squeezed(head("author"))))
    docs = files.select("doc_id", F.regexp_extract("doc_id", r"([^/]+)$", 1).alias("label"), F.coalesce(text.leading_year(head(date)), F.lit(0)).alias("date"), meta.alias("meta"))
    tokens = files.mapInPandas(words, "doc_id string, sent_id int, seg_id int, pos int, w string, p string, l string").join(docs.select("doc_id", "date"), "doc_id")
    return Corpus(docs, tokens.select("doc_id", "sent_id", "seg_id", "pos", "date", "w", "p", "l"))


def read_xml(
    spark: SparkSession, path: str | list[str], *, word: str = "//text//w", fields: Mapping[str, str] | None = None, sentence: Sequence[str] = ("//s",), breaks: Sequence[str] = ("//p", "//div", "//pb"),
    meta: Mapping[str, str] | None = None, namespaces: Mapping[str, str] | None = None,
    cells: bool = False,
) -> Corpus:
    """XML by paths of one's own, as ElementTree reads them, with prefixes for namespaces. word, sentence and breaks are paths of nodes in the whole document: a word is told
    where it ends, and a node of sentence or breaks counts from where it starts, also inside a word, for which it counts with the next one. fields are paths from a word's node: ``.`` for its text, ``@name`` for an
    attribute, ``path/@name`` and ``path`` for those of a node inside. meta are paths in the document, also with ``/@name`` at their end; the year of ``date`` dates it. A path that finds nothing gives an empty string. A file is
    parsed whole, by one task, and must fit into a cell (2 GB)."""
    fields = {"w": ".", "p": "@type", "l": "@lemma", **(fields or {})}
    meta = {"title": ".//teiHeader//title", "author": ".//teiHeader//author", "date": ".//teiHeader//date", **(meta or {})}
    spaces, sentence, breaks = dict(namespaces or {}), list(sentence), list(breaks)
    names = [*fields]

    def place(path: str) -> tuple[str, str]:
        """The path of a node and its attribute's name, empty for the text."""
        where, _, attribute = path.partition("@")
        where = where.rstrip("/") or "."
        return f".{where}" if where.startswith("/") else where, "{%s}%s" % (spaces[attribute.split(":")[0]], attribute.split(":")[1]) if ":" in attribute else attribute

    def told(node, where: str, attribute: str) -> str:
        found = node if where == "." else node.find(where, spaces)
        if found is None:
            return ""
        return " ".join((found.get(attribute, "") if attribute else "".join(found.itertext())).split())

    of_word, of_file = [place(p) for p in fields.values()], {k: place(p) for k, p in meta.items()}

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        columns, found = ["doc_id", "key", "value", "sent_id", "seg_id", "pos", *names], []
        for frame in frames:
            for doc, xml in zip(frame["doc_id"], frame["value"], strict=True):
                root = ElementTree.Element("document")
                root.append(ElementTree.fromstring(xml))
                chosen = lambda paths: {id(e) for p in paths for e in root.findall(f".{p}" if p.startswith("/") else p, spaces)}  # noqa: B023, E731
                words, ends, parts = chosen([word]), chosen(sentence), chosen(breaks)
                dated, rows, sent, seg = told(root, *of_file["date"]), [], 0, 0
                stack = [(root, iter(root), 0, 0)]
                while stack:
                    node, children, at, part = stack[-1]
                    child = next(children, None)
                    if child is not None:
                        sent, seg = sent + (id(child) in ends), seg + (id(child) in parts)
                        stack.append((child, iter(child), sent, seg))
                        continue
                    stack.pop()
                    if id(node) in words:  # numbered by what had begun when it did
                        rows.append((doc, "", dated, at, part, len(rows), *(told(node, *p) for p in of_word)))
                heads = [(doc, k, told(root, *p), -1, -1, -1, *([""] * len(names))) for k, p in of_file.items()]
                found += [*heads, *rows]
                if len(found) >= _ROWS:
                    yield pd.DataFrame(found, columns=columns)
                    found = []
        yield pd.DataFrame(found, columns=columns)

    files = _files(spark, path, cells)
    schema = ", ".join(["doc_id string", "key string", "value string", "sent_id int", "seg_id int", "pos int", *(f"`{n}` string" for n in names)])
    rows = files.mapInPandas(parsed, schema)
    pairs = rows.filter("pos < 0").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("meta"))
    docs = pairs.select("doc_id", F.regexp_extract("doc_id", r"([^/]+)$", 1).alias("label"), F.coalesce(text.leading_year(F.col("meta")["date"]), F.lit(0)).alias("date"), F.transform_values("meta", lambda k, v: F.when(k == "author", text.author(v)).otherwise(v)).alias("meta"))
    # Each word's row has its document's date text as well, so that words need no second pass over the files.
    dated = rows.filter("pos >= 0").withColumn("date", F.coalesce(text.leading_year(F.col("value")), F.lit(0)))
    return Corpus(docs, dated.select("doc_id", "sent_id", "seg_id", "pos", "date", *names))


def read_compiled(spark: SparkSession, *paths: str) -> Corpus:
    """One or several compiled corpora as one. Each is read by itself, as the folders of dates in it are its own."""
    out = None
    for p in paths:
        one = Corpus(spark.read.parquet(f"{p}/docs"), spark.read.parquet(f"{p}/tokens"))
        out = one if out is None else out.union(one)
    return out


#: Document classes by name.
READERS: dict[str, Callable[..., Corpus]] = {"tabs": read_tabs, "json": read_json, "tcf": read_tcf, "tei": read_tei, "xml": read_xml, "compiled": read_compiled}


def listed_files(spark: SparkSession, *lists: str) -> list[str]:
    """The paths that lists of files name, a path a line; empty lines and those that begin with a number sign are left out."""
    rows = spark.read.text(list(lists)).select(F.trim("value").alias("v")).filter("v <> '' and not startswith(v, '#')").distinct().orderBy("v")
    return [r["v"] for r in rows.collect()]  # as Spark wants paths on the driver


def kind_of(spark: SparkSession, path: str) -> str:
    """What class of documents a path holds: a compiled corpus by its folders, others by the end of their names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    inside = lambda name: spark._jvm.org.apache.hadoop.fs.Path(target, name)
    if fs.exists(inside("docs")) and fs.exists(inside("tokens")):
        return "compiled"
    ends = {"json": "json", "tabs": "tabs", "tsv": "tabs", "tcf": "tcf", "tei": "tei", "xml": "xml"}
    end = path.rstrip("*/").rsplit(".", 1)[-1].lower()
    if end not in ends:
        raise ValueError(f"can't tell what documents {path} holds")
    return ends[end]


def read(spark: SparkSession, path: str | list[str], kind: str | None = None, *, lists: bool = False, **options) -> Corpus:
    """Documents of a class, or of the class that the first path tells. lists: the paths are of files that list files."""
    if lists:
        path = listed_files(spark, *([path] if isinstance(path, str) else path))
    first = path if isinstance(path, str) else path[0]
    kind = kind or kind_of(spark, first)
    if kind == "compiled" and not isinstance(path, str):
        return read_compiled(spark, *path)
    return READERS[kind](spark, path, **options)
