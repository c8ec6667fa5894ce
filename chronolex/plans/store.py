"""A database that grows: documents are added and taken away by batches, and reading it gives what building it anew would give.

A batch is counted on its own and written as a delta folder: signed unigrams, pairs, marginals, counts by segment and documents, positive for what is added and negative for what is taken away. Pairs under the threshold are kept
too, in a folder beside the others, as later batches may lift them over it. Then a manifest of the next version names all folders that count; a version is created once and never changed, so two writers can't both make
it, and the one that is late adds its folder to the newer version. A batch that is named in the manifest already changes nothing. Reading sums the folders on the way and applies the thresholds to the sums; a target is
pushed down to each of them. A compaction writes the sums as one folder, of which the pairs under the threshold are only read once there are deltas again.

Tokens aren't filtered by frequency here, as such a filter would depend on batches to come; filter them before by lists or patterns. A document belongs to one batch as a whole. A file system must refuse to create a file that exists
already, as HDFS and local disks do. Folders of writers that failed are named by no manifest; tidy() deletes them and those that compactions have replaced, once nothing reads them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relations
from .database import ROW_GROUP, Database

#: The tables of a delta, with the column that is summed; cof_rest are the pairs under the threshold.
_VALUES = {"xf": "f", "cof": "f12", "cof_rest": "f12", "marginal": "f1", "tdf": "f", "docs": "n"}


@dataclass(frozen=True)
class Settings:
    attributes: tuple[str, ...]
    distance: int = 5
    cof_min: int = 2
    segment_least: int = 4


@dataclass(frozen=True)
class Version:
    number: int
    folders: tuple[str, ...]
    batches: tuple[str, ...]


class Store:
    """Open it with the folder alone, or create it with settings."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        if settings is not None and self._text(f"{self.path}/settings.json") is None:
            self._create(f"{self.path}/settings.json", json.dumps({**settings.__dict__, "attributes": list(settings.attributes)}))
        found = json.loads(self._text(f"{self.path}/settings.json") or "null")
        if found is None:
            raise ValueError(f"no store at {path}; create it with settings")
        self.settings = Settings(**{**found, "attributes": tuple(found["attributes"])})
        if settings is not None and settings != self.settings:
            raise ValueError(f"the store at {path} has other settings: {self.settings}")

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _text(self, path: str) -> str | None:
        target, fs = self._fs(path)
        if not fs.exists(target):
            return None
        return "\n".join(r["value"] for r in self.spark.read.text(path).collect())  # a small file

    def _create(self, path: str, text: str) -> bool:
        """Whether the file was made, and not there already."""
        target, fs = self._fs(path)
        fs.mkdirs(target.getParent())
        try:
            out = fs.create(target, False)
        except Exception as error:  # py4j tells Java's errors in a class of its own
            if fs.exists(target):
                return False
            raise error
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def version(self) -> Version:
        """The newest version that was written whole."""
        target, fs = self._fs(f"{self.path}/versions")
        names = sorted((f.getPath().getName() for f in fs.listStatus(target)), reverse=True) if fs.exists(target) else []
        for name in (n for n in names if n.endswith(".json")):
            try:
                found = json.loads(self._text(f"{self.path}/versions/{name}"))
            except ValueError:  # its writer failed
                continue
            return Version(int(name[:-5]), tuple(found["folders"]), tuple(found["batches"]))
        return Version(0, (), ())

    def _commit(self, folder: str, batch: str | None, replaces: Sequence[str] = ()) -> bool:
        while True:
            now = self.version()
            if batch in now.batches or not set(replaces) <= set(now.folders):
                self._drop(folder)
                return False
            target, fs = self._fs(f"{self.path}/versions")
            taken = max([now.number, *(int(f.getPath().getName()[:-5]) for f in (fs.listStatus(target) if fs.exists(target) else []) if f.getPath().getName().endswith(".json"))])
            folders = [*(f for f in now.folders if f not in replaces), folder]
            if self._create(f"{self.path}/versions/{taken + 1:08d}.json", json.dumps({"folders": folders, "batches": [*now.batches, *([batch] if batch else [])]})):
                return True

    def _drop(self, folder: str) -> None:
        target, fs = self._fs(f"{self.path}/data/{folder}")
        fs.delete(target, True)

    def _written(self, tables: dict[str, DataFrame]) -> str:
        """The tables in a folder of their own, sorted by the first attribute and the date so that a target lies in few row groups."""
        folder, first = uuid.uuid4().hex, self.settings.attributes[0]
        for name, key in (("xf", first), ("cof", f"{first}1"), ("cof_rest", f"{first}1"), ("marginal", first), ("tdf", first), ("docs", None)):
            table = tables[name]
            if key:
                table = table.repartitionByRange(key, "date").sortWithinPartitions(key, "date")
            table.write.option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/data/{folder}/{name}")
        return folder

    def _counted(self, tokens: DataFrame, docs: DataFrame, sign: int, order: Sequence[str]) -> dict[str, DataFrame]:
        s, kept = self.settings, relations.written(tokens)
        blocks = relations.windows(kept, s.attributes, s.distance, order=order)
        pairs = relations.written(relations.cooccurrences_of(blocks, s.attributes, s.distance))
        made = {
            "xf": relations.unigrams(kept, s.attributes), "cof": pairs.filter(F.col("f12") >= s.cof_min), "cof_rest": pairs.filter(F.col("f12") < s.cof_min), "marginal": relations.marginals_of(blocks, s.attributes, s.distance),
            "tdf": relations.term_segments(kept, s.attributes, least=s.segment_least, document_min=1), "docs": docs.groupBy(*docs.columns).agg(F.count("*").alias("n")),
        }
        return {name: t.withColumn(_VALUES[name], sign * F.col(_VALUES[name])) for name, t in made.items()}

    def append(self, batch: str, tokens: DataFrame, docs: DataFrame, order: Sequence[str] = ("pos",)) -> bool:
        """Adds documents with their tokens. False, and nothing is changed, if the batch is there already."""
        return self._change(batch, tokens, docs, 1, order)

    def remove(self, batch: str, tokens: DataFrame, docs: DataFrame, order: Sequence[str] = ("pos",)) -> bool:
        """Takes documents away that were added, given their tokens as then."""
        return self._change(batch, tokens, docs, -1, order)

    def _change(self, batch: str, tokens: DataFrame, docs: DataFrame, sign: int, order: Sequence[str]) -> bool:
        if batch in self.version().batches:
            return False
        return self._commit(self._written(self._counted(tokens, docs, sign, order)), batch)

    def _sum(self, name: str, folders: Sequence[str]) -> DataFrame:
        value, parts = _VALUES[name], [self.spark.read.parquet(f"{self.path}/data/{f}/{name}") for f in folders]
        out = parts[0]
        if len(parts) == 1:
            return out
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=name == "docs")
        return out.groupBy(*(c for c in out.columns if c != value)).agg(F.sum(value).alias(value)).filter(F.col(value) != 0)

    def _tables(self, version: Version) -> dict[str, DataFrame]:
        """The sums of all folders; pairs with those under the threshold where there are several folders."""
        if not version.folders:
            raise ValueError(f"the store at {self.path} has no batches")
        out = {name: self._sum(name, version.folders) for name in ("xf", "marginal", "tdf", "docs")}
        value = _VALUES["cof"]
        parts = [self.spark.read.parquet(*(f"{self.path}/data/{f}/{n}" for n in ("cof", "cof_rest"))) for f in version.folders]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        summed = every.groupBy(*(c for c in every.columns if c != value)).agg(F.sum(value).alias(value)).filter(F.col(value) != 0)
        return out | {"pairs": summed}

    def open(self, *, cof_min: int | None = None, document_min: int = 4, term_min: int = 0) -> Database:
        """All that is there as a database, as create() would make it of the same documents. A target asked for is pushed down to the folders."""
        s, now = self.settings, self.version()
        least = s.cof_min if cof_min is None else cof_min
        t = self._tables(now)
        if len(now.folders) == 1 and least >= s.cof_min:
            cof = self.spark.read.parquet(f"{self.path}/data/{now.folders[0]}/cof")
        else:
            cof = t["pairs"]
        tdf = t["tdf"]
        if document_min > 1 or term_min > 1:
            often = tdf.groupBy(*s.attributes).agg(F.count("*").alias("__d"), F.sum("f").alias("__f")).filter((F.col("__d") >= document_min) & (F.col("__f") >= term_min))
            tdf = tdf.join(often.select(*s.attributes), list(s.attributes), "left_semi")
        return Database(s.attributes, t["xf"], cof.filter(F.col("f12") >= least), t["marginal"], tdf, t["docs"].drop("n"), least)

    def compact(self) -> bool:
        """Writes the sums of all folders as one. False if another writer was faster or there's nothing to do."""
        now = self.version()
        if len(now.folders) < 2:
            return False
        t = self._tables(now)
        pairs = relations.written(t.pop("pairs"))
        tables = t | {"cof": pairs.filter(F.col("f12") >= self.settings.cof_min), "cof_rest": pairs.filter(F.col("f12") < self.settings.cof_min)}
        return self._commit(self._written(tables), None, now.folders)

    def tidy(self) -> list[str]:
        """Deletes and names the folders that the newest version doesn't name. Call it while nobody writes or reads an older version."""
        target, fs = self._fs(f"{self.path}/data")
        held = [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []
        gone = [f for f in held if f not in self.version().folders]
        for f in gone:
            self._drop(f)
        return gone
