"""Builds of the catalogue's tables from fixture files, of which only what changed is read again.

A build lists the files; those of the same length and time as in the last build are not opened. The others are parsed
once, counted by file, and the tables of the types that they hold, or held, are decoded anew; all other tables of the new
version are those of the version before.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.merges import changes
from quillspark.plans.catalogue import ENTITIES, Catalogue
from quillspark.sources.fixtures import ENVELOPE, decode
from quillspark.sources.versions import Versions

FILES = "path string, length long, modified timestamp"
OUTCOMES = "path string, model string, rows long, unreadable long"


class UnreadableFixture(ValueError):
    """A file holds what isn't a record."""


@dataclass
class Build:
    """What a build did. records, unreadable: of the files that were read, counted while they were."""

    version: int | None
    read: list[str] = field(default_factory=list)
    rebuilt: list[str] = field(default_factory=list)
    records: int = 0
    unreadable: int = 0


@dataclass
class CatalogueStore:
    spark: SparkSession
    fixtures: str
    root: str
    prefix: str = "api_v2"

    def __post_init__(self):
        self.versions = Versions(self.spark, self.root)

    def listed(self) -> DataFrame:
        """FILES of all fixture files; none is opened."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(self.fixtures)
        return found.select("path", "length", F.col("modificationTime").alias("modified"))

    def table(self, name: str, ddl: str) -> DataFrame:
        folder = self.versions.current()
        return self.spark.read.schema(ddl).parquet(f"{folder}/{name}") if folder else self.spark.createDataFrame([], ddl)

    def outcomes(self) -> DataFrame:
        """(path, model, rows, unreadable) of every file of the current version."""
        return self.table("__outcomes", OUTCOMES)

    def _records(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.option("multiLine", True).schema(ENVELOPE).json(paths)
        # Spark gives the name of a file that is read as a URI, that of a file that is listed as a path.
        name = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
        return rows.withColumn("file", F.regexp_replace(name, "^file:/+", "file:/"))

    def build(self, strict: bool = True) -> Build:
        """Makes the tables of the files as they are now the current version; the version stays where nothing changed.

        strict: UnreadableFixture, naming the first file by path, where something isn't a record, and no new version;
        else such things are counted and left out.
        """
        files = self.listed()
        differing = changes(self.table("__files", FILES), files, ["path"]).where("change != 'same'").collect()  # files, not their rows
        if not differing and self.versions.current():
            return Build(self.versions.numbers()[-1])
        fresh = sorted(r.path for r in differing if r.change != "removed")
        gone = [r.path for r in differing]
        folder = self.versions.new_folder()
        files.write.parquet(f"{folder}/__files")
        old = self.outcomes().where(~F.col("path").isin(gone)) if gone else self.outcomes()
        touched = {r.model for r in self.outcomes().where(F.col("path").isin(gone)).select("model").distinct().collect()} if gone else set()
        build = Build(None, fresh)
        new = self.spark.createDataFrame([], OUTCOMES)
        if fresh:
            seen = Observation("fixtures")
            bad = F.col("_corrupt_record").isNotNull() | F.col("model").isNull()
            read = self._records(fresh).withColumn("bad", bad).observe(seen, F.count("*").alias("records"), F.count(F.when(F.col("bad"), 1)).alias("unreadable"))
            read.write.parquet(f"{folder}/__records")
            build.records, build.unreadable = seen.get["records"], seen.get["unreadable"]
            kept = self.spark.read.parquet(f"{folder}/__records")
            if strict and build.unreadable:
                first = kept.where("bad").groupBy("file").count().orderBy("file").first()
                raise UnreadableFixture(f"{first.file} holds {first['count']} things that aren't records")
            new = kept.groupBy(F.col("file").alias("path"), "model").agg(F.count(F.when(~F.col("bad"), 1)).alias("rows"), F.count(F.when(F.col("bad"), 1)).alias("unreadable"))
            touched |= {r.model for r in kept.select("model").distinct().collect()}
        old.select("path", "model", "rows", "unreadable").unionByName(new).write.parquet(f"{folder}/__outcomes")
        every = self.spark.read.schema(OUTCOMES).parquet(f"{folder}/__outcomes")
        before = dict(self.table("__tables", "entity string, path string").collect())
        at = {}
        for entity, ddl in ENTITIES.items():
            model = f"{self.prefix}.{entity}"
            if entity in before and model not in touched:
                at[entity] = before[entity]
                continue
            # A file comes as many times as it has models; few files hold several.
            paths = sorted(r.path for r in every.where(F.col("model") == model).select("path").distinct().collect())
            known = [p for p in paths if p not in set(fresh)]
            rows = self._records(known).drop("_corrupt_record") if known else self.spark.createDataFrame([], "model string, pk string, fields string, file string")
            if fresh:
                rows = rows.unionByName(self.spark.read.parquet(f"{folder}/__records").where("NOT bad").select("model", "pk", "fields", "file"))
            at[entity] = f"{folder}/{entity}"
            decode(rows, model, T.StructType.fromDDL(ddl)).write.parquet(at[entity])
            build.rebuilt.append(entity)
        self.spark.createDataFrame(sorted(at.items()), "entity string, path string").coalesce(1).write.parquet(f"{folder}/__tables")
        build.version = self.versions.publish(folder)
        return build

    def load(self) -> Catalogue | None:
        """The current version's catalogue; None before the first build."""
        found = self.table("__tables", "entity string, path string").collect()
        return Catalogue({e: self.spark.read.parquet(p) for e, p in found}) if found else None
