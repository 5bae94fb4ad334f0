"""The catalogue as fixture files that load again: v2/License.json, v2/publisher/Publisher.json, v2/publisher/document/Spell.json."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.plans.catalogue import ENTITIES, Catalogue
from quillspark.plans.references import TYPES, path_to_document
from quillspark.sources import exports

# Tables of no document, and those of which an empty array is written for each document, so that old rows go.
AT_ROOT = ["license", "gamesystem"]
ALWAYS = ["crossreference"]


def with_place(catalogue: Catalogue, entity: str) -> DataFrame:
    """The entity's rows with the document and publisher that they are exported under, in __document and __publisher."""
    rows = catalogue.tables[entity]
    none = F.lit(None).cast("string")
    if entity in AT_ROOT:
        return rows.select("*", none.alias("__document"), none.alias("__publisher"))
    if entity == "publisher":
        return rows.select("*", none.alias("__document"), F.col("key").alias("__publisher"))
    if entity == "document":
        return rows.select("*", F.col("key").alias("__document"), F.col("publisher").alias("__publisher"))
    path = path_to_document(entity)
    parents = [(catalogue.tables[above], "parent") for above in path[1:]]
    own = rows.withColumn("__document", F.col("document")) if not parents else _lifted(rows, parents)
    publishers = catalogue.document.select(F.col("key").alias("__d"), F.col("publisher").alias("__publisher"))
    return own.join(publishers, F.col("__document") == F.col("__d"), "left").drop("__d")


def _lifted(rows: DataFrame, parents: list[tuple[DataFrame, str]]) -> DataFrame:
    document = exports.scoped(rows.select("key", "parent"), parents).select(F.col("key").alias("__key"), F.col("document").alias("__document"))
    return rows.join(document, F.col("key") == F.col("__key"), "left").drop("__key")


def _place(folder: str, entity: str, publisher: Column, document: Column) -> Column:
    return exports.export_path(F.concat_ws("/", F.lit(folder), publisher), document, F.lit(TYPES[entity]))


def export_catalogue(catalogue: Catalogue, root: str, folder: str = "v2", prefix: str = "api_v2") -> list[str]:
    """Writes all tables below the root; gives the files. Tables and documents without rows get no file, but for ALWAYS.

    Rows whose document doesn't exist are written below its name without a publisher, rows whose parents lead nowhere
    below the folder itself: none is left out. What is read from the files and written again is the same to the byte.
    """
    parts = []
    for entity in ENTITIES:
        rows = with_place(catalogue, entity)
        own = rows.drop("__document", "__publisher")
        text = exports.record_text(own, f"{prefix}.{entity}")
        parts.append(rows.select(_place(folder, entity, F.col("__publisher"), F.col("__document")).alias("place"), F.col("key").alias("pk"), text.alias("text")))
    documents = catalogue.document.select("key", "publisher").collect()  # a catalogue of documents, not their rows
    empty = ["/".join(filter(None, (folder, d.publisher, d.key, f"{TYPES[e]}.json"))) for d in documents for e in ALWAYS]
    return exports.write_arrays(reduce(DataFrame.unionByName, parts), root, empty)
