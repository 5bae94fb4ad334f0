"""Export of a catalogue to fixture files: one JSON array for each publisher, document and model, or tables of records."""

import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.fixtures import encode


def export_path(publisher: Column, document: Column, model: Column) -> Column:
    """publisher/document/Model.json; without a document publisher/Model.json; without both Model.json."""
    return F.concat_ws("/", publisher, document, F.concat(model, F.lit(".json")))


def scoped(rows: DataFrame, parents: list[tuple[DataFrame, str]]) -> DataFrame:
    """The rows with their `document`, over as many parents as it takes: each (table with key and parent or document, column that points to it)."""
    column = parents[0][1]
    out = rows.withColumn("__at", F.col(column))
    for k, (table, _) in enumerate(parents):
        up = "document" if k == len(parents) - 1 else parents[k + 1][1]
        out = out.join(table.select(F.col("key").alias("__k"), F.col(up).alias("__up")), F.col("__at") == F.col("__k"), "left").drop("__k").withColumn("__at", F.col("__up")).drop("__up")
    return out.withColumnRenamed("__at", "document")


def export(tables: dict[str, DataFrame], documents: DataFrame, root: str) -> None:
    """Writes the rows of all tables (with a column `document`) as records; an empty model gives no folder, an empty export an empty table."""
    place = documents.select(F.col("key").alias("__doc"), F.col("publisher").alias("publisher"))
    parts = []
    for model, df in tables.items():
        keyed = df.withColumn("__doc", F.col("document"))
        records = encode(keyed.drop("__doc"), model).withColumn("fields", F.to_json("fields"))
        parts.append(records.withColumn("__doc", F.get_json_object("fields", "$.document")))
    every = reduce(DataFrame.unionByName, parts).join(F.broadcast(place), "__doc", "left").withColumnRenamed("__doc", "document")
    every.write.mode("overwrite").partitionBy("publisher", "document", "model").json(root)


def record_text(df: DataFrame, model: str, key: str = "key") -> Column:
    """A row as the JSON text of its record {fields, model, pk}: names sorted, nulls kept, decimals and times as texts."""

    def plain(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("string")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        return c.alias(field.name)

    fields = [plain(f) for f in sorted(df.schema, key=lambda f: f.name) if f.name != key]
    whole = F.struct(F.struct(*fields).alias("fields"), F.lit(model).alias("model"), F.col(f"`{key}`").alias("pk"))
    return F.to_json(whole, {"ignoreNullFields": "false"})


def write_arrays(records: DataFrame, root: str, empty: list[str] = ()) -> list[str]:
    """Writes (place, pk, text) as one JSON array for each place, a path below the root, ordered by pk; gives the places.

    Tasks stream the sorted records of a place into one file of a draft folder; then each file is renamed to its place,
    so that a reader sees a file before or after, never half of it, and a run that fails changes nothing. empty: places
    that get an empty array where they have no record. Other files below the root stay. Rows without a place are errors.
    """
    spark = records.sparkSession
    by = Window.partitionBy("place").orderBy("pk", "text")
    first, last = F.row_number().over(by) == 1, F.lead("text").over(by).isNull()
    held = F.when(F.col("place").isNull(), F.raise_error(F.lit("a record has no place"))).otherwise(F.col("place"))
    lines = records.withColumn("place", held).withColumn("first", first).withColumn("last", last)
    value = F.concat(F.when(F.col("first"), "[\n").otherwise(""), F.col("text"), F.when(F.col("last"), "\n]").otherwise(","))
    draft = f"{root.rstrip('/')}/.draft-{uuid.uuid4().hex}"
    lines.select("place", value.alias("value")).write.partitionBy("place").text(draft)
    return _put_in_place(spark, draft, root.rstrip("/"), list(empty))


def _put_in_place(spark: SparkSession, draft: str, root: str, empty: list[str]) -> list[str]:
    """Renames the draft's files, of which there is one for each place: as many as a catalogue has documents and models."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(draft).getFileSystem(spark._jsc.hadoopConfiguration())
    places = []
    for folder in files.listStatus(path(draft)):
        name = folder.getPath().getName()
        if not name.startswith("place="):
            continue
        place = unquote(name.removeprefix("place="))
        parts = [f.getPath() for f in files.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
        if len(parts) != 1:
            raise RuntimeError(f"{place} was written by {len(parts)} tasks")
        _rename(files, path, parts[0], f"{root}/{place}")
        places.append(place)
    for place in sorted(set(empty) - set(places)):
        made = path(f"{draft}/empty")
        stream = files.create(made, True)
        stream.write(b"[]\n")
        stream.close()
        _rename(files, path, made, f"{root}/{place}")
        places.append(place)
    files.delete(path(draft), True)
    return sorted(places)


def _rename(files, path, source, target: str) -> None:
    to = path(target)
    files.mkdirs(to.getParent())
    if files.exists(to):
        files.delete(to, False)
    if not files.rename(source, to):
        raise RuntimeError(f"{target} can't be written")


def appended(spark: SparkSession, root: str, place: str, records: DataFrame) -> list[str]:
    """Adds (pk, text) records to the array at a place; a record of a known pk replaces the one there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{place}")
    new = records.select(F.lit(place).alias("place"), "pk", "text")
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        old = spark.read.option("multiLine", True).schema("model string, pk string, fields string").json(str(target.toString()))
        # The fields' own text is kept as it is.
        text = F.concat(F.lit('{"fields":'), "fields", F.lit(',"model":'), _quoted("model"), F.lit(',"pk":'), _quoted("pk"), F.lit("}"))
        kept = old.where("pk IS NOT NULL").select(F.lit(place).alias("place"), "pk", text.alias("text")).join(new.select("pk"), "pk", "left_anti")
        new = kept.select("place", "pk", "text").unionByName(new)
    return write_arrays(new, root)


def _quoted(c: str) -> Column:
    return F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'^\{"x":(.*)\}$', 1)
