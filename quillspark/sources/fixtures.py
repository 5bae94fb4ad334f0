"""Fixture files: JSON arrays of {model, pk, fields}."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.aggregates import keep_first

ENVELOPE = "model string, pk string, fields string, _corrupt_record string"


def read_fixtures(spark: SparkSession, root: str) -> DataFrame:
    """(model, pk, fields as JSON text, file, _corrupt_record) of all *.json below the root."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").schema(ENVELOPE).json(root)
    return rows.withColumn("file", F.input_file_name())


def decode(fixtures: DataFrame, model: str, schema: T.StructType, key: str = "key", last_wins: bool = True) -> DataFrame:
    """Typed rows of one model. Values that don't fit are null (see misfits); of several rows of a key the last by file path stays."""
    loose = T.StructType([T.StructField(f.name, f.dataType if isinstance(f.dataType, (T.ArrayType, T.StructType)) else T.StringType()) for f in schema])
    rows = fixtures.where(F.col("model") == model).withColumn("__f", F.from_json("fields", loose))
    cols = [(F.col(f"__f.{f.name}") if isinstance(f.dataType, (T.ArrayType, T.StructType)) else _typed(f)).alias(f.name) for f in schema]
    typed = rows.select(F.col("pk").alias(key), *cols, "file")
    return (keep_first(typed, [key], [F.desc("file")]) if last_wins else typed).drop("file")


def _typed(field: T.StructField):
    text = F.col(f"__f.{field.name}")
    if isinstance(field.dataType, T.IntegralType):  # whole numbers may be written with a point
        return text.try_cast("double").try_cast(field.dataType)
    return text.try_cast(field.dataType)


def misfits(fixtures: DataFrame, model: str, schema: T.StructType) -> DataFrame:
    """(file, pk, column, value) of values that their column's type doesn't take."""
    names = [f for f in schema if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.StringType))]
    rows = fixtures.where(F.col("model") == model).withColumn("__f", F.from_json("fields", T.StructType([T.StructField(f.name, T.StringType()) for f in schema])))
    found = [rows.where(F.col(f"__f.{f.name}").isNotNull() & _typed(f).isNull()).select("file", "pk", F.lit(f.name).alias("column"), F.col(f"__f.{f.name}").alias("value")) for f in names]
    return reduce(DataFrame.unionByName, found) if found else rows.select("file", "pk", F.lit("").alias("column"), F.lit("").alias("value")).limit(0)


def unreadable(fixtures: DataFrame) -> DataFrame:
    """Files and texts that aren't records."""
    return fixtures.where(F.col("_corrupt_record").isNotNull() | F.col("model").isNull()).select("file", "_corrupt_record")


def encode(df: DataFrame, model: str, key: str = "key") -> DataFrame:
    """(model, pk, fields) records of typed rows."""
    return df.select(F.lit(model).alias("model"), F.col(key).alias("pk"), F.struct(*(c for c in df.columns if c != key)).alias("fields"))


def write_fixtures(records: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines in folders by the given columns."""
    writer = records.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; arrays, maps and structs are written as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema if not f.name.startswith("_")]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
