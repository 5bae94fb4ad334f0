"""Text sources: key lists, Markdown sections, lines that need attention, images by name."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def key_list(spark: SparkSession, path: str | None) -> DataFrame:
    """(key) of the trimmed lines that aren't blank; none without a path."""
    if not path:
        return spark.createDataFrame([], "key string")
    return spark.read.text(path).select(F.trim("value").alias("key")).where("key <> ''").distinct()


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def sections(df: DataFrame, text: str, level: int, keys: list[str]) -> DataFrame:
    """(keys, position, title, body) of the parts that begin with a heading of the level; what stands before the first is left out."""
    mark = "#" * level + " "
    parts = df.select(*keys, F.posexplode(F.split(F.col(text), rf"(?:^|\n){mark}", -1)).alias("position", "part")).where("position > 0")
    title = F.trim(F.regexp_extract("part", r"^([^\n]*)", 1))
    return parts.select(*keys, "position", title.alias("title"), F.trim(F.regexp_replace("part", r"^[^\n]*\n?", "")).alias("body"))


def named_blocks(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, position, name, body) of blocks that begin with ***Name.***"""
    parts = df.select(*keys, F.posexplode(F.split(F.col(text), r"(?:^|\n)\*\*\*", -1)).alias("position", "part")).where("position > 0")
    return parts.select(*keys, "position", F.regexp_extract("part", r"^(.*?)\.\*\*\*", 1).alias("name"), F.trim(F.regexp_replace("part", r"^.*?\.\*\*\*\s*", "")).alias("body"))


def key_values(text: Column) -> Column:
    """Map of the lines "**Key:** value"."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^[-\s]*\*\*[^*]+:\*\*"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"\*\*([^*]+):\*\*", 1).alias("key"), F.trim(F.regexp_extract(x, r":\*\*\s*(.*)$", 1)).alias("value")))
    return F.map_from_entries(pairs)


def escaped_lines(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, line number from 1, line) of lines with \\u escapes."""
    lines = df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").contains("\\u")).withColumn("line_no", F.col("line_no") + 1)


def wide_to_long(df: DataFrame, key: str, columns: dict[str, str], name: str = "type", value: str = "desc") -> DataFrame:
    """(key, type, desc) with a row for each column that isn't blank; columns: name -> type."""
    long = df.select(key, F.explode(F.array(*(F.struct(F.lit(t).alias(name), F.col(c).cast("string").alias(value)) for c, t in columns.items()))).alias("x")).select(key, "x.*")
    return long.where(F.coalesce(F.col(value), F.lit("")) != "")


def image_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, name, key) of the SVG files of a folder, by file name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.svg").load(folder).select("path")
    stem = F.regexp_extract("path", r"([^/]+)\.svg$", 1)
    return files.select(F.col("path").alias("file_path"), F.initcap(F.regexp_replace(stem, "[-_]+", " ")).alias("name"), F.lower(F.regexp_replace(stem, "_", "-")).alias("key"))
