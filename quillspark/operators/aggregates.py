"""Counts, groups and first or last rows of a group."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by(tables: dict[str, DataFrame], by: str) -> DataFrame:
    """(by, model, actual_count) of every table; groups without rows are left out."""
    return reduce(DataFrame.unionByName, (t.groupBy(by).agg(F.count("*").alias("actual_count")).withColumn("model", F.lit(n)) for n, t in tables.items()))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def words_to_names(df: DataFrame, name: str) -> DataFrame:
    """(word, names) from the words of lower-cased names."""
    words = df.select(name, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(r"(\w+)"), 1))).alias("word"))
    return words.groupBy("word").agg(F.sort_array(F.collect_set(name)).alias("names"))


def suffixed_keys(df: DataFrame, base: str, order: list[str], name: str = "key") -> DataFrame:
    """base, base_1, base_2, ... for rows whose base collides, in order."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order)) - 1
    return df.withColumn(name, F.when(n == 0, F.col(base)).otherwise(F.concat_ws("_", base, n.cast("string"))))


def by_group_size(df: DataFrame, key: str, item: str) -> DataFrame:
    """Sorted distinct items of each key, largest groups first."""
    groups = df.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias("items"))
    return groups.withColumn("n_items", F.size("items")).orderBy(F.desc("n_items"), key)
