"""Checks of loaded tables. Each gives the violating rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_parents(children: DataFrame, column: str, parents: DataFrame, key: str, table: str = "", key_of: str | None = None) -> DataFrame:
    """(table, key, column, value) of references to rows that don't exist; null references pass."""
    lost = children.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti")
    return lost.select(F.lit(table).alias("table"), F.col(key_of or column).cast("string").alias("key"), F.lit(column).alias("column"), F.col(column).cast("string").alias("value"))


def outside_domain(df: DataFrame, key: str, domains: dict[str, list]) -> DataFrame:
    """(key, column, value) of values that aren't among the choices; null passes."""
    return reduce(DataFrame.unionByName, (df.where(F.col(c).isNotNull() & ~F.col(c).isin(*v)).select(F.col(key).cast("string").alias("key"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c, v in domains.items()))


def outside_bounds(df: DataFrame, key: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(key, column, value) of numbers out of their range; null passes."""
    return reduce(DataFrame.unionByName, (df.where(~F.col(c).between(lo, hi)).select(F.col(key).cast("string").alias("key"), F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c, (lo, hi) in bounds.items()))


def numeric_keys(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).cast("string").rlike(r"^\d+$"))


def keys_other_than(df: DataFrame, key: str, expected: Column) -> DataFrame:
    """Rows whose key isn't the one that it should have."""
    return df.withColumn("expected_key", expected).where(~F.col(key).eqNullSafe(F.col("expected_key")))


def rekeyed(df: DataFrame, key: str, new: Column, children: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The table with new keys, and its children with references that follow."""
    names = df.select(F.col(key).alias("__old"), new.alias("__new"))
    moved = {n: c.join(names, c[ref] == F.col("__old"), "left").withColumn(ref, F.coalesce("__new", ref)).drop("__old", "__new") for n, (c, ref) in children.items()}
    return df.withColumn(key, new), moved


def without_children(parents: DataFrame, children: DataFrame, key: str, parent: str) -> DataFrame:
    """Rows that should have a child row and have none."""
    return parents.join(children.select(F.col(parent).alias("__parent")), F.col(key) == F.col("__parent"), "left_anti")
