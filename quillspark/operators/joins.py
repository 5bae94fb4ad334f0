"""Nested records by joins: children are aggregated once and joined once, never fetched row by row."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_children(parents: DataFrame, children: DataFrame, key: str, parent: str, name: str, fields: list[str], order: list[str]) -> DataFrame:
    """A column `name` with the sorted array of each parent's children; an empty array where there is none."""
    item = F.struct(*(F.col(c).alias(f"__o{k}") for k, c in enumerate(order)), *fields)
    rows = children.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("__parent")).agg(F.sort_array(F.collect_list(item)).alias("__items"))
    plain = F.transform("__items", lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    joined = parents.join(rows, parents[key] == F.col("__parent"), "left")
    return joined.withColumn(name, F.coalesce(plain, F.array())).drop("__parent", "__items")


def with_parent(rows: DataFrame, parents: DataFrame, key: str, parent_key: str, name: str, fields: list[str]) -> DataFrame:
    """A struct of the parent's columns; null where the row has no parent."""
    side = parents.select(F.col(parent_key).alias("__key"), F.struct(*fields).alias(name))
    return rows.join(side, rows[key] == F.col("__key"), "left").drop("__key")


def bridge(rows: DataFrame, key: str, array: str, name: str) -> DataFrame:
    """(key, name) rows of a many-to-many relation that is stored as an array."""
    return rows.select(key, F.explode(array).alias(name)).distinct()


def first_found(rows: DataFrame, lookups: list[tuple[Column, DataFrame, str, str]], name: str) -> DataFrame:
    """The value of the first lookup that has one: (key expression, table, key column, value column)."""
    values = []
    for k, (key, table, column, value) in enumerate(lookups):
        side = table.select(F.col(column).alias(f"__k{k}"), F.col(value).alias(f"__v{k}"))
        rows = rows.join(side, key == F.col(f"__k{k}"), "left").drop(f"__k{k}")
        values.append(F.col(f"__v{k}"))
    return rows.withColumn(name, F.coalesce(*values)).drop(*(f"__v{k}" for k in range(len(lookups))))


def polymorphic(edges: DataFrame, tables: dict[str, DataFrame], kind: str, key: str, name: str = "name") -> DataFrame:
    """The name of what each (type, key) points to; the type chooses the table. Tables have columns key and name."""
    union = reduce(DataFrame.unionByName, (t.select(F.lit(k).alias("__kind"), F.col("key").cast("string").alias("__key"), F.col("name").alias(name)) for k, t in tables.items()))
    return edges.join(union, (edges[kind] == F.col("__kind")) & (edges[key].cast("string") == F.col("__key")), "left").drop("__kind", "__key")
