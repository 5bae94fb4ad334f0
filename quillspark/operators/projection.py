"""Column choice at the root and in nested structures, by request parameters."""

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def only(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The named columns in the table's order; unknown names are ignored, no known one keeps all."""
    wanted = set(names)
    kept = [c for c in df.columns if c in wanted]
    return df.select(*kept) if kept else df


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def _inner(kind: T.DataType) -> T.StructType | None:
    if isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return kind if isinstance(kind, T.StructType) else None


def _each(column: str, kind: T.DataType, make) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(F.col(column), make)
    return F.when(F.col(column).isNotNull(), make(F.col(column)))


def only_nested(df: DataFrame, column: str, names: Iterable[str]) -> DataFrame:
    """Prunes a struct, or each struct of an array; a null stays null."""
    kind = df.schema[column].dataType
    inner = _inner(kind)
    kept = [n for n in inner.names if n in set(names)] if inner else []
    return df.withColumn(column, _each(column, kind, lambda x: F.struct(*(x[n].alias(n) for n in kept)))) if kept else df


def without_nested(df: DataFrame, column: str, names: Iterable[str]) -> DataFrame:
    kind = df.schema[column].dataType
    inner = _inner(kind)
    return only_nested(df, column, [n for n in inner.names if n not in set(names)]) if inner else df


def apply_params(df: DataFrame, params: Mapping[str, str]) -> DataFrame:
    """fields, exclude, x__fields and x__exclude. Parameters of other names are ignored."""
    for key, value in params.items():
        names = value.split(",")
        column, _, what = key.rpartition("__")
        if what in ("fields", "exclude") and column in df.columns:
            df = (only_nested if what == "fields" else without_nested)(df, column, names)
    if params.get("exclude"):
        df = without(df, params["exclude"].split(","))
    return only(df, params["fields"].split(",")) if params.get("fields") else df


def summary(key: Column, **columns: Column) -> Column:
    """A nested object that is null where its key is null."""
    return F.when(key.isNotNull(), F.struct(*(c.alias(n) for n, c in columns.items())))


def without_nulls(**columns: Column) -> Column:
    """A map of the values that aren't null."""
    pairs = [x for n, c in columns.items() for x in (F.lit(n), c)]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
