"""Declarative row filters: one predicate for each (column, lookup), built from request parameters."""

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRUE = frozenset({"1", "true", "yes"})


def ascii_fold(column: Column) -> Column:
    """Lower case of A-Z only, as comparisons in the catalogue ignore case."""
    return F.translate(column.cast("string"), UPPER, LOWER)


def fold(value: object) -> str:
    return str(value).translate(str.maketrans(UPPER, LOWER))


def is_true(value: object) -> bool:
    """1, true and yes in any case."""
    return str(value).strip().lower() in TRUE


def values(value: object) -> list[str]:
    """A list, or the parts of a comma-separated text."""
    return [x for x in value.split(",") if x] if isinstance(value, str) else list(value)


def _between(c: Column, v: object) -> Column:
    low, high = values(v)
    return c.between(F.lit(low), F.lit(high))


LOOKUPS: dict[str, Callable[[Column, object], Column]] = {
    "exact": lambda c, v: c == F.lit(v),
    "iexact": lambda c, v: ascii_fold(c) == fold(v),
    "in": lambda c, v: c.isin(values(v)),
    "not_in": lambda c, v: ~c.isin(values(v)),
    "contains": lambda c, v: ascii_fold(c).contains(fold(v)),
    "icontains": lambda c, v: ascii_fold(c).contains(fold(v)),
    "startswith": lambda c, v: ascii_fold(c).startswith(fold(v)),
    "range": _between,
    "gt": lambda c, v: c > F.lit(v),
    "gte": lambda c, v: c >= F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "isnull": lambda c, v: c.isNull() if is_true(v) else c.isNotNull(),
    "like": lambda c, v: ascii_fold(c).like(fold(v)),
    "has": lambda c, v: F.array_contains(c, F.lit(v)),
    "has_not": lambda c, v: ~F.array_contains(c, F.lit(v)),
}


def predicate(column: Column, lookup: str, value: object) -> Column:
    if lookup not in LOOKUPS:
        raise ValueError(f"unknown lookup {lookup}")
    return LOOKUPS[lookup](column, value)


class FilterSet:
    """Which lookups each column allows. aliases: parameter names of other columns; a lookup of a parameter follows two underscores. named: parameters that stand for a column and a lookup."""

    def __init__(self, allowed: Mapping[str, list[str]], aliases: Mapping[str, str] | None = None, named: Mapping[str, tuple[str, str]] | None = None):
        self.allowed, self.aliases, self.named = dict(allowed), dict(aliases or {}), dict(named or {})

    @classmethod
    def of_schema(cls, df: DataFrame) -> "FilterSet":
        """Equality on every column; columns that aren't plain values are compared as text."""
        return cls({f.name: ["exact"] if f.dataType.simpleString() in ("string", "int", "bigint", "double", "boolean") else ["icontains"] for f in df.schema})

    def parse(self, name: str) -> tuple[str, str] | None:
        if name in self.named:
            return self.named[name]
        for column, lookups in self.allowed.items():
            for known in (column, *(a for a, c in self.aliases.items() if c == column)):
                for lookup in lookups:
                    if name == (known if lookup == "exact" else f"{known}__{lookup}"):
                        return column, lookup
        return None

    def apply(self, df: DataFrame, params: Mapping[str, object]) -> DataFrame:
        """All given parameters hold; those that name no filter are ignored."""
        column = lambda name: F.col(name if name in df.columns else name.replace("__", "."))
        found = [predicate(column(x[0]), x[1], v) for k, v in params.items() if v not in (None, "") and (x := self.parse(k))]
        return df.where(reduce(lambda a, b: a & b, found)) if found else df


class UnknownValues(ValueError):
    """Values of parameters that no parent row has. errors: parameter -> values, all of a request's."""

    def __init__(self, errors: dict[str, list[str]]):
        super().__init__("; ".join(f"{k}: no {', '.join(v)}" for k, v in sorted(errors.items())))
        self.errors = errors


def check_parents(params: Mapping[str, object], parents: Mapping[str, tuple[DataFrame, str]]) -> None:
    """UnknownValues with all values of a request that aren't keys of their parents, found by one job before the request's own plan runs.

    parents: parameter -> (table, its key); a parameter `name__in` is checked like `name`. Each table is read for the asked
    keys only.
    """
    asked = {}
    for name, value in params.items():
        base = name.removesuffix("__in")
        if base in parents and value not in (None, ""):
            asked[name] = [str(v) for v in values(value)] if name != base else [str(value)]
    if not asked:
        return
    parts = []
    for name, wanted in asked.items():
        table, key = parents[name.removesuffix("__in")]
        parts.append(table.where(F.col(key).isin(wanted)).select(F.lit(name).alias("name"), F.col(key).cast("string").alias("value")).distinct())
    found = {(r["name"], r["value"]) for r in reduce(DataFrame.unionByName, parts).collect()}  # as many as were asked for
    errors = {name: lost for name, wanted in asked.items() if (lost := [v for v in wanted if (name, v) not in found])}
    if errors:
        raise UnknownValues(errors)


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The rows for which the condition holds, and all others, those for which it is null too."""
    sure = F.coalesce(condition, F.lit(False))
    return df.where(sure), df.where(~sure)


def keyword_search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Each word of the text is in one of the columns at least, whatever its case."""
    for word in text.replace(",", " ").split():
        df = df.where(reduce(lambda a, b: a | b, (F.coalesce(predicate(F.col(c), "icontains", word), F.lit(False)) for c in columns)))
    return df


def related(df: DataFrame, bridge: DataFrame, key: str, bridge_key: str, condition: Column) -> DataFrame:
    """Rows that have a related row for which the condition holds (once each)."""
    hits = bridge.where(condition).select(F.col(bridge_key).alias("__key"))
    return df.join(hits, df[key] == F.col("__key"), "left_semi")


def unrelated(df: DataFrame, bridge: DataFrame, key: str, bridge_key: str, condition: Column) -> DataFrame:
    hits = bridge.where(condition).select(F.col(bridge_key).alias("__key"))
    return df.join(hits, df[key] == F.col("__key"), "left_anti")


def json_text_contains(df: DataFrame, column: str, value: str) -> DataFrame:
    """Filter on JSON that is kept as text."""
    return df.where(predicate(F.col(column), "icontains", value))


def without_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def without_key_parts(df: DataFrame, column: str, parts: list[str]) -> DataFrame:
    return reduce(lambda d, p: d.where(~F.col(column).contains(p)), parts, df)
