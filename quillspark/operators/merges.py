"""Columns patched from a paired table, change sets between two versions of a table, and key changes carried through a tree of tables."""

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IF_NULL, ALWAYS, CLEAR = "if_null", "always", "clear"


class AmbiguousKeys(ValueError):
    """Several rows of the paired table have one key."""


@dataclass
class Patch:
    """rows: the patched table. report: (key, outcome) of every row and of the paired table's keys that no row has.

    Outcomes: matched, unmatched, ambiguous (several paired rows; the row stays as it is), skipped (left out by the
    condition) and unused.
    """

    rows: DataFrame
    report: DataFrame

    def counts(self) -> DataFrame:
        return self.report.groupBy("outcome").agg(F.count("*").alias("n"))


def patched(
    rows: DataFrame, source: DataFrame, key: str | Column, source_key: str | Column, columns: dict[str, tuple[Column | str | None, str]], overrides: dict[str, str] | None = None, only: Column | None = None, strict: bool = False, report_key: str | None = None
) -> Patch:
    """Sets columns of the rows from the source's row with the same key.

    columns: name -> (expression over the source's columns, policy): `if_null` keeps what the row has, `always` takes the
    paired value even where it is null, `clear` makes the column null and needs no expression. overrides: keys of rows
    that pair with another key of the source than their own. only: which rows are patched at all. strict: raise
    AmbiguousKeys, naming some, if the source repeats a key; else these rows are reported. A null key pairs with nothing.
    The source is aggregated by key once and joined once.
    """
    unknown = [c for c in columns if c not in rows.columns]
    if unknown or any(p not in (IF_NULL, ALWAYS, CLEAR) for _, p in columns.values()):
        raise ValueError(f"columns that can't be patched: {unknown or columns}")
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    taken = {c: as_column(x) for c, (x, p) in columns.items() if p != CLEAR}
    paired = source.select(as_column(source_key).cast("string").alias("__pair"), F.struct(F.lit(True).alias("__is"), *(x.alias(c) for c, x in taken.items())).alias("__new")).where("__pair IS NOT NULL")
    paired = paired.groupBy("__pair").agg(F.count("*").alias("__many"), F.first("__new").alias("__new"))
    if strict:
        twice = [r["__pair"] for r in paired.where("__many > 1").orderBy("__pair").limit(10).collect()]
        if twice:
            raise AmbiguousKeys(f"several rows for {', '.join(twice)}")
    own = as_column(key).cast("string")
    pairs = [F.lit(x) for p in (overrides or {}).items() for x in p]
    asked = F.coalesce(F.try_element_at(F.create_map(*pairs), own), own) if pairs else own
    joined = rows.withColumn("__own", own).withColumn("__asked", asked).join(paired, F.col("__asked") == F.col("__pair"), "left")
    outcome = F.when(~F.coalesce(only, F.lit(False)), "skipped") if only is not None else F.when(F.lit(False), "")
    outcome = outcome.when(F.col("__many") > 1, "ambiguous").when(F.col("__many") == 1, "matched").otherwise("unmatched")
    joined = joined.withColumn("__outcome", outcome)
    hit, within = F.col("__outcome") == "matched", F.col("__outcome") != "skipped"

    def value(c: str) -> Column:
        if c not in columns:
            return F.col(f"`{c}`")
        old, kind = F.col(f"`{c}`"), rows.schema[c].dataType
        if columns[c][1] == CLEAR:
            return F.when(within, F.lit(None).cast(kind)).otherwise(old).alias(c)
        new = F.col(f"__new.`{c}`").cast(kind)
        return F.when(hit, F.coalesce(old, new) if columns[c][1] == IF_NULL else new).otherwise(old).alias(c)

    name = report_key or (key if isinstance(key, str) else "key")
    report = joined.select(F.col("__own").alias(name), F.col("__outcome").alias("outcome"))
    unused = paired.join(joined.select(F.col("__asked").alias("__seen")).where("__seen IS NOT NULL").distinct(), F.col("__pair") == F.col("__seen"), "left_anti")
    report = report.unionByName(unused.select(F.col("__pair").alias(name), F.lit("unused").alias("outcome")))
    return Patch(joined.select(*(value(c) for c in rows.columns)), report)


def changes(existing: DataFrame, new: DataFrame, keys: list[str], over: list[str] | None = None) -> DataFrame:
    """(keys, change) of every key of two versions of a table: added, removed, replaced (other values) or same.

    over: the columns that are compared, by default all of `new` besides the keys. Only keys and a fingerprint of the rest
    are shuffled. Keys are unique in each version (aggregates.duplicates tells); null keys are compared like others.
    """
    rest = over if over is not None else [c for c in new.columns if c not in keys]

    def marked(df: DataFrame, name: str) -> DataFrame:
        # A digest of all values, with the places of nulls: equal rows only.
        value = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest))), {"ignoreNullFields": "false"}), 256)
        return df.select(*(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keys)), value.alias(name))

    old, now = marked(existing, "__old").alias("o"), marked(new, "__now").alias("n")
    same = reduce(lambda a, b: a & b, (F.col(f"o.__k{i}").eqNullSafe(F.col(f"n.__k{i}")) for i in range(len(keys))))
    both = old.join(now, same, "full")
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__now").isNull(), "removed").when(F.col("__old") == F.col("__now"), "same").otherwise("replaced")
    return both.select(*(F.coalesce(f"o.__k{i}", f"n.__k{i}").alias(c) for i, c in enumerate(keys)), kind.alias("change"))


def change_counts(changed: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, added, replaced, removed, same): what a run would do, before anything is written."""
    kinds = ("added", "replaced", "removed", "same")
    return changed.groupBy(*by).agg(*(F.count(F.when(F.col("change") == k, 1)).alias(k) for k in kinds))


@dataclass
class Level:
    """A table whose keys change. base: its new key before numbering, over its columns, of which the parent's is new already."""

    table: str
    key: str
    base: Column
    order: list[str] = field(default_factory=list)


@dataclass
class Cascade:
    """tables: with new keys and references. maps: (old, new) keys of each table of the levels."""

    tables: dict[str, DataFrame]
    maps: dict[str, DataFrame]


def numbered(rows: DataFrame, base: Column, order: list[str], name: str) -> DataFrame:
    """The rows with unique texts `name`: base, base_1, base_2, ... in order, where a number is passed over that another base already is.

    Rows without a base are numbered too, after `_`. The first row of a base keeps it.
    """
    start = rows.withColumn("__base", F.coalesce(base.cast("string"), F.lit("_")))
    number = F.row_number().over(Window.partitionBy("__base").orderBy(*order)) - 1
    start = start.withColumn("__no", number)
    # Numbers that can't be used: those with which a base ends that also has another base as its stem.
    bases = start.select("__base").distinct()
    stem = F.regexp_extract("__base", r"^(.*)_[1-9]\d*$", 1)
    digits = F.regexp_extract("__base", r"_([1-9]\d{0,8})$", 1)
    used = bases.where((stem != "") & (digits != "")).select(stem.alias("__stem"), digits.cast("int").alias("__taken")).groupBy("__stem").agg(F.sort_array(F.collect_set("__taken")).alias("__used"))
    joined = start.join(used, F.col("__base") == F.col("__stem"), "left")
    # The n-th number that isn't used: each used one up to it moves it by one.
    moved = F.aggregate(F.coalesce("__used", F.array().cast("array<int>")), F.col("__no"), lambda n, u: F.when((F.col("__no") > 0) & (u <= n), n + 1).otherwise(n))
    return joined.withColumn(name, F.when(F.col("__no") == 0, F.col("__base")).otherwise(F.concat_ws("_", F.col("__base"), moved.cast("string")))).drop("__base", "__no", "__stem", "__used")


def cascade(tables: dict[str, DataFrame], levels: list[Level], references: list[tuple[str, str, str]], keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Cascade:
    """New keys for a tree of tables, parents first, and every reference to them.

    references: (table, column, table that its key belongs to); columns of arrays are followed element by element.
    References to keys that don't exist stay as they are; null references too. Old keys are unique, so the numbers are the
    same each time they are given. keep: writes a map of
    keys and reads it again, so that all references of a table are joined with the same one.
    """
    out, maps = dict(tables), {}
    for level in levels:
        df = out[level.table]
        named = numbered(df, level.base, [*level.order, level.key], "__new")
        map_ = keep(named.select(F.col(level.key).cast("string").alias("old"), F.col("__new").alias("new")), level.table)
        maps[level.table] = map_
        # The table's own keys stand beside the new ones: it isn't joined with its map. A null key stays null.
        out[level.table] = named.select(*(F.when(F.col(f"`{c}`").isNotNull(), F.col("__new")).alias(c) if c == level.key else F.col(f"`{c}`") for c in df.columns))
        for table, column, target in references:
            if target == level.table:
                out[table] = _followed(out[table], column, map_)
    return Cascade(out, maps)


def _followed(df: DataFrame, column: str, map_: DataFrame) -> DataFrame:
    """The table with a column's keys replaced by the map's."""
    names = map_.select(F.col("old").alias("__old"), F.col("new").alias("__to"))
    if isinstance(df.schema[column].dataType, T.ArrayType):
        whole = df.withColumn("__row", F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))
        lists = whole.select("__row", F.col(f"`{column}`").alias("__list")).where(F.size("__list") > 0).distinct()
        items = lists.select("__row", F.posexplode("__list").alias("__at", "__item")).join(names, F.col("__item").cast("string") == F.col("__old"), "left")
        new = items.groupBy("__row").agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", F.coalesce("__to", F.col("__item").cast("string")).alias("__v")))), lambda x: x["__v"]).alias("__list"))
        joined = whole.join(new, "__row", "left").withColumn("__list", F.coalesce("__list", F.col(f"`{column}`").cast("array<string>")))
        return joined.select(*(F.col("__list").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns))
    joined = df.join(names, F.col(f"`{column}`").cast("string") == F.col("__old"), "left")
    return joined.select(*(F.coalesce("__to", F.col(f"`{c}`").cast("string")).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns))
