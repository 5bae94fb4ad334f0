"""Order and pages. Every order ends with the key, so that pages don't overlap."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 50  #: fixed value: rows of a page unless asked otherwise


def ordered(df: DataFrame, ordering: str | None, key: str, allowed: list[str] | None = None) -> DataFrame:
    """By a, -b, ...: columns that aren't allowed are ignored; the key is last."""
    names = [x for x in (ordering or "").split(",") if x.lstrip("-") in (allowed or df.columns)]
    by = [F.desc(x[1:]) if x[0] == "-" else F.asc(x) for x in names]
    return df.orderBy(*by, *([] if key in {x.lstrip("-") for x in names} else [F.asc(key)]))


@dataclass
class Page:
    count: int
    number: int
    size: int
    rows: DataFrame

    @property
    def next(self) -> int | None:
        return self.number + 1 if self.number * self.size < self.count else None

    @property
    def previous(self) -> int | None:
        return self.number - 1 if self.number > 1 else None


def page_rows(df: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """The rows of one page of an ordered table (a top-k, no full sort, as long as pages are near the start)."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes begin at 1")
    return df.offset((number - 1) * size).limit(size)


def page(df: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> Page:
    count = df.count()
    if number > max(1, -(-count // size)):
        raise LookupError(f"there is no page {number}")
    return Page(count, number, size, page_rows(df, number, size))


def one(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key; LookupError if there is none."""
    found = df.where(F.col(key) == F.lit(value)).limit(1)
    if found.isEmpty():
        raise LookupError(f"no {key} {value}")
    return found
