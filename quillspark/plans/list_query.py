"""A list request: filter, search, order, page, project."""

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quillspark.operators.filters import FilterSet, check_parents, keyword_search
from quillspark.operators.paging import PAGE_SIZE, Page, ordered, page, page_rows
from quillspark.operators.projection import apply_params


@dataclass
class Listing:
    """What one entity offers to requests. Joins belong into `rows`; Catalyst drops the columns that a request doesn't use."""

    rows: DataFrame
    key: str
    filters: FilterSet
    search_columns: list[str] = field(default_factory=list)
    default_order: str | None = None
    #: Parameters whose values must be keys of another table.
    parents: Mapping[str, tuple[DataFrame, str]] = field(default_factory=dict)

    def matching(self, params: Mapping[str, object]) -> DataFrame:
        check_parents(params, self.parents)
        df = self.filters.apply(self.rows, params)
        if self.search_columns and params.get("search"):
            df = keyword_search(df, str(params["search"]), self.search_columns)
        return ordered(df, str(params.get("ordering") or self.default_order or ""), self.key)

    def rows_of(self, params: Mapping[str, object]) -> DataFrame:
        """The page's rows as one plan, without a count."""
        rows = page_rows(self.matching(params), int(params.get("page") or 1), int(params.get("limit") or PAGE_SIZE))
        return apply_params(rows, {k: str(v) for k, v in params.items()})

    def request(self, params: Mapping[str, object]) -> Page:
        found = page(self.matching(params), int(params.get("page") or 1), int(params.get("limit") or PAGE_SIZE))
        found.rows = apply_params(found.rows, {k: str(v) for k, v in params.items()})
        return found
