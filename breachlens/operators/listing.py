"""Incident list view: band / probability filters, user sort, ticket search,
row cap and column projection, composed in the dashboard's order.

``orderBy(...).limit(n)`` plans as TakeOrderedAndProject (each task keeps its
top n, the driver merges n·tasks rows), so the cap never sorts the full table
on one node. The search filter commutes with the sort, and Catalyst pushes it
below the sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachlens.functions.python_regex import java_pattern
from breachlens.schema import BAND, KEY, PROB

SORTABLE = (PROB, "reassignment_count_max", "reopen_count_max", "total_events")
BASE_COLS = (KEY, PROB, BAND, "recommended_action")
OPTIONAL_COLS = ("priority", "assignment_group", "category", "subcategory", "total_events",
                 "reassignment_count_max", "reopen_count_max", "resolution_hours")
DEFAULT_MAX_ROWS = 500


def filter_bands(scored: DataFrame, bands: Sequence[str], band: str = BAND) -> DataFrame:
    """Keep rows whose band is selected; an empty selection keeps nothing."""
    if not bands:
        return scored.where(F.lit(False))
    return scored.where(F.col(band).isin(list(bands)))


def filter_min_prob(scored: DataFrame, min_prob: float, prob: str = PROB) -> DataFrame:
    return scored.where(F.col(prob) >= F.lit(float(min_prob)))


def search_incidents(scored: DataFrame, query: str | None, key: str = KEY, literal: bool = False) -> DataFrame:
    """Case-insensitive search in the ticket number; regex in Python's dialect by default, blank → no filter.

    A NULL ticket number never matches; a regex that can't be run is a ValueError.
    """
    q = (query or "").strip()
    if not q:
        return scored
    target = F.col(key).cast("string")
    if literal:
        return scored.where(F.contains(F.lower(target), F.lit(q.lower())))
    return scored.where(target.rlike(java_pattern(q)))


def incident_detail(scored: DataFrame, number: str, key: str = KEY) -> DataFrame:
    """The row of one incident (first match)."""
    return scored.where(F.col(key) == F.lit(number)).limit(1)


def sort_incidents(scored: DataFrame, sort_by: str = PROB, descending: bool = True, key: str = KEY) -> DataFrame:
    """Sort by one column, missing values last in both directions; ties by number.

    An absent sort column leaves the frame unsorted.
    """
    if sort_by not in scored.columns:
        return scored
    c = F.col(sort_by)
    primary = c.desc_nulls_last() if descending else c.asc_nulls_last()
    tie = [] if sort_by == key else [F.col(key).asc_nulls_last()]
    return scored.orderBy(primary, *tie)


def list_columns(df: DataFrame) -> list[str]:
    return [c for c in (*BASE_COLS, *OPTIONAL_COLS) if c in df.columns]


def incident_list(scored: DataFrame, bands: Sequence[str] = ("High", "Medium", "Low"), min_prob: float = 0.0,
                  sort_by: str = PROB, descending: bool = True, query: str | None = None,
                  max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    view = filter_min_prob(filter_bands(scored, bands), min_prob)
    view = sort_incidents(view, sort_by, descending)
    view = search_incidents(view, query)
    return view.limit(int(max_rows)).select(*list_columns(view))


def incident_list_count(scored: DataFrame, bands: Sequence[str] = ("High", "Medium", "Low"),
                        min_prob: float = 0.0, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """Displayed result count: min(rows after band/probability filters, cap).

    The search box is deliberately not applied here, as in the dashboard.
    """
    view = filter_min_prob(filter_bands(scored, bands), min_prob)
    return view.agg(F.least(F.count(F.lit(1)), F.lit(int(max_rows)).cast("bigint")).alias("results"))


__all__ = ["filter_bands", "filter_min_prob", "search_incidents", "incident_detail", "sort_incidents",
           "incident_list", "incident_list_count", "list_columns", "SORTABLE", "DEFAULT_MAX_ROWS"]
