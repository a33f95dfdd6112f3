"""List views: search, facets, default orders and pages of results, each one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(table: DataFrame, words: str, columns: list[str]) -> DataFrame:
    """Rows in which every word is found in one of the columns, in any case. No words: all rows."""
    for word in words.split():
        hit = reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c)), F.lit(word.lower())), F.lit(False)) for c in columns))
        table = table.where(hit)
    return table


def facet_values(table: DataFrame, column: str) -> DataFrame:
    return table.select(column).distinct()


def date_facet(column: Column, today: str, bucket: str) -> Column:
    """any, today, week (the last 7 days), month or year, against a given day."""
    day = F.to_date(F.lit(today))
    d = F.to_date(column)
    return {
        "any": F.lit(True), "today": d == day, "week": (d > F.date_sub(day, 7)) & (d <= day),
        "month": F.trunc(d, "month") == F.trunc(day, "month"), "year": F.year(d) == F.year(day),
    }[bucket]


def optional_filter(table: DataFrame, column: str, value: object | None) -> DataFrame:
    return table if value is None else table.where(F.col(column) == F.lit(value))


def default_order(table: DataFrame, *columns: str) -> DataFrame:
    """Ascending, nulls last."""
    return table.orderBy(*(F.col(c).asc_nulls_last() for c in columns))


def page_of(table: DataFrame, order: list[str], page: int, size: int = 100) -> DataFrame:
    return default_order(table, *order).offset((page - 1) * size).limit(size)
