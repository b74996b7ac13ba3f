"""Global one-row aggregates used as constants in row-level expressions.

Bounds and medians are aggregates over a whole table that later filters and
fallbacks read. Each is evaluated once as its own distributed job (partial
aggregation on every executor, one merged row) and only that row reaches the
driver; the value is then inlined as a literal. That is the same work as a
scalar subquery, but keeps every downstream plan flat: a subquery referenced
from several expressions is copied into each, and copies nest through the
pipeline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def one_row(df: DataFrame) -> Row:
    """The single row of a global aggregate (raises if there is not exactly one)."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected a one-row aggregate, got {len(rows)} rows")
    return rows[0]


def literal(value, type_name: str) -> Column:
    """A fetched scalar as a typed literal (NULL stays a typed NULL)."""
    return F.lit(value).cast(type_name)
