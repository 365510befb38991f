"""Filtered, ordered, limited listings of the metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HISTORY_LIMIT, HISTORY_CAP = 50, 200
LIST_LIMIT, LIST_CAP = 100, 500
PAGE_ROWS = 15


def newest(df: DataFrame, filters: dict | None = None, limit: int = LIST_LIMIT, tie: str | None = None) -> DataFrame:
    """Rows equal to every given filter, newest first. An absent filter is skipped.

    Equal times are ordered by ``tie``, so the cut at the limit is repeatable.
    """
    for column, value in (filters or {}).items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    order = [F.desc("created_at"), *([F.asc(tie)] if tie else [])]
    return df.orderBy(*order).limit(limit)


def oldest(df: DataFrame, filters: dict, tie: str) -> DataFrame:
    for column, value in filters.items():
        df = df.filter(F.col(column) == value)
    return df.orderBy("created_at", tie)


def violations_of(found: DataFrame, owner: str, owner_id: str) -> DataFrame:
    return found.filter(F.col(owner) == owner_id).orderBy("start_index")


def active_dimension(df: DataFrame, parent: dict | None = None, order=("name",), active: str = "active") -> DataFrame:
    """Active rows of a dimension under a parent, in name order or by sequence with missing last."""
    for column, value in (parent or {}).items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df.filter(F.col(active)).orderBy(*[F.asc_nulls_last(c) for c in order])


def specifications_of(specifications: DataFrame, parameter_id: str) -> DataFrame:
    return specifications.filter(F.col("parameter_id") == parameter_id).orderBy(F.desc("effective_from"))


def history_page(
    rows: DataFrame, kind: str = "ALL", status: str = "ALL", search: str = "", page: int = 1, size: int = PAGE_ROWS
) -> DataFrame:
    """One page of merged history rows by type, status and part of the id."""
    if kind != "ALL":
        rows = rows.filter(F.col("type") == kind)
    if status != "ALL":
        rows = rows.filter(F.col("status") == status)
    if search.strip():
        rows = rows.filter(F.contains(F.lower("id"), F.lit(search.strip().lower())))
    return rows.orderBy(F.desc("created_at"), "id").offset((page - 1) * size).limit(size)
