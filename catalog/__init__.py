"""Runnable queries over the given tables, each next to its SQL equivalent."""

from catalog import charts, flows, ingestion, reports, statistics, subgroups  # noqa: F401
from catalog.registry import ORACLE, QUERIES  # noqa: F401
