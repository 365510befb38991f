"""Append-only upload and alert events and their current state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.schema import UPLOAD_STATUSES

FINISHED = ("SILVER_COMPLETED", "FAILED")


def check_statuses(events: DataFrame) -> DataFrame:
    """Split off events with a status outside the known list."""
    return events.withColumn("accepted", F.coalesce(F.col("status").isin(*UPLOAD_STATUSES), F.lit(False)))


def upload_state(events: DataFrame) -> DataFrame:
    """Latest state per upload from its status and row-count events.

    Every event has ``upload_id`` and an increasing ``event_seq``. ``status`` is
    NULL on count events; a count is kept until a later event replaces it.
    """
    moved = F.col("status").isNotNull() & F.col("status").isin(*UPLOAD_STATUSES)
    at = F.col("event_seq")

    def latest(value, when):
        return F.max_by(value, F.when(when, at))

    counts = [c for c in ("total_rows", "valid_rows", "invalid_rows", "bronze_loaded", "silver_loaded")
              if c in events.columns]
    return events.groupBy("upload_id").agg(
        latest(F.col("status"), moved).alias("status"),
        latest(F.col("error_message"), moved).alias("error_message"),
        F.max_by("created_at", F.when(F.col("status").isin(*FINISHED), at)).alias("completed_at"),
        F.max("created_at").alias("updated_at"),
        *[latest(F.col(c), F.col(c).isNotNull()).alias(c) for c in (*counts, "upload_type") if c in events.columns],
        F.count_if(moved).alias("transitions"),
    )


def status_history(events: DataFrame, upload_id: str | None = None) -> DataFrame:
    rows = events.filter(F.col("status").isNotNull())
    if upload_id is not None:
        rows = rows.filter(F.col("upload_id") == upload_id)
    return rows.orderBy("created_at", "event_seq")


def alert_state(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Current alert status with the last actor and time of each kind of action.

    Events of alerts that do not exist are ignored.
    """
    at = F.struct("created_at", "event_id")

    def of(action, column):
        return F.max_by(column, F.when(F.col("action") == action, at))

    state = events.filter(F.col("action").isin("ACKNOWLEDGED", "RESOLVED")).groupBy("alert_id").agg(
        F.max_by("action", at).alias("_status"),
        of("ACKNOWLEDGED", "created_at").alias("acknowledged_at"),
        of("ACKNOWLEDGED", "actor").alias("acknowledged_by"),
        of("RESOLVED", "created_at").alias("resolved_at"),
        of("RESOLVED", "actor").alias("resolved_by"),
    )
    joined = alerts.join(state, "alert_id", "left")
    return joined.withColumn("status", F.coalesce("_status", "status")).drop("_status")
