"""Baselines: drafts from completed analyses, approval, supersession, archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.schema import SCOPE

FROZEN = (
    "mean", "within_sigma", "overall_sigma", "center_line", "ucl", "lcl", "secondary_center_line", "secondary_ucl",
    "secondary_lcl", "specification_id", "lsl", "usl", "target", "cp", "cpk", "pp", "ppk",
)
RUN_CONTEXT = (
    "organization_id", "plant_id", "production_line_id", "machine_id", "product_id", "process_id", "operation_id",
    "parameter_id", "chart_type",
)


def draft_rejection():
    """Why a run cannot become a draft, NULL when it can."""
    return (
        F.when(F.col("status") != "COMPLETED", "NOT_COMPLETED")
        .when(F.col("within_sigma").isNull() | F.col("overall_sigma").isNull(), "NO_SIGMA")
    )


def create_drafts(runs: DataFrame, results: DataFrame, parameters: DataFrame | None = None) -> DataFrame:
    """Freeze the result of each eligible run as a DRAFT baseline.

    Runs that are not eligible come back with ``rejection`` set and no baseline id.
    """
    results = results.select("analysis_id", "valid_observations", *FROZEN)
    joined = runs.join(results, "analysis_id", "left").withColumn(
        "rejection",
        F.coalesce(draft_rejection(), F.when(F.col("valid_observations").isNull(), "NO_RESULT")),
    )
    unit = F.lit("")
    if parameters is not None:
        joined = joined.join(parameters.select("parameter_id", F.col("unit").alias("_unit")), "parameter_id", "left")
        unit = F.coalesce("_unit", F.lit(""))
    present = [c for c in RUN_CONTEXT if c in joined.columns]
    ok = F.col("rejection").isNull()
    return joined.select(
        F.when(ok, F.concat(F.lit("B-"), F.col("analysis_id"))).alias("baseline_id"),
        "analysis_id",
        *present,
        unit.alias("unit"),
        F.col("valid_observations").alias("sample_count"),
        *FROZEN,
        F.when(ok, "DRAFT").alias("status"),
        F.lit(None).cast("string").alias("superseded_by_baseline_id"),
        "created_at",
        "rejection",
    )


def approve(baselines: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New version of the baseline table, and the approvals that were refused.

    Drafts approved for one context take effect in ``approved_at`` order: the last
    one becomes ACTIVE, earlier ones and the former ACTIVE one are SUPERSEDED by
    the next. Contexts compare with absent fields equal. Of several approvals of one
    draft the first counts, the others are refused.
    """
    kinds = dict(approvals.dtypes)
    turns = Window.partitionBy("baseline_id").orderBy(F.col("approved_at").asc_nulls_last(), "approved_by")
    approvals = approvals.withColumn("_turn", F.row_number().over(turns))
    for column, like in (("approved_at", "approved_at"), ("approved_by", "approved_by"), ("superseded_at", "approved_at")):
        if column not in baselines.columns:
            baselines = baselines.withColumn(column, F.lit(None).cast(kinds[like]))
    asked = baselines.join(
        approvals.filter("_turn = 1").select("baseline_id", F.col("approved_at").alias("_at"), F.col("approved_by").alias("_by")),
        "baseline_id", "left",
    )
    refused = (
        approvals.join(baselines.select("baseline_id", "status"), "baseline_id", "left")
        .filter((F.coalesce("status", F.lit("MISSING")) != "DRAFT") | (F.col("_turn") > 1))
        .select("baseline_id", F.coalesce("status", F.lit("MISSING")).alias("status"))
    )
    takes = (F.col("status") == "DRAFT") & F.col("_at").isNotNull()
    in_line = takes | (F.col("status") == "ACTIVE")
    turn = F.when(F.col("status") == "ACTIVE", F.lit(0)).otherwise(F.lit(1))
    scope = ["parameter_id", *SCOPE]
    # Only active baselines and approved drafts of a context meet in the window.
    w = Window.partitionBy(*scope).orderBy(turn, "_at", "baseline_id")
    changed = (
        asked.filter(in_line)
        .withColumns({"_next": F.lead("baseline_id").over(w), "_next_at": F.lead("_at").over(w)})
        .withColumn("_last_active", F.max(takes.cast("int")).over(Window.partitionBy(*scope)) == 0)
        .withColumns(
            {
                "approved_at": F.when(takes, F.col("_at")).otherwise(F.col("approved_at")),
                "approved_by": F.when(takes, F.col("_by")).otherwise(F.col("approved_by")),
                "status": F.when(F.col("_next").isNull() | F.col("_last_active"), "ACTIVE").otherwise("SUPERSEDED"),
                "superseded_by_baseline_id": F.when(
                    F.col("_next").isNotNull() & ~F.col("_last_active"), F.col("_next")
                ).otherwise(F.col("superseded_by_baseline_id")),
                "superseded_at": F.when(F.col("_next").isNotNull() & ~F.col("_last_active"), F.col("_next_at")).otherwise(
                    F.col("superseded_at")
                ),
            }
        )
        .drop("_next", "_next_at", "_last_active")
    )
    return changed.unionByName(asked.filter(~in_line)).drop("_at", "_by"), refused


def archive(baselines: DataFrame, baseline_ids: DataFrame) -> DataFrame:
    ids = baseline_ids.select("baseline_id").distinct().withColumn("_archived", F.lit(True))
    return baselines.join(ids, "baseline_id", "left").withColumn(
        "status", F.when(F.col("_archived"), "ARCHIVED").otherwise(F.col("status"))
    ).drop("_archived")
