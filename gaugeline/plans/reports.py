"""History, dashboards and assembled reports over the stored result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.capability import sigma_level
from gaugeline.operators.layout import BROADCAST_ROWS

STABLE = ("IN_CONTROL", "NORMAL")
CRITICAL = ("OUT_OF_CONTROL", "CRITICAL")
DASHBOARD_RUNS = 100
RECENT_ROWS = 10


def latest_results(results: DataFrame) -> DataFrame:
    """The newest result of each run."""
    return results.groupBy("analysis_id").agg(
        F.max_by(F.struct("cpk", "ppk", "stability_status"), F.struct("created_at", "result_id")).alias("_r")
    ).select("analysis_id", "_r.*")


def analysis_history(runs: DataFrame, results: DataFrame, limit: int | None = 50, **filters) -> DataFrame:
    """Newest runs with capability and stability of their latest result.

    The limit is applied before the join, so only the listed runs meet results.
    A short list is broadcast, a long one is left to the planner. Without a limit
    all runs are given, in no order.
    """
    for column, value in filters.items():
        if value is not None:
            runs = runs.filter(F.col(column) == value)
    if limit is None:
        return runs.join(latest_results(results), "analysis_id", "left")
    listed = runs.orderBy(F.desc("created_at"), "analysis_id").limit(limit)
    wanted = listed.select("analysis_id")
    wanted = F.broadcast(wanted) if limit <= BROADCAST_ROWS else wanted
    mine = results.join(wanted, "analysis_id", "left_semi")
    return listed.join(latest_results(mine), "analysis_id", "left")


def check_history(checks: DataFrame, comparisons: DataFrame, limit: int | None = 50, **filters) -> DataFrame:
    for column, value in filters.items():
        if value is not None:
            checks = checks.filter(F.col(column) == value)
    listed = checks if limit is None else checks.orderBy(F.desc("created_at"), "manual_check_id").limit(limit)
    found = comparisons.select("manual_check_id", "current_cpk", "current_ppk")
    return listed.join(found, "manual_check_id", "left")


def merged_rows(analyses: DataFrame, checks: DataFrame) -> DataFrame:
    """Analyses and checks in one shape; the verdict stands in for the run status."""
    shared = ["organization_id", "plant_id", "machine_id", "product_id", "operation_id", "parameter_id"]

    def keep(df):
        return [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in shared]

    historical = analyses.select(
        F.col("analysis_id").alias("id"), F.lit("HISTORICAL").alias("type"), *keep(analyses), "chart_type", "cpk",
        F.coalesce("stability_status", "status").alias("status"), "created_at",
    )
    monitoring = checks.select(
        F.col("manual_check_id").alias("id"), F.lit("MONITORING").alias("type"), *keep(checks),
        F.lit(None).cast("string").alias("chart_type"), F.col("current_cpk").alias("cpk"),
        F.coalesce("final_status", "status").alias("status"), "created_at",
    )
    return historical.unionByName(monitoring)


def recent_rows(analyses: DataFrame, checks: DataFrame, limit: int = RECENT_ROWS) -> DataFrame:
    return merged_rows(analyses, checks).orderBy(F.desc("created_at"), "id").limit(limit)


def dashboard_counts(analyses: DataFrame, checks: DataFrame) -> DataFrame:
    """Counts by verdict; the inputs are already limited to their latest runs."""
    status = F.col("status")
    return merged_rows(analyses, checks).agg(
        F.count_if(status.isin(*STABLE)).alias("stable_count"),
        F.count_if(status == "WARNING").alias("warning_count"),
        F.count_if(status.isin(*CRITICAL)).alias("critical_count"),
        F.count("*").alias("total_analyses"),
    )


def analysis_report(
    runs: DataFrame, results: DataFrame, violations: DataFrame, parameters: DataFrame
) -> DataFrame:
    """Run, result, unit and violation counts per analysis; sigma levels are derived again.

    The violations themselves stay in their long table, which ``report_violations`` lists.
    """
    counted = violations.groupBy("analysis_id").agg(
        F.count("*").alias("violation_count"), F.min("start_index").alias("first_violation_index")
    )
    short, long = sigma_level(F.col("cpk"))
    unit = parameters.select("parameter_id", "unit")
    return (
        runs.join(results.drop("created_at"), "analysis_id")
        .join(counted, "analysis_id", "left")
        .join(unit, "parameter_id", "left")
        .withColumns(
            {
                "unit": F.coalesce("unit", F.lit("")),
                "violation_count": F.coalesce("violation_count", F.lit(0)),
                "sigma_level_short_term": short,
                "sigma_level_long_term": long,
                "has_specification": F.col("lsl").isNotNull() | F.col("usl").isNotNull(),
                "has_secondary_chart": F.col("secondary_center_line").isNotNull(),
            }
        )
    )


def report_violations(reports: DataFrame, violations: DataFrame, owner: str = "analysis_id") -> DataFrame:
    """Violations of the reports on display, in report and start order."""
    return violations.join(reports.select(owner), owner, "left_semi").orderBy(owner, "start_index")


def check_report(
    checks: DataFrame,
    baselines: DataFrame,
    results: DataFrame,
    comparisons: DataFrame,
    violations: DataFrame,
    findings: DataFrame,
    parameters: DataFrame,
) -> DataFrame:
    """Run, baseline, current result, comparison, findings, violation count and unit per check.

    A check has at most eight findings, so they fit in one array.
    """
    found = violations.groupBy("manual_check_id").agg(F.count("*").alias("violation_count"))
    listed = findings.groupBy("manual_check_id").agg(
        F.sort_array(F.collect_list(F.struct("finding_number", "finding_type", "severity"))).alias("findings")
    )
    base = baselines.select(
        "baseline_id",
        *[F.col(c).alias(f"baseline_{c}") for c in
          ("mean", "center_line", "ucl", "lcl", "within_sigma", "overall_sigma", "cp", "cpk", "pp", "ppk", "unit",
           "chart_type")],
        "lsl", "usl", "target",
    )
    current = results.select(
        F.col("analysis_id").alias("current_analysis_id"),
        *[F.col(c).alias(f"current_{c}") for c in
          ("mean", "within_sigma", "overall_sigma", "cp", "cpk", "pp", "ppk", "center_line", "ucl", "lcl")],
    )
    deltas = comparisons.select(
        "manual_check_id", "mean_shift", "mean_shift_percentage", "within_variation_change_percentage",
        "overall_variation_change_percentage", "cpk_change", "ppk_change", "mean_shift_detected",
        "variation_increase_detected", "variation_reduction_detected", "capability_improvement_detected",
        "capability_degradation_detected",
    )
    flags = [c for c in deltas.columns if c.endswith("_detected")]
    units = parameters.select("parameter_id", F.col("unit").alias("_unit"))
    return (
        checks.join(base, "baseline_id", "left")
        .join(current, "current_analysis_id", "left")
        .join(deltas, "manual_check_id", "left")
        .join(found, "manual_check_id", "left")
        .join(listed, "manual_check_id", "left")
        .join(units, "parameter_id", "left")
        .withColumns(
            {
                "unit": F.coalesce("_unit", "baseline_unit", F.lit("")),
                "final_status": F.coalesce("final_status", F.lit("NORMAL")),
                "mean_shift": F.coalesce("mean_shift", F.lit(0.0)),
                "violation_count": F.coalesce("violation_count", F.lit(0)),
                **{c: F.coalesce(c, F.lit(False)) for c in flags},
            }
        )
        .drop("_unit", "baseline_unit")
    )
