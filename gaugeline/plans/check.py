"""Manual check: current data judged against frozen baseline limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.compare import StatusThresholds, compare, final_status, finding_messages, findings
from gaugeline.operators.layout import attach, materialize, small
from gaugeline.operators.rules import hit_totals, judge, violations
from gaugeline.plans.analysis import Analysis
from gaugeline.schema import CONTEXT, POINT_OUTSIDE

COMPARED = ("mean", "within_sigma", "overall_sigma", "cp", "cpk", "pp", "ppk")


@dataclass(frozen=True)
class Check:
    """``checks`` has one row per context with a verdict or the reason there is none."""

    checks: DataFrame
    violations: DataFrame
    findings: DataFrame

    @property
    def alerts(self) -> DataFrame:
        return raise_alerts(self.findings)


def mismatches(baseline: str = "baseline_", context: Column | None = None) -> Column:
    """Names of the context parts in which a baseline differs from the current run."""
    parts = (("parameter_id", "parameter"), ("machine_id", "machine"), ("product_id", "product"),
             ("operation_id", "operation"), ("chart_type", "chart type"))
    return F.array_compact(
        F.array(*[F.when(~F.col(f"{baseline}{c}").eqNullSafe(F.col(c)), F.lit(label)) for c, label in parts])
    )


def run_check(
    analysis: Analysis,
    baselines: DataFrame,
    thresholds: StatusThresholds = StatusThresholds(),
    named: DataFrame | None = None,
) -> Check:
    """Judge every analysed context against its active baseline.

    ``named`` maps ``ctx`` to a chosen ``baseline_id``; without it the active
    baseline of exactly the same context is used.
    """
    # Summary and points are both needed, so the judged points are written once.
    analysis = analysis.saved()
    active = baselines.filter(F.col("status") == "ACTIVE")
    chosen = active.select(
        F.struct(*CONTEXT).alias("_own"), "baseline_id",
        *[F.col(c).alias(f"baseline_{c}") for c in (*CONTEXT, "chart_type", *COMPARED)],
        F.col("center_line").alias("_cl"), F.col("ucl").alias("_ucl"), F.col("lcl").alias("_lcl"),
    )
    if named is None:
        chosen = chosen.withColumnRenamed("_own", "ctx")
    else:
        chosen = chosen.drop("_own").join(named, "baseline_id")
    summary = analysis.summary.select(
        "ctx", F.col("ctx.*"), "chart_type", "error_code", "point_count", "stability_status", "ruleset",
        *[F.col(c).alias(f"current_{c}") for c in ("mean", "within_sigma", "overall_sigma", "cp", "cpk", "pp", "ppk")],
    )
    current = summary.join(chosen, "ctx", "left").withColumn(
        "mismatches", F.when(F.col("baseline_id").isNotNull(), mismatches())
    )
    current = materialize(
        current.withColumn(
            "failure",
            F.when(F.col("error_code").isNotNull(), F.col("error_code"))
            .when(F.col("baseline_id").isNull(), "MISSING_ACTIVE_BASELINE")
            .when(F.size("mismatches") > 0, "BASELINE_CONTEXT_MISMATCH"),
        ),
        "current",
    )
    frozen = current.filter(F.col("failure").isNull()).select(
        "ctx", F.col("baseline_chart_type").alias("chart_type"), F.col("_cl").alias("center_line"),
        F.col("_ucl").alias("ucl"), F.col("_lcl").alias("lcl"), F.col("point_count").alias("_length"),
    )
    points = analysis.points.select("ctx", "point_number", "mean", "ruleset")
    judged = judge(attach(points, frozen, analysis.layout, "point_number", "_length", keep_length=False),
                   analysis.layout)
    counts = judged.groupBy("ctx").agg(*[total.alias(n) for n, total in hit_totals().items()])
    checks = current.join(counts, "ctx", "left")
    ok = F.col("failure").isNull()
    checks = compare(checks)
    checks = checks.withColumns(
        {"final_status": F.when(ok, final_status(thresholds)), "status": F.when(ok, "COMPLETED").otherwise("FAILED")}
    ).drop("_cl", "_ucl", "_lcl", "ruleset")
    checks = materialize(checks, "checks")
    found = findings(checks.filter(ok), ["ctx", "final_status"])
    return Check(checks, violations(judged), found)


def affected_indices(found: DataFrame) -> DataFrame:
    """Indices of points outside the frozen limits, one row each.

    They belong to the limit-violation finding of their context; a long table
    holds them however many there are.
    """
    return found.filter(F.col("rule_name") == POINT_OUTSIDE).select("ctx", F.col("start_index").alias("affected_index"))


def raise_alerts(found: DataFrame) -> DataFrame:
    """An OPEN alert for each serious finding of a check that ended out of control."""
    serious = found.filter(
        F.col("final_status").isin("OUT_OF_CONTROL", "CRITICAL") & F.col("severity").isin("CRITICAL", "WARNING")
    )
    return serious.withColumn("status", F.lit("OPEN"))


def alert_texts(alerts: DataFrame) -> DataFrame:
    return finding_messages(alerts)


def eligible_uploads(uploads: DataFrame, upload_type: str) -> DataFrame:
    """Uploads that finished loading and have the wanted type."""
    return uploads.filter((F.col("status") == "SILVER_COMPLETED") & (F.col("upload_type") == upload_type))


def restrict_to_uploads(measurements: DataFrame, uploads: DataFrame) -> DataFrame:
    return measurements.join(small(uploads.select("upload_id").distinct()), "upload_id", "left_semi")
