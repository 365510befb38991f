"""Batches of analysis and check requests, from uploads to results.

All requests are routed at once: upload, chosen or effective configuration, chosen or active
baseline, specification. A lookup that fails is the reason in the request's own row, and only
what is left is analysed, on measurements that are read and narrowed once. Requests of one
context with the same configuration (or baseline) share one analysis.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.compare import StatusThresholds
from gaugeline.operators.effective import active_baselines, effective_configurations, effective_specifications
from gaugeline.operators.layout import materialize, small
from gaugeline.operators.quality import blank_to_null
from gaugeline.operators.rules import decode_ruleset
from gaugeline.plans.analysis import Analysis, analysis_runs, analyze, requested_rows
from gaugeline.plans.check import Check, run_check
from gaugeline.schema import CONTEXT, SCOPE

CONFIGURED = ("chart_type", "subgroup_size", "subgroup_method", "maximum_time_gap_seconds", "minimum_sample_size", "ruleset")


@dataclass(frozen=True)
class RequestedAnalyses:
    """``requests`` has one row per request: COMPLETED, FAILED or REFUSED, and why.

    ``ctx`` of the analysis holds the context and, as ``choice``, the configuration.
    """

    requests: DataFrame
    analysis: Analysis


@dataclass(frozen=True)
class RequestedChecks:
    """``requests`` has one row per request; ``ctx`` of the check holds the context and the baseline as ``choice``."""

    requests: DataFrame
    check: Check


def upload_refusal(upload_type: str, known: Column, status: Column, kind: Column) -> Column:
    """Why an upload cannot serve a request, NULL when it can."""
    return (
        F.when(known.isNull(), "UPLOAD_NOT_FOUND")
        .when(~F.coalesce(status == "SILVER_COMPLETED", F.lit(False)), "UPLOAD_NOT_READY")
        .when(~F.coalesce(kind == upload_type, F.lit(False)), "WRONG_UPLOAD_TYPE")
    )


def route(requests: DataFrame, uploads: DataFrame, upload_type: str, chosen: str) -> DataFrame:
    """Requests with the refusal of their upload; blank scope fields and choices are absent."""
    named = requests.select(
        "request_id", "upload_id", "parameter_id", *[blank_to_null(F.col(c)).alias(c) for c in SCOPE],
        (blank_to_null(F.col(chosen)) if chosen in requests.columns else F.lit(None).cast("string")).alias("chosen"),
    )
    state = uploads.select("upload_id", F.lit(True).alias("_known"), F.col("status").alias("_status"), F.col("upload_type").alias("_type"))
    refusal = upload_refusal(upload_type, F.col("_known"), F.col("_status"), F.col("_type"))
    return named.join(state, "upload_id", "left").withColumn("refusal", refusal).drop("_known", "_status", "_type")


def _scope(df: DataFrame) -> DataFrame:
    """Distinct contexts of the requests that are still in."""
    return df.filter("refusal IS NULL").select(*CONTEXT).distinct()


def _looked_up(plan: DataFrame, by_id: DataFrame, by_context: DataFrame, key: str, missing: str) -> DataFrame:
    """Add the row a request names, or else the one of its context; a request without one is refused.

    ``by_id`` has one row per ``key``, ``by_context`` one per ``ctx``, with the same other columns.
    """
    found = [c for c in by_id.columns if c != key]
    ctx = F.struct(*CONTEXT)
    asked = plan.withColumn("ctx", ctx)
    named = asked.filter("chosen IS NOT NULL").join(by_id.withColumnRenamed(key, "_key"), F.col("chosen") == F.col("_key"), "left")
    named = named.withColumnRenamed("_key", key)
    usual = asked.filter("chosen IS NULL").join(by_context, "ctx", "left")
    columns = [*plan.columns, key, *found]
    both = named.select(*columns).unionByName(usual.select(*columns))
    return both.withColumn("refusal", F.coalesce("refusal", F.when(F.col(key).isNull(), missing)))


def _configurations(plan: DataFrame, configurations: DataFrame, by_id: bool) -> DataFrame:
    if dict(configurations.dtypes)["ruleset"] == "string":
        configurations = configurations.withColumn("ruleset", decode_ruleset(F.col("ruleset")))
    effective = effective_configurations(_scope(plan), configurations)
    effective = effective.select(F.struct(*CONTEXT).alias("ctx"), "spc_configuration_id", *CONFIGURED)
    listed = configurations.select("spc_configuration_id", *CONFIGURED)
    if by_id:
        return _looked_up(plan, small(listed), effective, "spc_configuration_id", "MISSING_CONFIGURATION")
    joined = plan.withColumn("ctx", F.struct(*CONTEXT)).join(effective, "ctx", "left").drop("ctx")
    missing = F.when(F.col("spc_configuration_id").isNull(), "MISSING_CONFIGURATION")
    return joined.withColumn("refusal", F.coalesce("refusal", missing))


def _analysed(measurements: DataFrame, plan: DataFrame, specifications: DataFrame, as_of, options: dict) -> Analysis:
    """Analysis of the units of a written plan; a unit is a context with a ``choice``."""
    kept = plan.filter("refusal IS NULL")
    spec = effective_specifications(_scope(plan), specifications, as_of).select(
        F.struct(*CONTEXT).alias("_own"), "specification_id", "lsl", "usl", "target"
    )
    units = kept.select(F.struct(*CONTEXT).alias("_own"), F.struct(*CONTEXT, "choice").alias("ctx"), "spc_configuration_id",
                        F.col("chart_type").alias("configured_chart"), *CONFIGURED[1:]).dropDuplicates(["ctx"])
    settings = materialize(units.join(spec, "_own", "left"), "units")
    asked = requested_rows(measurements, kept.select(*CONTEXT)).withColumnRenamed("ctx", "_own")
    rows = asked.join(small(settings.select("_own", "ctx")), "_own").drop("_own")
    # The store is read once; profile and sequence read what the requests need of it.
    rows = materialize(rows, "requested")
    return analyze(rows, settings.drop("_own"), asked=settings.select("ctx"), **options)


def run_analyses(
    requests: DataFrame, uploads: DataFrame, measurements: DataFrame, configurations: DataFrame, specifications: DataFrame,
    as_of, **options,
) -> RequestedAnalyses:
    """Historical analyses for ``requests`` (``request_id``, ``upload_id``, the context, and
    ``spc_configuration_id`` where a configuration is chosen).

    Refusals in the order they are looked for: UPLOAD_NOT_FOUND, UPLOAD_NOT_READY,
    WRONG_UPLOAD_TYPE, MISSING_CONFIGURATION, NO_MEASUREMENTS.
    """
    plan = _configurations(route(requests, uploads, "HISTORICAL", "spc_configuration_id"), configurations, by_id=True)
    plan = materialize(plan.withColumn("choice", F.col("spc_configuration_id")), "plan")
    analysis = _analysed(measurements, plan, specifications, as_of, options)
    runs = analysis_runs(analysis).select(
        "ctx", F.col("chart_type").alias("_chart"), F.col("status").alias("_status"), "error_code", "error_message"
    )
    joined = plan.withColumn("ctx", F.struct(*CONTEXT, "choice")).join(runs, "ctx", "left")
    refused = F.coalesce("refusal", F.when(F.col("error_code") == "NO_MEASUREMENTS", F.col("error_code")))
    return RequestedAnalyses(
        joined.select(
            "request_id", "upload_id", *CONTEXT, "spc_configuration_id",
            F.when(refused.isNotNull(), "REFUSED").otherwise(F.col("_status")).alias("status"),
            F.coalesce(refused, "error_code").alias("reason"), F.when(refused.isNull(), F.col("error_message")).alias("message"),
            F.when(refused.isNull(), F.col("_chart")).alias("chart_type"),
        ),
        analysis,
    )


def run_checks(
    requests: DataFrame, uploads: DataFrame, measurements: DataFrame, baselines: DataFrame, configurations: DataFrame,
    specifications: DataFrame, as_of, thresholds: StatusThresholds = StatusThresholds(), **options,
) -> RequestedChecks:
    """Manual checks for ``requests`` (``request_id``, ``upload_id``, the context, and
    ``baseline_id`` where a baseline is chosen).

    Refusals in the order they are looked for: UPLOAD_NOT_FOUND, UPLOAD_NOT_READY,
    WRONG_UPLOAD_TYPE, MISSING_ACTIVE_BASELINE (a chosen one must be active too),
    MISSING_CONFIGURATION, NO_MEASUREMENTS. A baseline of another context or chart type fails
    the check that was started.
    """
    routed = route(requests, uploads, "CURRENT", "baseline_id")
    active = baselines.filter(F.col("status") == "ACTIVE")
    own = active_baselines(_scope(routed), baselines).select(F.struct(*CONTEXT).alias("ctx"), "baseline_id")
    plan = _looked_up(routed, active.select("baseline_id"), own, "baseline_id", "MISSING_ACTIVE_BASELINE")
    plan = _configurations(plan, configurations, by_id=False)
    plan = materialize(plan.withColumn("choice", F.col("baseline_id")), "plan")
    analysis = _analysed(measurements, plan, specifications, as_of, options)
    named = plan.filter("refusal IS NULL").select(F.struct(*CONTEXT, "choice").alias("ctx"), "baseline_id").distinct()
    check = run_check(analysis, baselines, thresholds, named)
    done = check.checks.select("ctx", "failure", "final_status", "mismatches")
    joined = plan.withColumn("ctx", F.struct(*CONTEXT, "choice")).join(done, "ctx", "left")
    refused = F.coalesce("refusal", F.when(F.col("failure") == "NO_MEASUREMENTS", F.col("failure")))
    return RequestedChecks(
        joined.select(
            "request_id", "upload_id", *CONTEXT, "baseline_id", "spc_configuration_id",
            F.when(refused.isNotNull(), "REFUSED").when(F.col("failure").isNotNull(), "FAILED").otherwise("COMPLETED").alias("status"),
            F.coalesce(refused, "failure").alias("reason"), "mismatches", "final_status",
        ),
        check,
    )
