"""Stored tables of analyses and checks: fixed columns, and one owner a row.

An append takes rows in any column order, leaves out columns that the table does not have,
refuses a frame that lacks one, and puts rows without exactly one owner in a table beside
it, ``<path>_refused``, with the reason. Ids are made from the owner, so an append that is
repeated after a failure writes the same ids.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, NumericType, StructType

from gaugeline.functions.compare import finding_messages
from gaugeline.sources.tables import append

# Columns of the stored tables.
RESULTS = (
    "analysis_id string, total_observations long, valid_observations long, invalid_observations long, subgroup_count long, "
    "subgroup_size_used long, mean double, minimum double, maximum double, within_sigma double, overall_sigma double, "
    "center_line double, ucl double, lcl double, secondary_center_line double, secondary_ucl double, secondary_lcl double, "
    "specification_id string, lsl double, usl double, target double, cp double, cpk double, cpu double, cpl double, pp double, "
    "ppk double, ppu double, ppl double, stability_status string, warnings array<string>"
)
COMPARISONS = (
    "manual_check_id string, baseline_mean double, current_mean double, mean_shift double, mean_shift_percentage double, "
    "baseline_within_sigma double, current_within_sigma double, within_variation_change double, "
    "within_variation_change_percentage double, baseline_overall_sigma double, current_overall_sigma double, "
    "overall_variation_change double, overall_variation_change_percentage double, baseline_cpk double, current_cpk double, "
    "cpk_change double, baseline_ppk double, current_ppk double, ppk_change double, mean_shift_detected boolean, "
    "variation_increase_detected boolean, variation_reduction_detected boolean, capability_improvement_detected boolean, "
    "capability_degradation_detected boolean, new_limit_violations_detected boolean"
)
FINDINGS = (
    "finding_id string, analysis_id string, manual_check_id string, finding_type string, severity string, message string, "
    "statistical_fact string, created_at timestamp"
)
ALERTS = (
    "alert_id string, manual_check_id string, finding_id string, machine_id string, parameter_id string, severity string, "
    "message string, status string, created_at timestamp"
)
VIOLATIONS = (
    "violation_id string, analysis_id string, manual_check_id string, rule_name string, chart_type string, severity string, "
    "start_index long, end_index long, affected_points array<long>, message string, detected_at timestamp"
)
OWNERS = ("analysis_id", "manual_check_id")


class WrongColumns(ValueError):
    """Rows do not have the columns of the table they are meant for."""


def shaped(rows: DataFrame, schema: str) -> DataFrame:
    """The rows in the columns, types and order of a stored table; a number may be of another width."""
    table, given = StructType.fromDDL(schema), {f.name: f.dataType for f in rows.schema}
    numbers = {f.name for f in table if isinstance(f.dataType, NumericType) and isinstance(given.get(f.name), NumericType)}
    wrong = [
        f"{f.name} {given[f.name].simpleString()}" if f.name in given else f"no {f.name}"
        for f in table
        if f.name not in numbers and not isinstance(given.get(f.name), NullType)
        and (f.name not in given or given[f.name].simpleString() != f.dataType.simpleString())
    ]
    if wrong:
        raise WrongColumns(f"Columns do not fit the stored table: {', '.join(wrong)}.")
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table])


def append_owned(rows: DataFrame, path: str, schema: str, owners=OWNERS) -> int:
    """Append the rows with exactly one owner, set the others aside; how many were refused.

    The write counts the others, which are read a second time only if there are any.
    """
    rows = shaped(rows, schema)
    owned = reduce(add, [F.col(c).isNotNull().cast("int") for c in owners])
    seen = Observation()
    append(rows.observe(seen, F.count_if(owned != 1).alias("refused")).filter(owned == 1), path)
    refused = seen.get.get("refused", 0)
    if refused:
        reason = F.when(owned == 0, "NO_OWNER").otherwise("SEVERAL_OWNERS")
        append(rows.filter(owned != 1).withColumn("refusal", reason), f"{path.rstrip('/')}_refused")
    return refused


def _other_owner(rows: DataFrame) -> DataFrame:
    """Both owner columns, the absent one NULL."""
    return rows.withColumns({c: F.lit(None).cast("string") for c in OWNERS if c not in rows.columns})


def _id(prefix: str, *parts) -> Column:
    return F.concat_ws("-", F.lit(prefix), *parts)


def finding_rows(found: DataFrame) -> DataFrame:
    """Findings as stored: ``found`` names its owner; an owner has at most one finding of a type."""
    rows = _other_owner(finding_messages(found))
    return rows.withColumns(
        {"finding_id": _id("F", F.coalesce(*OWNERS), "finding_type"), "created_at": F.current_timestamp()}
    )


def alert_rows(alerts: DataFrame, machine_id="machine_id", parameter_id="parameter_id") -> DataFrame:
    """Alerts as stored, each with the finding it is raised for."""
    rows = finding_rows(alerts)
    return rows.withColumns(
        {"alert_id": _id("A", "manual_check_id", "finding_type"), "machine_id": F.col(machine_id), "parameter_id": F.col(parameter_id)}
    )


def violation_rows(found: DataFrame) -> DataFrame:
    return _other_owner(found).withColumns({"violation_id": F.expr("uuid()"), "detected_at": F.current_timestamp()})


def append_results(results: DataFrame, path: str) -> int:
    return append_owned(results, path, RESULTS, ["analysis_id"])


def append_chart_points(points: DataFrame, path: str) -> None:
    append(points, path)


def append_violations(found: DataFrame, path: str) -> int:
    return append_owned(violation_rows(found), path, VIOLATIONS)


def append_comparisons(checks: DataFrame, path: str) -> int:
    return append_owned(checks, path, COMPARISONS, ["manual_check_id"])


def append_findings(found: DataFrame, path: str) -> int:
    return append_owned(finding_rows(found), path, FINDINGS)


def append_alerts(alerts: DataFrame, path: str) -> int:
    return append_owned(alert_rows(alerts), path, ALERTS, ["manual_check_id"])
