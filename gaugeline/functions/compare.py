"""Comparison of current statistics with a frozen baseline, findings and final status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.text import significant

# A change beyond these counts as detected.
SHIFT_SIGMAS = 1.0
VARIATION_PERCENT = 10.0
CAPABILITY_STEP = 0.2


@dataclass(frozen=True)
class StatusThresholds:
    critical_violation_count: int = 2
    critical_cpk_change: float = -0.5
    critical_cpk_absolute: float = 1.00
    warning_cpk_absolute: float = 1.33


def percent_change(current: Column, baseline: Column) -> Column:
    return (current - baseline) / F.nullif(F.abs(baseline), F.lit(0.0)) * 100


def compare(df: DataFrame) -> DataFrame:
    """Add deltas and detection flags from ``baseline_*`` and ``current_*`` columns."""
    b = {c: F.col(f"baseline_{c}") for c in ("mean", "within_sigma", "overall_sigma", "cpk", "ppk")}
    c = {name: F.col(f"current_{name}") for name in b}
    shift = c["mean"] - b["mean"]
    within_percent = percent_change(c["within_sigma"], b["within_sigma"])
    cpk_change = c["cpk"] - b["cpk"]

    def flag(condition):
        return F.coalesce(condition, F.lit(False))

    return df.withColumns(
        {
            "mean_shift": shift,
            "mean_shift_percentage": percent_change(c["mean"], b["mean"]),
            "within_variation_change": c["within_sigma"] - b["within_sigma"],
            "within_variation_change_percentage": within_percent,
            "overall_variation_change": c["overall_sigma"] - b["overall_sigma"],
            "overall_variation_change_percentage": percent_change(c["overall_sigma"], b["overall_sigma"]),
            "cpk_change": cpk_change,
            "ppk_change": c["ppk"] - b["ppk"],
            "mean_shift_detected": flag(
                (b["within_sigma"] > 0) & (F.abs(shift) >= SHIFT_SIGMAS * b["within_sigma"])
            ),
            "variation_increase_detected": flag(within_percent >= VARIATION_PERCENT),
            "variation_reduction_detected": flag(within_percent <= -VARIATION_PERCENT),
            "capability_improvement_detected": flag(cpk_change >= CAPABILITY_STEP),
            "capability_degradation_detected": flag(cpk_change <= -CAPABILITY_STEP),
            "new_limit_violations_detected": F.col("point_violations") > 0,
        }
    )


def final_status(thresholds: StatusThresholds = StatusThresholds()) -> Column:
    """Overall verdict from comparison flags and violation counts."""
    points = F.col("point_violations") > 0
    worse = F.col("capability_degradation_detected")
    cpk = F.col("current_cpk")

    def one(condition):
        return F.coalesce(condition, F.lit(False)).cast("int")

    severe = (
        one(points)
        + one(worse & (cpk < thresholds.critical_cpk_absolute))
        + one(worse & (F.col("cpk_change") <= thresholds.critical_cpk_change))
        + one(F.col("mean_shift_detected") & F.col("variation_increase_detected"))
    )
    warning = (
        F.col("mean_shift_detected")
        | F.col("variation_increase_detected")
        | worse
        | (F.col("trend_violations") + F.col("shift_violations") > 0)
    )
    return (
        F.when(severe >= thresholds.critical_violation_count, "CRITICAL")
        .when(points, "OUT_OF_CONTROL")
        .when(warning, "WARNING")
        .when(cpk < thresholds.warning_cpk_absolute, "WARNING")
        .otherwise("NORMAL")
    )


def _finding(kind: str, severity: str, *fact: str) -> Column:
    numbers = [F.col(c).alias(c) for c in fact]
    text = F.to_json(F.struct(*numbers), {"ignoreNullFields": "false"}) if fact else F.lit("{}")
    return F.struct(F.lit(kind).alias("finding_type"), F.lit(severity).alias("severity"), text.alias("statistical_fact"))


def findings(checks: DataFrame, ids: list[str]) -> DataFrame:
    """One row per finding of each compared check, PROCESS_STABLE when nothing stands out."""
    mean = ("baseline_mean", "current_mean", "mean_shift", "mean_shift_percentage")
    sigma = ("baseline_within_sigma", "current_within_sigma", "within_variation_change_percentage")
    cpk = ("baseline_cpk", "current_cpk", "cpk_change")

    def counted(kind, severity, column):
        fact = F.to_json(F.struct(F.col(column).alias("violation_count")))
        return F.struct(
            F.lit(kind).alias("finding_type"), F.lit(severity).alias("severity"), fact.alias("statistical_fact")
        )

    listed = F.array_compact(
        F.array(
            F.when(F.col("mean_shift_detected"), _finding("MEAN_SHIFT", "WARNING", *mean)),
            F.when(F.col("variation_increase_detected"), _finding("VARIATION_INCREASE", "WARNING", *sigma)),
            F.when(F.col("variation_reduction_detected"), _finding("VARIATION_REDUCTION", "INFO", *sigma)),
            F.when(F.col("capability_degradation_detected"), _finding("CAPABILITY_DEGRADATION", "WARNING", *cpk)),
            F.when(F.col("capability_improvement_detected"), _finding("CAPABILITY_IMPROVEMENT", "INFO", *cpk)),
            F.when(F.col("point_violations") > 0, counted("NEW_LIMIT_VIOLATION", "CRITICAL", "point_violations")),
            F.when(F.col("trend_violations") > 0, counted("TREND_DETECTED", "WARNING", "trend_violations")),
            F.when(F.col("shift_violations") > 0, counted("SHIFT_DETECTED", "WARNING", "shift_violations")),
        )
    )
    listed = F.when(F.size(listed) > 0, listed).otherwise(F.array(_finding("PROCESS_STABLE", "INFO")))
    numbers = [*mean[:3], *sigma, "baseline_cpk", "current_cpk",
               "point_violations", "trend_violations", "shift_violations"]
    return checks.select(*ids, *numbers, F.posexplode(listed).alias("finding_number", "_f")).select(
        *ids, F.col("finding_number").cast("long").alias("finding_number"), "_f.*", *numbers
    )


def finding_messages(found: DataFrame) -> DataFrame:
    """Add the text of each finding; only finding rows are formatted."""
    kind = F.col("finding_type")
    shown = {
        c: significant(F.abs(F.col(c)) if c == "mean_shift" else F.col(c), 4)
        for c in ("mean_shift", "baseline_mean", "current_mean", "baseline_within_sigma", "current_within_sigma",
                  "within_variation_change_percentage", "baseline_cpk", "current_cpk")
    }
    df = found.withColumns({f"_{c}": text for c, text in shown.items()})
    t = {c: F.col(f"_{c}") for c in shown}

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def variation(verb):
        return text(
            f"Process variation (within-subgroup sigma) {verb} from ", t["baseline_within_sigma"], " to ",
            t["current_within_sigma"], " (", t["within_variation_change_percentage"], "%).",
        )

    def capability(verb):
        return text(f"Process capability (Cpk) {verb} from ", t["baseline_cpk"], " to ", t["current_cpk"], ".")

    def number(column):
        return F.col(column).cast("string")

    direction = F.when(F.col("mean_shift") > 0, "upward").otherwise("downward")
    message = (
        F.when(
            kind == "MEAN_SHIFT",
            text("Process mean shifted ", direction, " by ", t["mean_shift"], " (from ", t["baseline_mean"], " to ",
                 t["current_mean"], ")."),
        )
        .when(kind == "VARIATION_INCREASE", variation("increased"))
        .when(kind == "VARIATION_REDUCTION", variation("decreased"))
        .when(kind == "CAPABILITY_DEGRADATION", capability("decreased"))
        .when(kind == "CAPABILITY_IMPROVEMENT", capability("improved"))
        .when(
            kind == "NEW_LIMIT_VIOLATION",
            text(number("point_violations"),
                 " point(s) in the new dataset fall outside the fixed historical baseline control limits."),
        )
        .when(
            kind == "TREND_DETECTED",
            text(number("trend_violations"), " trend pattern(s) detected against the historical baseline."),
        )
        .when(
            kind == "SHIFT_DETECTED",
            text(number("shift_violations"),
                 " sustained run(s) on one side of the historical baseline center line detected."),
        )
        .otherwise("No significant deviation from the historical baseline was detected.")
    )
    return df.withColumn("message", message).drop(*[f"_{c}" for c in shown])


def metric_table(checks: DataFrame, ids: list[str]) -> DataFrame:
    """Metric, baseline, current, change and interpretation in long form."""

    def row(order, label, name, change=None, reading=None):
        base, now = F.col(f"baseline_{name}"), F.col(f"current_{name}")
        return F.struct(
            F.lit(order).alias("metric_order"),
            F.lit(label).alias("metric"),
            base.alias("baseline_value"),
            now.alias("current_value"),
            (F.col(change) if change else now - base).alias("change"),
            (reading if reading is not None else F.lit(None).cast("string")).alias("interpretation"),
        )

    def better(worse, improved):
        return F.when(F.col(worse), "decreased").when(F.col(improved), "improved").otherwise("none")

    rows = F.array(
        row(1, "Mean", "mean", "mean_shift", F.when(F.col("mean_shift_detected"), "shifted").otherwise("none")),
        row(2, "Within Sigma", "within_sigma", None,
            better("variation_increase_detected", "variation_reduction_detected")),
        row(3, "Overall Sigma", "overall_sigma"),
        row(4, "Cp", "cp"),
        row(5, "Cpk", "cpk", "cpk_change",
            better("capability_degradation_detected", "capability_improvement_detected")),
        row(6, "Pp", "pp"),
        row(7, "Ppk", "ppk", "ppk_change"),
    )
    return checks.select(*ids, F.explode(rows).alias("_r")).select(*ids, "_r.*")
