"""Run rules over chart points, as run positions from window marks.

A run that reaches N points is reported and starts again at its last point, so
hits lie N-1 positions apart: position p of a run (from 0) is a hit when p > 0
and p is a multiple of N-1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.text import significant
from gaugeline.operators.layout import Layout, last_marks, with_previous, without_chunks
from gaugeline.schema import POINT_OUTSIDE, RULESET, SAME_SIDE, TREND_DOWN, TREND_UP

# Used when a configuration names no rules: (rule, consecutive points).
DEFAULT_RULES = ((POINT_OUTSIDE, None), (TREND_UP, 7), (TREND_DOWN, 7), (SAME_SIDE, 8))
DEFAULT_SEVERITY = "WARNING"
# Fixed values of the stored contract.
SEVERITIES = ("INFO", "WARNING", "CRITICAL")
UNREADABLE = "(unreadable)"
DEFAULT_TREND = 7
DEFAULT_RUN = 8


def default_ruleset() -> Column:
    rules = [
        F.struct(
            F.lit(name).alias("rule_name"),
            F.lit(True).alias("enabled"),
            F.lit(DEFAULT_SEVERITY).alias("severity"),
            (F.create_map(F.lit("consecutive_points"), F.lit(str(n))) if n else F.create_map().cast("map<string,string>"))
            .alias("parameters"),
        )
        for name, n in DEFAULT_RULES
    ]
    return F.array(*rules).cast(RULESET)


def decode_ruleset(column: Column) -> Column:
    """Ruleset array from its JSON text; text that is none becomes a rule that is refused later."""
    refused = F.array(F.struct(*[
        (F.lit(UNREADABLE) if f.name == "rule_name" else F.lit(None)).cast(f.dataType).alias(f.name) for f in RULESET.elementType
    ]))
    decoded = F.from_json(column, RULESET.simpleString())
    broken = decoded.isNull() | F.exists(decoded, lambda r: r.isNull())
    return F.when((F.trim(F.coalesce(column, F.lit(""))) != "") & broken, refused).otherwise(decoded)


def ruleset_problem(ruleset: Column) -> Column:
    """Why a ruleset cannot be used, NULL when it can."""
    def wrong(rule):
        given = F.element_at(rule["parameters"], "consecutive_points")
        return (
            F.when(rule["rule_name"].isNull() | ~rule["rule_name"].isin(*[name for name, _ in DEFAULT_RULES]), F.concat(F.lit("unknown rule "), F.coalesce(rule["rule_name"], F.lit("NULL"))))
            .when(~F.coalesce(rule["severity"], F.lit(DEFAULT_SEVERITY)).isin(*SEVERITIES), F.concat(F.lit("unknown severity "), rule["severity"]))
            .when(given.isNotNull() & given.try_cast("double").isNull(), F.concat(F.lit("threshold is no number: "), given))
        )

    return F.get(F.array_compact(F.transform(F.coalesce(ruleset, F.array().cast(RULESET)), wrong)), 0)


def compiled_rules(ruleset: Column) -> Column:
    """Enabled rules with position, severity and threshold; the defaults when there are none."""
    rules = F.when(F.size(F.coalesce(ruleset, F.array().cast(RULESET))) > 0, ruleset).otherwise(default_ruleset())

    def compile_rule(rule, i):
        given = F.element_at(rule["parameters"], "consecutive_points")
        fallback = F.when(rule["rule_name"] == SAME_SIDE, DEFAULT_RUN).otherwise(DEFAULT_TREND)
        return F.struct(
            i.alias("rule_position"),
            rule["rule_name"].alias("rule_name"),
            F.coalesce(rule["enabled"], F.lit(True)).alias("enabled"),
            F.coalesce(rule["severity"], F.lit(DEFAULT_SEVERITY)).alias("severity"),
            F.coalesce(given.try_cast("double").try_cast("long"), fallback.cast("long")).alias("threshold"),
        )

    return F.filter(F.transform(rules, compile_rule), lambda r: r["enabled"])


def run_positions(points: DataFrame, layout: Layout) -> DataFrame:
    """Add the position of each point in its rising, falling and same-side run.

    Needs ``point_number``, ``value`` and ``center_line``.
    """
    points = with_previous(without_chunks(points), layout, "point_number", {"_before": "value"})
    value, before = F.col("value"), F.col("_before")
    side = F.signum(value - F.col("center_line"))
    other = (side == 0) | (side != F.signum(before - F.col("center_line")))
    marked = last_marks(
        points,
        layout,
        "point_number",
        {
            "_up": ~F.coalesce(value > before, F.lit(False)),
            "_down": ~F.coalesce(value < before, F.lit(False)),
            "_side": F.coalesce(other, F.lit(True)),
        },
    )
    at = F.col("point_number")
    return marked.withColumns(
        {"up_position": at - F.col("_up"), "down_position": at - F.col("_down"), "side_position": at - F.col("_side")}
    ).drop("_before", "_up", "_down", "_side", "_chunk_point_number")


def judge(points: DataFrame, layout: Layout) -> DataFrame:
    """Add ``hits``: the rules each point sets off.

    Reads ``point_number``, ``mean``, ``center_line``, ``ucl``, ``lcl`` and
    ``ruleset``. The limits may be fresh or frozen.
    """
    judged = run_positions(points.withColumn("value", F.col("mean")), layout)

    def hit(rule):
        step = F.greatest(rule["threshold"] - 1, F.lit(1))
        position = (
            F.when(rule["rule_name"] == TREND_UP, F.col("up_position"))
            .when(rule["rule_name"] == TREND_DOWN, F.col("down_position"))
            .when(rule["rule_name"] == SAME_SIDE, F.col("side_position"))
        )
        outside = (F.col("value") > F.col("ucl")) | (F.col("value") < F.col("lcl"))
        return F.when(rule["rule_name"] == POINT_OUTSIDE, outside).otherwise(
            (rule["threshold"] >= 2) & (position > 0) & (position % step == 0)
        )

    return judged.withColumn("hits", F.filter(compiled_rules(F.col("ruleset")), hit)).drop(
        "up_position", "down_position", "side_position"
    )


def violations(judged: DataFrame, ids: tuple = ("ctx",)) -> DataFrame:
    """One row per rule hit with the points it covers."""
    rule = F.col("_rule")
    end = F.col("point_number") - 1
    start = F.when(rule["rule_name"] == POINT_OUTSIDE, end).otherwise(end - rule["threshold"] + 1)
    return judged.withColumn("_rule", F.explode("hits")).select(
        *ids,
        rule["rule_position"].cast("long").alias("rule_position"),
        rule["rule_name"].alias("rule_name"),
        "chart_type",
        rule["severity"].alias("severity"),
        start.alias("start_index"),
        end.alias("end_index"),
        F.sequence(start, end).alias("affected_points"),
        "value",
        "center_line",
        "ucl",
        "lcl",
    )


def hit_totals() -> dict[str, Column]:
    """Aggregates over judged points: violations by rule family."""

    def total(*names):
        return F.sum(F.size(F.filter("hits", lambda r: r["rule_name"].isin(*names))).cast("long"))

    return {
        "point_violations": total(POINT_OUTSIDE),
        "trend_violations": total(TREND_UP, TREND_DOWN),
        "shift_violations": total(SAME_SIDE),
        "violation_count": F.sum(F.size("hits").cast("long")),
    }


def with_messages(found: DataFrame) -> DataFrame:
    """Add the text of each violation."""
    text = found.withColumns({f"_{c}": significant(F.col(c), 6) for c in ("value", "ucl", "lcl")})
    first, last = F.col("start_index").cast("string"), F.col("end_index").cast("string")
    length = (F.col("end_index") - F.col("start_index") + 1).cast("string")
    span = F.concat(F.lit("(indices "), first, F.lit(".."), last, F.lit(")"))
    outside = F.concat(
        F.lit("Point at index "), first, F.lit(" (value="), F.col("_value"), F.lit(") is "),
        F.when(F.col("value") > F.col("ucl"), "above UCL").otherwise("below LCL"),
        F.lit(" (UCL="), F.col("_ucl"), F.lit(", LCL="), F.col("_lcl"), F.lit(")."),
    )
    trend = F.concat(
        length, F.lit(" consecutive "),
        F.when(F.col("rule_name") == TREND_UP, "increasing").otherwise("decreasing"),
        F.lit(" points detected "), span, F.lit("."),
    )
    run = F.concat(
        length, F.lit(" consecutive points "),
        F.when(F.col("value") > F.col("center_line"), "above").otherwise("below"),
        F.lit(" the center line detected "), span, F.lit("; this indicates a sustained process shift."),
    )
    message = (
        F.when(F.col("rule_name") == POINT_OUTSIDE, outside).when(F.col("rule_name") == SAME_SIDE, run).otherwise(trend)
    )
    return text.withColumn("message", message).drop("_value", "_ucl", "_lcl")


def violation_counts(found: DataFrame) -> DataFrame:
    """Per context: violations by rule family."""
    name = F.col("rule_name")
    return found.groupBy("ctx").agg(
        F.count_if(name == POINT_OUTSIDE).alias("point_violations"),
        F.count_if(name.isin(TREND_UP, TREND_DOWN)).alias("trend_violations"),
        F.count_if(name == SAME_SIDE).alias("shift_violations"),
        F.count("*").alias("violation_count"),
    )


def stability(counts: DataFrame) -> DataFrame:
    """Add the stability status; contexts without violations have NULL counts."""
    return counts.withColumn(
        "stability_status",
        F.when(F.coalesce("point_violations", F.lit(0)) > 0, "OUT_OF_CONTROL")
        .when(F.coalesce("violation_count", F.lit(0)) > 0, "WARNING")
        .otherwise("IN_CONTROL"),
    )
