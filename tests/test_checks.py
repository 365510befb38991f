"""Baselines, comparison, findings, alerts, listings and display helpers."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeline.functions.compare import StatusThresholds, compare, final_status, finding_messages, findings
from gaugeline.operators.display import axis_range, bin_of, downsample, histogram, point_status
from gaugeline.operators.layout import Layout, context, unpack
from gaugeline.plans.analysis import SpcConfig, analysis_runs, analyze, stored_results
from gaugeline.plans.baseline import approve, create_drafts
from gaugeline.plans.check import affected_indices, alert_texts, run_check
from gaugeline.plans.ledger import alert_state

from test_engine import gauss, measured

NUMBERS = ("baseline_mean", "current_mean", "baseline_within_sigma", "current_within_sigma", "baseline_overall_sigma",
           "current_overall_sigma", "baseline_cpk", "current_cpk", "baseline_ppk", "current_ppk")


def compared(spark, bm=20.0, cm=20.0, bw=0.01, cw=0.01, bk=1.5, ck=1.5, points=0, trends=0, shifts=0):
    row = (bm, cm, bw, cw, 0.012, 0.012, bk, ck, 1.4, 1.4, points, trends, shifts)
    schema = ", ".join(f"{c} double" for c in NUMBERS) + ", point_violations long, trend_violations long, shift_violations long"
    return compare(spark.createDataFrame([row], schema)).withColumn("final_status", final_status())


@pytest.mark.parametrize(
    "change, status, kinds",
    [
        ({}, "NORMAL", ["PROCESS_STABLE"]),
        ({"cm": 20.02}, "WARNING", ["MEAN_SHIFT"]),
        ({"cw": 0.02}, "WARNING", ["VARIATION_INCREASE"]),
        ({"cw": 0.005}, "NORMAL", ["VARIATION_REDUCTION"]),
        ({"ck": 1.2}, "WARNING", ["CAPABILITY_DEGRADATION"]),
        ({"ck": 1.8}, "NORMAL", ["CAPABILITY_IMPROVEMENT"]),
        ({"bk": None, "ck": 1.0}, "WARNING", ["PROCESS_STABLE"]),
        ({"points": 1}, "OUT_OF_CONTROL", ["NEW_LIMIT_VIOLATION"]),
        ({"trends": 1, "shifts": 2}, "WARNING", ["TREND_DETECTED", "SHIFT_DETECTED"]),
        ({"ck": 0.9}, "CRITICAL", ["CAPABILITY_DEGRADATION"]),
        ({"points": 1, "cm": 20.02, "cw": 0.02}, "CRITICAL", ["MEAN_SHIFT", "VARIATION_INCREASE", "NEW_LIMIT_VIOLATION"]),
    ],
)
def test_verdicts(spark, change, status, kinds):
    df = compared(spark, **change)
    assert df.first().final_status == status
    assert [r.finding_type for r in findings(df, []).orderBy("finding_number").collect()] == kinds


def test_comparison_edges(spark):
    assert compared(spark, bm=0.0).first().mean_shift_percentage is None
    row = compared(spark, bw=0.0, cm=30.0).first()
    assert row.mean_shift_detected is False and row.within_variation_change_percentage is None
    strict = compared(spark, points=1).withColumn("s", final_status(StatusThresholds(critical_violation_count=1))).first()
    assert strict.s == "CRITICAL"


def test_finding_text(spark):
    got = finding_messages(findings(compared(spark, cm=20.02, points=3), [])).orderBy("finding_number").collect()
    assert got[0].message == "Process mean shifted upward by 0.02 (from 20 to 20.02)."
    assert got[1].message == "3 point(s) in the new dataset fall outside the fixed historical baseline control limits."
    assert got[1].statistical_fact == '{"violation_count":3}'


CONFIG = SpcConfig(subgroup_size=5, lsl=19.94, usl=20.06)


def baselines(spark, values):
    done = analyze(measured(spark, values), CONFIG)
    ids = done.profile.select("ctx", F.lit("A1").alias("analysis_id"))
    runs = unpack(analysis_runs(done).join(ids, "ctx")).withColumn("created_at", F.lit("2026-01-01").cast("timestamp_ntz"))
    return create_drafts(runs, stored_results(done, ids))


def test_check_against_frozen_limits(spark):
    draft = baselines(spark, gauss(250, sigma=0.012))
    assert draft.first().status == "DRAFT" and draft.first().rejection is None
    current = analyze(measured(spark, gauss(100, 20.02, 0.02, seed=5), start=datetime(2026, 3, 1)), CONFIG)
    assert run_check(current, draft).checks.first().failure == "MISSING_ACTIVE_BASELINE"
    active = draft.withColumn("status", F.lit("ACTIVE"))
    check = run_check(current, active)
    row = check.checks.first()
    assert row.status == "COMPLETED" and row.final_status == "CRITICAL" and row.mean_shift > 0.01
    outside = affected_indices(check.violations).count()
    assert outside == row.point_violations > 0
    texts = {r.finding_type: r.message for r in alert_texts(check.alerts).collect()}
    assert "upward" in texts["MEAN_SHIFT"] and all(r.status == "OPEN" for r in check.alerts.collect())
    points = current.points.collect()
    frozen = active.first()
    assert outside == sum(p.mean > frozen.ucl or p.mean < frozen.lcl for p in points)


def test_other_context_or_chart_is_refused(spark):
    active = baselines(spark, gauss(100)).withColumn("status", F.lit("ACTIVE"))
    current = analyze(measured(spark, gauss(60)), SpcConfig(lsl=19.94, usl=20.06))
    row = run_check(current, active).checks.first()
    assert row.failure == "BASELINE_CONTEXT_MISMATCH" and row.mismatches == ["chart type"] and row.status == "FAILED"
    other = analyze(measured(spark, gauss(60), "CNC_02"), CONFIG)
    named = other.profile.select("ctx", F.lit("B-A1").alias("baseline_id"))
    assert run_check(other, active, named=named).checks.first().mismatches == ["machine"]
    assert run_check(other, active).checks.first().failure == "MISSING_ACTIVE_BASELINE"


def test_failed_runs_give_no_draft(spark):
    assert baselines(spark, gauss(10)).first().rejection == "NOT_COMPLETED"


def test_approval_chain(spark):
    rows = [("b1", "p", None, "ACTIVE"), ("b2", "p", None, "DRAFT"), ("b3", "p", None, "DRAFT"), ("b4", "p", "m", "DRAFT"),
            ("b5", "q", None, "ACTIVE"), ("b6", "p", None, "SUPERSEDED")]
    df = spark.createDataFrame(rows, "baseline_id string, parameter_id string, machine_id string, status string").withColumns(
        {"product_id": F.lit(None).cast("string"), "operation_id": F.lit(None).cast("string"), "superseded_by_baseline_id": F.lit(None).cast("string")})
    at = datetime(2026, 1, 1)
    asked = spark.createDataFrame([("b3", at, "qa"), ("b2", at + timedelta(days=1), "qa"), ("b4", at, "qa"), ("b6", at, "qa"), ("zz", at, "qa")],
                                  "baseline_id string, approved_at timestamp_ntz, approved_by string")
    after, refused = approve(df, asked)
    got = {r.baseline_id: (r.status, r.superseded_by_baseline_id) for r in after.collect()}
    assert got == {"b1": ("SUPERSEDED", "b3"), "b3": ("SUPERSEDED", "b2"), "b2": ("ACTIVE", None), "b4": ("ACTIVE", None),
                   "b5": ("ACTIVE", None), "b6": ("SUPERSEDED", None)}
    assert {r.baseline_id: r.status for r in refused.collect()} == {"b6": "SUPERSEDED", "zz": "MISSING"}


def test_alert_states(spark):
    alerts = spark.createDataFrame([("a", "OPEN"), ("b", "OPEN")], "alert_id string, status string")
    events = spark.createDataFrame([("a", 1, "ACKNOWLEDGED", "x", datetime(2026, 1, 1)), ("a", 2, "RESOLVED", "y", datetime(2026, 1, 2)),
                                    ("c", 3, "RESOLVED", "z", datetime(2026, 1, 2))],
                                   "alert_id string, event_id int, action string, actor string, created_at timestamp_ntz")
    got = {r.alert_id: (r.status, r.acknowledged_by, r.resolved_by) for r in alert_state(alerts, events).collect()}
    assert got == {"a": ("RESOLVED", "x", "y"), "b": ("OPEN", None, None)}


def series(spark, values):
    return context(spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(values)], "k string, index long, value double"), ["k"])


def test_point_status_restarts_messages_at_a_worse_rank(spark):
    points = series(spark, [0] * 5)
    rows = [("k", "RUN_SAME_SIDE", 3, 0, [0, 1, 2], "run"), ("k", "POINT_OUTSIDE_LIMITS", 0, 1, [1], "out"), ("k", "TREND_INCREASING", 1, 1, [1, 2], "trend")]
    found = context(spark.createDataFrame(rows, "k string, rule_name string, rule_position long, start_index long, affected_points array<long>, message string"), ["k"])
    got = {r["index"]: (r.status, r.messages) for r in point_status(points, found, "message").collect()}
    assert got == {0: ("WARNING", ["run"]), 1: ("OUT_OF_CONTROL", ["out", "trend"]), 2: ("WARNING", ["run", "trend"]), 3: ("NORMAL", []), 4: ("NORMAL", [])}


@pytest.mark.parametrize("layout", [Layout(None, 1000, 1), Layout(64, 1000, 1)])
def test_downsample(spark, layout):
    points = series(spark, range(1000)).withColumn("status", F.when(F.col("index") % 97 == 5, "WARNING").otherwise("NORMAL"))
    got = sorted(r["index"] for r in downsample(points, layout, 100).collect())
    kept = [i for i in range(1000) if i % 97 == 5]
    stride = -(-1000 // (100 - len(kept)))
    assert got == sorted(set(kept) | set(range(0, 1000, stride)) | {0, 999})
    everything = points.withColumn("status", F.lit("WARNING"))
    assert downsample(everything, layout, 100).count() == 1000
    assert downsample(points, layout, 1000).filter("was_downsampled").count() == 0


def values_of(spark, mean, sigma, lsl=None, usl=None, target=None):
    return context(spark.createDataFrame([("k", mean, sigma, lsl, usl, target)],
                                         "k string, mean double, overall_sigma double, lsl double, usl double, target double"), ["k"]).drop("k")


def test_histogram(spark):
    rng = random.Random(2)
    values = [rng.gauss(10, 1) for _ in range(300)]
    layout = Layout(None, 300, 1)
    bins = histogram(series(spark, values).drop("k"), values_of(spark, 10.0, 1.0, 2.0, 18.0), layout).orderBy("bin").collect()
    assert sum(b["count"] for b in bins) == 300 and bins[0]["count"] == 0
    assert bins[0].range_start <= 2.0 and bins[-1].range_end >= 18.0
    width = bins[0].range_end - bins[0].range_start
    assert width == pytest.approx((max(values) - min(values)) / 16)
    assert sum(b.normal_curve for b in bins) == pytest.approx(300, rel=0.01)
    flat = histogram(series(spark, [5.0] * 4).drop("k"), values_of(spark, 5.0, 0.0, -1e9, 1e9), layout).orderBy("bin").collect()
    assert len(flat) == 96 and sum(b["count"] for b in flat) == 4 and flat[0].normal_curve is None
    marks = context(spark.createDataFrame([("k", "low", -1e12), ("k", "in", 5.0), ("k", "high", 1e12)], "k string, mark string, mark_value double"), ["k"]).drop("k")
    frame = histogram(series(spark, [5.0] * 4).drop("k"), values_of(spark, 5.0, 0.0, -1e9, 1e9), layout)
    got = {r.mark: r.bin for r in bin_of(frame, marks).collect()}
    assert got["low"] == 0 and got["high"] == 95 and 38 <= got["in"] <= 41


def test_axis_range(spark):
    lines = context(spark.createDataFrame([("k", 19.0, None), ("none", None, float("nan"))], "k string, ucl double, lcl double"), ["k"]).drop("k")
    got = {r.ctx.k: (r.axis_low, r.axis_high) for r in axis_range(series(spark, [1.0, 11.0]).drop("k"), lines).collect()}
    assert got == {"k": (pytest.approx(1 - 18 * 0.08), pytest.approx(19 + 18 * 0.08)), "none": (0.0, 1.0)}
