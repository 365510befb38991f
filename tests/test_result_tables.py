"""Stored result tables: fixed columns, one owner a row, ids that a repeated append keeps."""

import pytest
from pyspark.sql import functions as F

from gaugeline.sources import results as sink

FOUND = (
    "finding_number long, finding_type string, severity string, statistical_fact string, baseline_mean double, current_mean double, "
    "mean_shift double, baseline_within_sigma double, current_within_sigma double, within_variation_change_percentage double, "
    "baseline_cpk double, current_cpk double, point_violations long, trend_violations long, shift_violations long, "
    "analysis_id string, manual_check_id string, final_status string"
)


def found(spark, *owners):
    numbers = (20.0, 20.5, 0.5, 0.1, 0.2, 100.0, 1.5, 1.0, 3, 0, 0)
    rows = [
        (i, kind, severity, '{"violation_count":3}', *numbers, *owner, "CRITICAL")
        for owner in owners
        for i, (kind, severity) in enumerate([("MEAN_SHIFT", "WARNING"), ("NEW_LIMIT_VIOLATION", "CRITICAL")])
    ]
    return spark.createDataFrame(rows, FOUND)


def test_findings_need_exactly_one_owner(spark, tmp_path):
    path = str(tmp_path / "findings")
    rows = found(spark, (None, "C1"), ("A1", None), ("A2", "C2"), (None, None))
    assert sink.append_findings(rows, path) == 4
    stored = spark.read.parquet(path)
    assert stored.columns == [c.split()[0] for c in sink.FINDINGS.split(", ")]
    assert {r.finding_id for r in stored.collect()} == {
        f"F-{owner}-{kind}" for owner in ("C1", "A1") for kind in ("MEAN_SHIFT", "NEW_LIMIT_VIOLATION")
    }
    aside = spark.read.parquet(path + "_refused").groupBy("refusal").count().collect()
    assert {r.refusal: r["count"] for r in aside} == {"NO_OWNER": 2, "SEVERAL_OWNERS": 2}
    # Refused rows alone, and none at all.
    assert sink.append_findings(found(spark, (None, None)), path) == 2
    assert sink.append_findings(rows.filter("false"), path) == 0
    assert spark.read.parquet(path).count() == 4


def test_a_repeated_append_writes_the_same_ids(spark, tmp_path):
    path = str(tmp_path / "findings")
    for _ in range(2):
        sink.append_findings(found(spark, (None, "C1")), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 4 and stored.select("finding_id").distinct().count() == 2


def test_alerts_carry_check_finding_and_message(spark, tmp_path):
    path = str(tmp_path / "alerts")
    raised = found(spark, (None, "C1")).withColumns({"status": F.lit("OPEN"), "machine_id": F.lit("M1"), "parameter_id": F.lit("P1")})
    assert sink.append_alerts(raised.drop("analysis_id"), path) == 0
    rows = {r.alert_id: r for r in spark.read.parquet(path).collect()}
    shift = rows["A-C1-MEAN_SHIFT"]
    assert (shift.finding_id, shift.manual_check_id, shift.machine_id, shift.parameter_id) == ("F-C1-MEAN_SHIFT", "C1", "M1", "P1")
    assert (shift.severity, shift.status) == ("WARNING", "OPEN")
    assert shift.message == "Process mean shifted upward by 0.5 (from 20 to 20.5)."
    assert rows["A-C1-NEW_LIMIT_VIOLATION"].severity == "CRITICAL" and len(rows) == 2


def test_columns_must_fit_the_table(spark, tmp_path):
    path = str(tmp_path / "comparisons")
    row = {f.split()[0]: f.split()[1] for f in sink.COMPARISONS.split(", ")}
    full = spark.range(1).select(*[F.lit(None).cast(kind).alias(c) for c, kind in row.items()])
    good = full.withColumns({"manual_check_id": F.lit("C1"), "current_cpk": F.lit(2), "other": F.lit("x")})
    assert sink.append_comparisons(good, path) == 0
    stored = spark.read.parquet(path)
    assert stored.columns == list(row) and stored.first().current_cpk == 2.0
    with pytest.raises(sink.WrongColumns, match="no cpk_change"):
        sink.append_comparisons(good.drop("cpk_change"), path)
    with pytest.raises(sink.WrongColumns, match="baseline_mean string"):
        sink.append_comparisons(good.withColumn("baseline_mean", F.lit("1.0")), path)
    assert stored.count() == 1
