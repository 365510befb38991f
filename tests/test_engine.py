"""Charts, sigma, capability, rules and the whole analysis on small known data."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeline.functions.capability import sigma_level, with_capability
from gaugeline.functions.constants import factors, rows as factor_rows
from gaugeline.functions.text import significant
from gaugeline.operators.charts import chart_points, control_limits, with_sizes
from gaugeline.operators.layout import Layout, context, unpack
from gaugeline.operators.rules import with_messages
from gaugeline.operators.statistics import MissingColumns, candidate_sizes, profile_dataset, require_columns
from gaugeline.plans.analysis import SpcConfig, analysis_runs, analyze, historical_analysis

MEASURED = (
    "value double, event_timestamp timestamp_ntz, machine_id string, product_id string, process_id string, "
    "operation_id string, parameter_id string, subgroup_id string, source_row_number int"
)


def measured(spark, values, machine="CNC_01", parameter="SHAFT_DIAMETER", step=300, start=datetime(2026, 1, 1)):
    rows = [
        (v, start + timedelta(seconds=step * i), machine, "PART_A", "MACHINING", "OP_10", parameter, None, i)
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, MEASURED)


def gauss(n, mean=20.0, sigma=0.01, seed=42):
    rng = random.Random(seed)
    return [rng.gauss(mean, sigma) for _ in range(n)]


def summary(analysis):
    return unpack(analysis.summary).first()


def subgroups(spark, groups, chart="AUTO"):
    import statistics

    rows, seq = [], 1
    for i, g in enumerate(groups):
        rows.append(("k", seq, i + 1, f"SG-{i + 1:05d}", statistics.fmean(g), max(g) - min(g),
                     statistics.stdev(g) if len(g) > 1 else None, len(g), datetime(2026, 1, 1), chart))
        seq += len(g)
    schema = ("k string, first_seq long, subgroup_index long, subgroup_id string, mean double, range double, "
              "std_dev double, count long, end_timestamp timestamp_ntz, configured_chart string")
    df = context(spark.createDataFrame(rows, schema), ["k"])
    layout = Layout(None, len(rows), 1)
    return control_limits(chart_points(with_sizes(df, layout), layout)).first()


def test_factor_table(spark):
    assert factors(spark).count() == 24
    assert factor_rows()[0][0] == 2 and factor_rows()[-1][0] == 25
    assert factors(spark).filter("n = 5").first().a2 == 0.577


def test_xbar_r(spark):
    groups = [[10.0, 10.2, 9.9, 10.1, 10.0], [10.1, 10.0, 10.2, 9.8, 10.0], [9.9, 10.0, 10.1, 10.0, 10.2], [10.0, 10.1, 9.9, 10.0, 10.1]]
    row = subgroups(spark, groups)
    rbar = sum(max(g) - min(g) for g in groups) / 4
    mean = sum(sum(g) / 5 for g in groups) / 4
    assert row.chart_type == "XBAR_R"
    assert (row.center_line, row.ucl, row.lcl) == pytest.approx((mean, mean + 0.577 * rbar, mean - 0.577 * rbar))
    assert (row.secondary_ucl, row.secondary_lcl) == pytest.approx((2.114 * rbar, 0.0))
    assert row.within_sigma == pytest.approx(rbar / 2.326)


def test_xbar_s(spark):
    import statistics

    rng = random.Random(1)
    groups = [[rng.gauss(5, 1) for _ in range(10)] for _ in range(3)]
    row = subgroups(spark, groups)
    sbar = statistics.fmean(statistics.stdev(g) for g in groups)
    mean = statistics.fmean(statistics.fmean(g) for g in groups)
    assert row.chart_type == "XBAR_S"
    assert (row.ucl, row.lcl) == pytest.approx((mean + 0.975 * sbar, mean - 0.975 * sbar))
    assert (row.secondary_ucl, row.secondary_lcl) == pytest.approx((1.716 * sbar, 0.284 * sbar))
    assert row.within_sigma == pytest.approx(sbar / 0.9727)


def test_imr(spark):
    row = subgroups(spark, [[v] for v in (10.0, 10.2, 9.9, 10.1, 10.0)])
    mr = (0.2 + 0.3 + 0.2 + 0.1) / 4
    assert row.chart_type == "IMR"
    assert (row.center_line, row.ucl) == pytest.approx((10.04, 10.04 + 3 * mr / 1.128))
    assert (row.secondary_center_line, row.secondary_ucl, row.secondary_lcl) == pytest.approx((mr, 3.267 * mr, 0.853 * mr))


def test_size_ties_differ_between_chart_choice_and_limits(spark):
    row = subgroups(spark, [[1.0, 2.0, 3.0], [1.0, 2.0], [2.0, 3.0, 4.0], [2.0, 3.0]])
    assert row.size_used == 3
    row = subgroups(spark, [[1.0] * 5, [2.0] * 5, [3.0] * 3])
    assert (row.size_used, row.point_count) == (5, 2)


def test_whole_analysis(spark):
    data = measured(spark, gauss(200)).unionByName(measured(spark, gauss(30), "M_IMR")).unionByName(measured(spark, [1.0] * 3, "M_FEW"))
    config = SpcConfig(subgroup_size=5, lsl=19.94, usl=20.06, target=20.0)
    got = {r.machine_id: r for r in unpack(analyze(data, config).summary).collect()}
    full = got["CNC_01"]
    assert full.chart_type == "XBAR_R" and full.cpk > 1 and full.stability_status in ("IN_CONTROL", "WARNING")
    assert full.point_count == 40 and full.average_sampling_interval_seconds == 300
    assert got["M_FEW"].error_code == "INSUFFICIENT_DATA" and got["M_FEW"].cpk is None
    one = analyze(data.filter("machine_id = 'M_IMR'"), SpcConfig())
    assert summary(one).chart_type == "IMR"
    assert "No specification" in summary(one).warnings[0]


def test_missing_values_and_zero_sigma(spark):
    values = gauss(100)
    data = measured(spark, [None if i % 10 == 0 else v for i, v in enumerate(values)])
    row = summary(analyze(data, SpcConfig(subgroup_size=5)))
    assert (row.total_observations, row.valid_observations, row.invalid_observations) == (100, 90, 10)
    row = summary(analyze(measured(spark, [5.0] * 40), SpcConfig(subgroup_size=5, lsl=1.0, usl=9.0)))
    assert row.within_sigma == 0 and row.cpk is None
    assert any("zero" in w for w in row.warnings) and row.warnings[-1].startswith("Within-sigma is zero: control")


def test_mixed_context_is_an_error_row(spark):
    data = measured(spark, gauss(40)).unionByName(measured(spark, gauss(40), "CNC_02"))
    row = summary(analyze(data, SpcConfig(), context_columns=["parameter_id"]))
    assert row.error_code == "INCOMPATIBLE_CONTEXT"


@pytest.mark.parametrize(
    "config, code",
    [
        (SpcConfig(subgroup_size=0), "INVALID_SUBGROUP_SIZE"),
        (SpcConfig(subgroup_size=5, subgroup_method="OTHER"), "INVALID_SUBGROUP_SIZE"),
        (SpcConfig(subgroup_size=5, subgroup_method="EXISTING_ID"), "INVALID_SUBGROUP_SIZE"),
        (SpcConfig(subgroup_size=50, subgroup_method="FIXED_SIZE"), "INVALID_SUBGROUP_SIZE"),
        (SpcConfig("IMR", subgroup_size=5), "CHART_SELECTION"),
        (SpcConfig("XBAR_R", subgroup_size=1), "CHART_SELECTION"),
        (SpcConfig("P", subgroup_size=5), "CHART_SELECTION"),
        (SpcConfig(subgroup_size=30, subgroup_method="FIXED_SIZE"), "UNSUPPORTED_SIZE"),
    ],
)
def test_error_rows(spark, config, code):
    done = analyze(measured(spark, gauss(60)), config)
    row = summary(done)
    assert row.error_code == code and row.error_message and row.center_line is None
    assert unpack(analysis_runs(done)).first().status == "FAILED"


def test_excluded_subgroups_are_reported(spark):
    data = measured(spark, gauss(22)).unionByName(measured(spark, gauss(10), start=datetime(2026, 2, 1)).withColumn(
        "source_row_number", F.col("source_row_number") + 100))
    row = summary(analyze(data, SpcConfig(subgroup_size=5)))
    assert (row.subgroups_formed, row.subgroups_excluded, row.excluded_sizes) == (7, 1, [2])
    assert row.warnings[0].startswith("1 of 7 subgroup(s) had a size other than the dominant subgroup size (5) -- sizes [2]")


def test_chunked_analysis_equals_whole(spark):
    data = measured(spark, gauss(120)).unionByName(measured(spark, gauss(45, seed=3), "B"))
    columns = ("error_code", "size_used", "center_line", "ucl", "lcl", "within_sigma", "violation_count", "stability_status")
    whole, cut = ({r.machine_id: r for r in unpack(analyze(data, SpcConfig(subgroup_size=3), chunk_rows=c).summary).collect()}
                  for c in (10**6, 11))
    for machine in whole:
        for c in columns:
            assert cut[machine][c] == (pytest.approx(whole[machine][c]) if isinstance(whole[machine][c], float) else whole[machine][c])


def capability(spark, lsl, usl, mean, within, overall, n):
    df = spark.createDataFrame([(lsl, usl, mean, within, overall, n)],
                               "lsl double, usl double, mean double, within_sigma double, overall_sigma double, valid_observations long")
    return with_capability(df).first()


def test_capability(spark):
    row = capability(spark, 19.94, 20.06, 20.0, 0.01, 0.012, 100)
    assert (row.cp, row.cpk, row.pp) == pytest.approx((2.0, 2.0, 0.12 / 0.072))
    assert (row.sigma_level_short_term, row.sigma_level_long_term) == pytest.approx((6.0, 4.5))
    upper = capability(spark, None, 20.06, 20.0, 0.01, 0.012, 100)
    assert upper.cp is None and upper.cpk == pytest.approx(2.0) and len(upper.capability_warnings) == 1
    lower = capability(spark, 19.94, None, 20.0, 0.01, 0.012, 100)
    assert lower.cpu is None and lower.cpk == pytest.approx(2.0)
    none = capability(spark, None, None, 20.0, 0.01, 0.012, 5)
    assert none.cpk is None and len(none.capability_warnings) == 1
    zero = capability(spark, 19.94, 20.06, 20.0, 0.0, 0.0, 5)
    assert zero.cpk is None and zero.ppk is None and len(zero.capability_warnings) == 3
    level = spark.range(1).select(sigma_level(F.lit(None).cast("double"))[0].alias("s")).first()
    assert level.s is None


def test_messages(spark):
    row = ("k", 0, "POINT_OUTSIDE_LIMITS", 2, 2, 15.0, 10.0, 12.0, 8.00001234), ("k", 3, "RUN_SAME_SIDE", 0, 7, 11.0, 10.0, 12.0, 8.0), ("k", 1, "TREND_INCREASING", 1, 7, 11.0, 10.0, 12.0, 8.0)
    df = spark.createDataFrame(list(row), "k string, rule_position int, rule_name string, start_index long, end_index long, value double, center_line double, ucl double, lcl double")
    got = [r.message for r in with_messages(df).collect()]
    assert got == [
        "Point at index 2 (value=15) is above UCL (UCL=12, LCL=8.00001).",
        "8 consecutive points above the center line detected (indices 0..7); this indicates a sustained process shift.",
        "7 consecutive increasing points detected (indices 1..7).",
    ]


def test_significant_digits(spark):
    values = [20.0, 1e-5, 123456789.0, 0.1 + 0.2, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(significant(F.col("v"), 4)).collect()] == ["20", "1e-05", "1.235e+08", "0.3", None]


def test_profile(spark):
    profile = unpack(profile_dataset(context(measured(spark, gauss(25)), ["machine_id"]))).first()
    assert profile.potential_subgroup_sizes == [2, 3, 4, 5, 6, 8, 10]
    assert profile.existing_subgroup_ids_detected is False and profile.unique_parameters == 1
    assert spark.range(1).select(candidate_sizes(F.lit(1)).alias("c")).first().c == []
    with pytest.raises(MissingColumns):
        require_columns(spark.range(1))


def test_effective_settings_follow_scope_and_time(spark):
    data = measured(spark, gauss(60)).unionByName(measured(spark, gauss(60), "CNC_02"))
    spec = "specification_id string, parameter_id string, machine_id string, product_id string, operation_id string, lsl double, usl double, target double, effective_from timestamp_ntz, effective_to timestamp_ntz, status string"
    t0, t1, t2 = datetime(2025, 1, 1), datetime(2025, 6, 1), datetime(2026, 6, 1)
    specs = spark.createDataFrame(
        [("wide", "SHAFT_DIAMETER", None, None, None, 1.0, 30.0, None, t0, None, "ACTIVE"),
         ("newer", "SHAFT_DIAMETER", None, None, None, 2.0, 30.0, None, t1, None, "ACTIVE"),
         ("machine", "SHAFT_DIAMETER", "CNC_02", None, None, 3.0, 30.0, None, t0, None, "ACTIVE"),
         ("ended", "SHAFT_DIAMETER", "CNC_02", "PART_A", None, 4.0, 30.0, None, t0, t1, "ACTIVE"),
         ("future", "SHAFT_DIAMETER", "CNC_02", "PART_A", None, 5.0, 30.0, None, t2, None, "ACTIVE")], spec)
    conf = "spc_configuration_id string, parameter_id string, machine_id string, product_id string, operation_id string, chart_type string, subgroup_size int, subgroup_method string, maximum_time_gap_seconds int, minimum_sample_size int, ruleset string, is_active boolean, created_at timestamp_ntz"
    confs = spark.createDataFrame([("c", "SHAFT_DIAMETER", None, None, None, "AUTO", 5, "CONSECUTIVE", 3600, 20, "[]", True, t0)], conf)
    requests = data.select("parameter_id", "machine_id", "product_id", "operation_id").distinct()
    as_of = F.lit("2026-03-01").cast("timestamp_ntz")
    done = historical_analysis(data, requests, confs, specs, as_of)
    got = {r.machine_id: r.specification_id for r in unpack(done.summary).collect()}
    assert got == {"CNC_01": "newer", "CNC_02": "machine"}
    wide = spark.createDataFrame([("SHAFT_DIAMETER", None, None, None)], "parameter_id string, machine_id string, product_id string, operation_id string")
    assert summary(historical_analysis(data, wide, confs, specs, as_of)).error_code == "INCOMPATIBLE_CONTEXT"
