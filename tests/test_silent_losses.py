"""Inputs on which rows or values were once lost without a sign."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeline.operators.rules import decode_ruleset, ruleset_problem
from gaugeline.plans.analysis import SpcConfig, analyze, historical_analysis
from gaugeline.plans.baseline import approve
from gaugeline.sources.csv import FileError, read_csv
from gaugeline.sources.tables import read_partitioned

START = dt.datetime(2026, 1, 1)


def measured(spark, contexts, n=120):
    rows = [(p, "M", "P", "O", float(20 + (k * 7 % 11) / 10), START + dt.timedelta(minutes=k), k) for p in contexts for k in range(n)]
    return spark.createDataFrame(
        rows, "parameter_id string, machine_id string, product_id string, operation_id string, value double, event_timestamp timestamp_ntz, source_row_number long"
    )


def test_header_order_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n2,1\n")
    with pytest.raises(FileError, match="headers"):
        read_csv(spark, str(tmp_path))


def test_surplus_cells_refuse_the_file(spark, tmp_path):
    (tmp_path / "long.csv").write_text('a,b\n1,x\n2,"y,z",EXTRA\n')
    with pytest.raises(FileError, match="long.csv"):
        read_csv(spark, str(tmp_path / "long.csv"))
    (tmp_path / "short.csv").write_text('a,b\n1\n2,"y,z"\n')
    assert sorted((r["a"], r["b"]) for r in read_csv(spark, str(tmp_path / "short.csv")).collect()) == [("1", None), ("2", "y,z")]


def test_ids_that_look_like_numbers(spark, tmp_path):
    path = str(tmp_path / "ids")
    spark.createDataFrame([("007", 1), ("1e3", 2), (None, 3)], "parameter_id string, v int").write.partitionBy("parameter_id").parquet(path)
    assert sorted(map(tuple, read_partitioned(spark, path, "parameter_id").select("parameter_id", "v").collect()), key=str) == [("007", 1), ("1e3", 2), (None, 3)]


def test_chunk_narrower_than_a_subgroup(spark):
    rows = measured(spark, ["A"])
    config = SpcConfig(subgroup_size=10, subgroup_method="TIME_WINDOW", maximum_time_gap_seconds=600)
    whole, cut = (analyze(rows, config, chunk_rows=c).summary.select("size_used", "point_count", "mean", "ucl").first() for c in (1000, 4))
    assert whole == cut and whole["size_used"] == 10


CONFIGURATION = (
    "parameter_id string, machine_id string, product_id string, operation_id string, chart_type string, subgroup_size int, subgroup_method string, "
    "maximum_time_gap_seconds long, minimum_sample_size int, ruleset string"
)


def test_odd_methods_of_single_values_hide_no_real_one(spark):
    contexts = [f"C{k}" for k in range(14)]
    settings = [(f"C{k}", "M", "P", "O", "AUTO", 5 if k > 11 else 1, ("TIME_WINDOW" if k == 12 else "FIXED_SIZE") if k > 11 else f"odd {k}", 3600, 20, None) for k in range(14)]
    frame = spark.createDataFrame(settings, CONFIGURATION).withColumnRenamed("chart_type", "configured_chart").drop("ruleset")
    frame = frame.select(F.struct("parameter_id", "machine_id", "product_id", "operation_id").alias("ctx"), "configured_chart", "subgroup_size", "subgroup_method", "maximum_time_gap_seconds", "minimum_sample_size")
    got = analyze(measured(spark, contexts, 60), frame).summary.select("ctx.parameter_id", "error_code").collect()
    assert len(got) == 14 and [r for r in got if r["error_code"]] == []


def test_bad_rulesets_fail_alone(spark):
    texts = [
        None, "", "[]", '[{"rule_name":"TREND_INCREASING","parameters":{"consecutive_points":"6"}}]', "not json", '[{"rule_name":"NO_SUCH"}]',
        '[{"rule_name":"TREND_INCREASING","severity":"LOUD"}]', '[{"rule_name":"TREND_INCREASING","parameters":{"consecutive_points":"many"}}]',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["p"] for r in df.select("i", ruleset_problem(decode_ruleset(F.col("t"))).alias("p")).collect()}
    assert [got[i] is None for i in range(8)] == [True] * 4 + [False] * 4
    rows = [(f"C{i}", "M", "P", "O", "AUTO", 1, None, 3600, 20, t) for i, t in enumerate(texts)]
    settings = spark.createDataFrame(rows, CONFIGURATION).withColumn("ruleset", decode_ruleset(F.col("ruleset"))).withColumnRenamed("chart_type", "configured_chart")
    settings = settings.select(F.struct("parameter_id", "machine_id", "product_id", "operation_id").alias("ctx"), *[c for c in settings.columns if not c.endswith("_id")])
    done = analyze(measured(spark, [f"C{i}" for i in range(8)], 40), settings).summary.select("ctx.parameter_id", "error_code").collect()
    assert {r["parameter_id"] for r in done if r["error_code"] == "INVALID_RULESET"} == {"C4", "C5", "C6", "C7"} and len(done) == 8


def test_request_without_measurements_fails_with_a_row(spark):
    requests = spark.createDataFrame([("A", "M", "P", "O"), ("Z", "M", "P", "O")], "parameter_id string, machine_id string, product_id string, operation_id string")
    config = spark.createDataFrame(
        [(f"K{p}", p, None, None, None, "AUTO", 1, "CONSECUTIVE", 3600, 20, None, True, START) for p in "AZ"],
        "spc_configuration_id string, parameter_id string, machine_id string, product_id string, operation_id string, chart_type string, subgroup_size int, "
        "subgroup_method string, maximum_time_gap_seconds long, minimum_sample_size int, ruleset string, is_active boolean, created_at timestamp_ntz",
    )
    spec = spark.createDataFrame(
        [], "specification_id string, parameter_id string, machine_id string, product_id string, operation_id string, lsl double, usl double, target double, "
        "effective_from timestamp_ntz, effective_to timestamp_ntz, status string",
    )
    got = historical_analysis(measured(spark, ["A"]), requests, config, spec, F.lit(START)).summary.select("ctx.parameter_id", "error_code", "total_observations").collect()
    assert sorted(map(tuple, got)) == [("A", None, 120), ("Z", "NO_MEASUREMENTS", 0)]


def test_baseline_approved_twice(spark):
    baselines = spark.createDataFrame(
        [("B1", "p", "m", "x", "o", "DRAFT", None), ("B0", "p", "m", "x", "o", "ACTIVE", None)],
        "baseline_id string, parameter_id string, machine_id string, product_id string, operation_id string, status string, superseded_by_baseline_id string",
    )
    asked = spark.createDataFrame([("B1", START, "a"), ("B1", START + dt.timedelta(days=1), "b")], "baseline_id string, approved_at timestamp_ntz, approved_by string")
    table, refused = approve(baselines, asked)
    rows = {r["baseline_id"]: r for r in table.collect()}
    assert table.count() == 2 and rows["B1"]["status"] == "ACTIVE" and rows["B1"]["approved_by"] == "a"
    assert (rows["B0"]["status"], rows["B0"]["superseded_by_baseline_id"], rows["B0"]["superseded_at"]) == ("SUPERSEDED", "B1", START)
    assert [tuple(r) for r in refused.collect()] == [("B1", "DRAFT")]
