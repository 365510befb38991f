"""Batches of analysis and check requests: every refusal is a row."""

from datetime import datetime, timedelta

import pytest

from gaugeline.plans.requests import run_analyses, run_checks

START = datetime(2026, 1, 1)
MEASURED = ("value double, event_timestamp timestamp_ntz, parameter_id string, machine_id string, product_id string, process_id string, "
            "operation_id string, upload_id string, source_row_number long, measurement_id string")
CONFIGURATIONS = ("spc_configuration_id string, parameter_id string, machine_id string, product_id string, operation_id string, chart_type string, "
                  "subgroup_size int, subgroup_method string, maximum_time_gap_seconds int, minimum_sample_size int, ruleset string, "
                  "is_active boolean, created_at timestamp_ntz")
SPECIFICATIONS = ("specification_id string, parameter_id string, machine_id string, product_id string, operation_id string, lsl double, usl double, "
                  "target double, effective_from timestamp_ntz, effective_to timestamp_ntz, status string")
BASELINES = ("baseline_id string, parameter_id string, machine_id string, product_id string, operation_id string, chart_type string, status string, "
             "mean double, within_sigma double, overall_sigma double, cp double, cpk double, pp double, ppk double, center_line double, ucl double, lcl double")


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(20 + (i * 7 % 11 - 5) / 100 + (0.5 if m == "m2" and i > 90 else 0), START + timedelta(minutes=i), "p", m, None, None, "o", "UH", i, f"{m}{i}")
            for m in ("m1", "m2") for i in range(100)]
    rows += [(1.0, START, "few", "m1", None, None, "o", "UH", 1, "f")]
    config = [("K1", "p", None, None, None, "AUTO", 5, "FIXED_SIZE", 3600, 20, "[]", True, START),
              ("K2", "p", "m1", None, None, "IMR", 1, "FIXED_SIZE", 3600, 20, "[]", False, START),
              ("K3", "few", None, None, None, "AUTO", 5, "FIXED_SIZE", 3600, 20, "[]", True, START)]
    spec = [("S1", "p", None, None, None, 19.5, 20.5, 20.0, START, None, "ACTIVE")]
    base = [(f"B{k}", "p", m, None, "o", chart, status, 20.0, 0.03, 0.03, 5.0, 5.0, 5.0, 5.0, 20.0, 20.05, 19.95)
            for k, (m, chart, status) in enumerate([("m1", "XBAR_R", "ACTIVE"), ("m2", "XBAR_R", "ACTIVE"), ("m1", "XBAR_R", "DRAFT"), ("m1", "IMR", "ACTIVE")])]
    base[3] = ("B3", "p", "m3", None, "o", "IMR", "ACTIVE", *base[3][7:])
    uploads = [("UH", "SILVER_COMPLETED", "HISTORICAL"), ("UC", "SILVER_COMPLETED", "CURRENT"), ("UV", "VALIDATING", "CURRENT"), ("UN", None, None)]
    return {
        "uploads": spark.createDataFrame(uploads, "upload_id string, status string, upload_type string"),
        "measurements": spark.createDataFrame(rows, MEASURED),
        "configurations": spark.createDataFrame(config, CONFIGURATIONS),
        "specifications": spark.createDataFrame(spec, SPECIFICATIONS),
        "baselines": spark.createDataFrame(base, BASELINES),
    }


def asked(spark, rows, choice):
    return spark.createDataFrame(
        rows, f"request_id string, upload_id string, parameter_id string, machine_id string, product_id string, operation_id string, {choice} string"
    )


def test_analysis_requests(spark, tables):
    rows = [
        ("own", "UH", "p", "m1", "", "o", None), ("twin", "UH", "p", "m1", None, "o", " "), ("chosen", "UH", "p", "m1", None, "o", "K2"),
        ("unknown choice", "UH", "p", "m1", None, "o", "K9"), ("no upload", "U?", "p", "m1", None, "o", None), ("null upload", None, "p", "m1", None, "o", None),
        ("not ready", "UV", "p", "m1", None, "o", None), ("no status", "UN", "p", "m1", None, "o", None), ("wrong type", "UC", "p", "m1", None, "o", None),
        ("no configuration", "UH", "q", "m1", None, "o", None), ("nothing measured", "UH", "p", "m9", None, "o", None),
        ("all machines", "UH", "p", None, None, None, None), ("too few", "UH", "few", "m1", None, "o", None),
    ]
    others = {k: tables[k] for k in ("uploads", "measurements", "configurations", "specifications")}
    done = run_analyses(asked(spark, rows, "spc_configuration_id"), **others, as_of=START)
    got = {r.request_id: (r.status, r.reason, r.chart_type) for r in done.requests.collect()}
    assert got == {
        "own": ("COMPLETED", None, "XBAR_R"), "twin": ("COMPLETED", None, "XBAR_R"), "chosen": ("COMPLETED", None, "IMR"),
        "unknown choice": ("REFUSED", "MISSING_CONFIGURATION", None), "no upload": ("REFUSED", "UPLOAD_NOT_FOUND", None),
        "null upload": ("REFUSED", "UPLOAD_NOT_FOUND", None), "not ready": ("REFUSED", "UPLOAD_NOT_READY", None),
        "no status": ("REFUSED", "UPLOAD_NOT_READY", None), "wrong type": ("REFUSED", "WRONG_UPLOAD_TYPE", None),
        "no configuration": ("REFUSED", "MISSING_CONFIGURATION", None), "nothing measured": ("REFUSED", "NO_MEASUREMENTS", None),
        "all machines": ("FAILED", "INCOMPATIBLE_CONTEXT", "IMR"), "too few": ("FAILED", "INSUFFICIENT_DATA", "IMR"),
    }
    # Two requests of one context and configuration share an analysis.
    assert done.analysis.summary.count() == 5


def test_check_requests(spark, tables):
    rows = [
        ("own", "UC", "p", "m1", None, "o", None), ("shifted", "UC", "p", "m2", None, "o", ""), ("chosen", "UC", "p", "m1", None, "o", "B0"),
        ("of another machine", "UC", "p", "m1", None, "o", "B1"), ("draft", "UC", "p", "m1", None, "o", "B2"), ("unknown", "UC", "p", "m1", None, "o", "B9"),
        ("no baseline", "UC", "few", "m1", None, "o", None), ("historical", "UH", "p", "m1", None, "o", None), ("not ready", "UV", "p", "m1", None, "o", None),
        ("no configuration", "UC", "q", "m1", None, "o", "B0"), ("nothing measured", "UC", "p", "m3", None, "o", None),
        ("too few", "UC", "few", "m1", None, "o", "B0"),
    ]
    done = run_checks(asked(spark, rows, "baseline_id"), **tables, as_of=START)
    got = {r.request_id: (r.status, r.reason, r.mismatches) for r in done.requests.collect()}
    assert {k: v[:2] for k, v in got.items()} == {
        "own": ("COMPLETED", None), "shifted": ("COMPLETED", None), "chosen": ("COMPLETED", None),
        "of another machine": ("FAILED", "BASELINE_CONTEXT_MISMATCH"), "draft": ("REFUSED", "MISSING_ACTIVE_BASELINE"),
        "unknown": ("REFUSED", "MISSING_ACTIVE_BASELINE"), "no baseline": ("REFUSED", "MISSING_ACTIVE_BASELINE"),
        "historical": ("REFUSED", "WRONG_UPLOAD_TYPE"), "not ready": ("REFUSED", "UPLOAD_NOT_READY"),
        "no configuration": ("REFUSED", "MISSING_CONFIGURATION"), "nothing measured": ("REFUSED", "NO_MEASUREMENTS"),
        "too few": ("FAILED", "INSUFFICIENT_DATA"),
    }
    assert got["of another machine"][2] == ["machine"]
    final = {r.request_id: r.final_status for r in done.requests.collect()}
    assert final["own"] == final["chosen"] and final["shifted"] in ("OUT_OF_CONTROL", "CRITICAL") and final["draft"] is None


def test_no_requests(spark, tables):
    others = {k: tables[k] for k in ("uploads", "measurements", "configurations", "specifications")}
    assert run_analyses(asked(spark, [], "spc_configuration_id"), **others, as_of=START).requests.count() == 0
    assert run_checks(asked(spark, [], "baseline_id"), **tables, as_of=START).requests.count() == 0
