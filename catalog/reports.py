"""Histories, listings, dashboards and assembled reports."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import SPECIFICATIONS, r6, specifications, table, text
from gaugeline.operators.listing import (
    active_dimension, history_page, newest, oldest, specifications_of, violations_of,
)
from gaugeline.plans.reports import (
    analysis_history, analysis_report, check_history, check_report, dashboard_counts, merged_rows, recent_rows,
    report_violations,
)

# Runs, results, checks and findings as rows of the event stream.
RUNS = """
SELECT 'A' || event_id AS analysis_id, CASE WHEN event_id % 4 = 0 THEN 'MANUAL_CHECK_CURRENT' ELSE 'HISTORICAL' END AS analysis_type,
       'M' || (user_id % 3) AS machine_id, event_type AS parameter_id, 'IMR' AS chart_type,
       CASE WHEN event_id % 10 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, ts AS created_at FROM events WHERE event_id % 2 = 0
"""
RESULTS = """
SELECT 'A' || (2 * (event_id % 4000)) AS analysis_id, event_id AS result_id, ts AS created_at, value / 100 AS cpk, value / 120 AS ppk,
       CASE WHEN value > 90 THEN 'OUT_OF_CONTROL' WHEN value > 45 THEN 'WARNING' ELSE 'IN_CONTROL' END AS stability_status FROM events
"""
CHECKS = """
SELECT 'C' || event_id AS manual_check_id, 'B' || (event_id % 100) AS baseline_id, 'M' || (user_id % 3) AS machine_id, event_type AS parameter_id,
       'A' || (event_id % 500) AS current_analysis_id, CASE WHEN event_id % 9 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
       CASE WHEN event_id % 9 = 0 THEN NULL WHEN value > 120 THEN 'CRITICAL' WHEN value > 90 THEN 'OUT_OF_CONTROL' WHEN value > 45 THEN 'WARNING'
            ELSE 'NORMAL' END AS final_status, ts AS created_at FROM events WHERE event_id % 2 = 1
"""
COMPARISONS = "SELECT 'C' || event_id AS manual_check_id, value / 80 AS current_cpk, value / 90 AS current_ppk FROM events WHERE event_id % 6 = 1"


def runs(spark, sf_dir):
    key, events = F.col("event_id"), table(spark, sf_dir, "events")
    return events.filter(key % 2 == 0).select(
        text("A", key).alias("analysis_id"), F.when(key % 4 == 0, "MANUAL_CHECK_CURRENT").otherwise("HISTORICAL").alias("analysis_type"),
        text("M", F.col("user_id") % 3).alias("machine_id"), F.col("event_type").alias("parameter_id"), F.lit("IMR").alias("chart_type"),
        F.when(key % 10 == 0, "FAILED").otherwise("COMPLETED").alias("status"), F.col("ts").alias("created_at"),
    )


def results(spark, sf_dir):
    key, value = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        text("A", key % 4000 * 2).alias("analysis_id"), key.alias("result_id"), F.col("ts").alias("created_at"),
        (value / 100).alias("cpk"), (value / 120).alias("ppk"),
        F.when(value > 90, "OUT_OF_CONTROL").when(value > 45, "WARNING").otherwise("IN_CONTROL").alias("stability_status"),
    )


def checks(spark, sf_dir):
    key, value = F.col("event_id"), F.col("value")
    verdict = F.when(key % 9 == 0, F.lit(None)).when(value > 120, "CRITICAL").when(value > 90, "OUT_OF_CONTROL")
    return table(spark, sf_dir, "events").filter(key % 2 == 1).select(
        text("C", key).alias("manual_check_id"), text("B", key % 100).alias("baseline_id"), text("M", F.col("user_id") % 3).alias("machine_id"),
        F.col("event_type").alias("parameter_id"), text("A", key % 500).alias("current_analysis_id"),
        F.when(key % 9 == 0, "FAILED").otherwise("COMPLETED").alias("status"),
        verdict.when(value > 45, "WARNING").otherwise("NORMAL").alias("final_status"), F.col("ts").alias("created_at"),
    )


def comparisons(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_id % 6 = 1").select(
        text("C", F.col("event_id")).alias("manual_check_id"), (F.col("value") / 80).alias("current_cpk"),
        (F.col("value") / 90).alias("current_ppk"),
    )


HISTORY = f"""
r AS ({RUNS}), s AS ({RESULTS}), latest AS (SELECT analysis_id, arg_max(cpk, created_at) AS cpk, arg_max(ppk, created_at) AS ppk,
   arg_max(stability_status, created_at) AS stability_status FROM s GROUP BY analysis_id),
k AS ({CHECKS}), c AS ({COMPARISONS})
"""


@query(
    "j9_analysis_history",
    f"""
WITH {HISTORY}, t AS (SELECT * FROM r WHERE analysis_type = 'HISTORICAL' AND machine_id = 'M1' ORDER BY created_at DESC LIMIT 200)
SELECT t.analysis_id, t.parameter_id, t.status, t.created_at, round(cpk, 6) AS cpk, round(ppk, 6) AS ppk, stability_status
FROM t LEFT JOIN latest USING (analysis_id)
""",
)
def history_of_analyses(spark, sf_dir):
    df = analysis_history(runs(spark, sf_dir), results(spark, sf_dir), 200, analysis_type="HISTORICAL", machine_id="M1")
    return df.select("analysis_id", "parameter_id", "status", "created_at", r6("cpk"), r6("ppk"), "stability_status")


@query(
    "j10_check_history",
    f"""
WITH {HISTORY}, t AS (SELECT * FROM k WHERE parameter_id = 'click' ORDER BY created_at DESC LIMIT 50)
SELECT t.manual_check_id, t.status, t.final_status, t.created_at, round(current_cpk, 6) AS current_cpk, round(current_ppk, 6) AS current_ppk
FROM t LEFT JOIN c USING (manual_check_id)
""",
)
def history_of_checks(spark, sf_dir):
    df = check_history(checks(spark, sf_dir), comparisons(spark, sf_dir), parameter_id="click")
    return df.select("manual_check_id", "status", "final_status", "created_at", r6("current_cpk"), r6("current_ppk"))


@query("t1_run_history", f"WITH r AS ({RUNS}) SELECT analysis_id, created_at FROM r ORDER BY created_at DESC LIMIT 50")
def run_history(spark, sf_dir):
    return newest(runs(spark, sf_dir), limit=50, tie="analysis_id").select("analysis_id", "created_at")


@query(
    "t2_baseline_list",
    f"WITH k AS ({CHECKS}) SELECT manual_check_id AS baseline_id, created_at FROM k WHERE parameter_id = 'view' AND final_status = 'WARNING' ORDER BY created_at DESC LIMIT 100",
)
def baseline_list(spark, sf_dir):
    df = checks(spark, sf_dir).withColumnRenamed("manual_check_id", "baseline_id_")
    df = newest(df, {"parameter_id": "view", "final_status": "WARNING", "machine_id": None}, tie="baseline_id_")
    return df.select(F.col("baseline_id_").alias("baseline_id"), "created_at")


FINDINGS = """
SELECT 'F' || event_id AS finding_id, 'C' || (user_id * 2 + 1) AS manual_check_id, upper(event_type) AS finding_type,
       CASE WHEN value > 90 THEN 'CRITICAL' WHEN value > 45 THEN 'WARNING' ELSE 'INFO' END AS severity, ts AS created_at FROM events
"""


def finding_rows(spark, sf_dir):
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        text("F", F.col("event_id")).alias("finding_id"), text("C", F.col("user_id") * 2 + 1).alias("manual_check_id"),
        F.upper("event_type").alias("finding_type"),
        F.when(value > 90, "CRITICAL").when(value > 45, "WARNING").otherwise("INFO").alias("severity"), F.col("ts").alias("created_at"),
    )


@query(
    "t3_finding_list",
    f"SELECT finding_id, created_at FROM ({FINDINGS}) WHERE severity = 'CRITICAL' AND finding_type = 'CLICK' ORDER BY created_at DESC LIMIT 500",
)
def finding_list(spark, sf_dir):
    df = newest(finding_rows(spark, sf_dir), {"severity": "CRITICAL", "finding_type": "CLICK"}, 500, "finding_id")
    return df.select("finding_id", "created_at")


@query("t4_findings_of_check", f"SELECT finding_id, severity, created_at FROM ({FINDINGS}) WHERE manual_check_id = 'C7'")
def findings_of_check(spark, sf_dir):
    df = oldest(finding_rows(spark, sf_dir), {"manual_check_id": "C7"}, "finding_id")
    return df.select("finding_id", "severity", "created_at")


VIOLATIONS = """
SELECT 'A' || (2 * user_id) AS analysis_id, CAST(event_id AS BIGINT) AS start_index, CAST(event_id + 7 AS BIGINT) AS end_index,
       CASE WHEN event_id % 3 = 0 THEN 'RUN_SAME_SIDE' ELSE 'POINT_OUTSIDE_LIMITS' END AS rule_name FROM events WHERE event_id % 5 = 0
"""


def violation_table(spark, sf_dir):
    key = F.col("event_id")
    return table(spark, sf_dir, "events").filter(key % 5 == 0).select(
        text("A", F.col("user_id") * 2).alias("analysis_id"), key.alias("start_index"), (key + 7).alias("end_index"),
        F.when(key % 3 == 0, "RUN_SAME_SIDE").otherwise("POINT_OUTSIDE_LIMITS").alias("rule_name"),
    )


@query("t4_violations_of_analysis", f"SELECT * FROM ({VIOLATIONS}) WHERE analysis_id = 'A8'")
def violations_of_analysis(spark, sf_dir):
    return violations_of(violation_table(spark, sf_dir), "analysis_id", "A8")


@query(
    "t5_alert_list",
    f"SELECT finding_id AS alert_id, created_at FROM ({FINDINGS}) WHERE severity = 'WARNING' ORDER BY created_at DESC LIMIT 100",
)
def alert_list(spark, sf_dir):
    df = finding_rows(spark, sf_dir).select(
        F.col("finding_id").alias("alert_id"), F.col("severity").alias("status"), "created_at"
    )
    return newest(df, {"status": "WARNING"}, tie="alert_id").select("alert_id", "created_at")


@query(
    "t6_upload_list",
    "SELECT 'U' || event_id AS upload_id, ts AS created_at FROM events WHERE event_type = 'view' ORDER BY ts DESC LIMIT 50",
)
def upload_list(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(
        text("U", F.col("event_id")).alias("upload_id"), F.col("event_type").alias("upload_type"), F.col("ts").alias("created_at")
    )
    return newest(df, {"upload_type": "view"}, 50, "upload_id").select("upload_id", "created_at")


@query(
    "t7_dimension_list",
    "SELECT s_suppkey, 'N' || s_nationkey AS plant_id FROM supplier WHERE s_suppkey % 4 <> 0 AND s_nationkey = 3",
)
def dimension_list(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select(
        "s_suppkey", text("N", F.col("s_nationkey")).alias("plant_id"), text("Machine ", F.col("s_suppkey")).alias("name"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("sequence_number"),
        (F.col("s_suppkey") % 4 != 0).alias("active"),
    )
    return active_dimension(df, {"plant_id": "N3", "organization_id": None}, ("sequence_number", "name")).select("s_suppkey", "plant_id")


@query(
    "t8_specification_list",
    f"""
SELECT specification_id, effective_from, CAST((SELECT count(*) FROM events e WHERE e.event_type = s.parameter_id) AS BIGINT) AS measurements
FROM ({SPECIFICATIONS}) s WHERE parameter_id = 'click'
""",
)
def specification_list(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("parameter_id")).agg(F.count("*").alias("measurements"))
    listed = specifications_of(specifications(spark), "click")
    return listed.join(counts, "parameter_id", "left").select("specification_id", "effective_from", "measurements")


@query(
    "t8_configuration_list",
    """
SELECT 'K' || event_id AS spc_configuration_id, ts AS created_at FROM events ORDER BY ts DESC
""",
)
def configuration_list(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(
        text("K", F.col("event_id")).alias("spc_configuration_id"), F.col("ts").alias("created_at")
    )
    return df.orderBy(F.desc("created_at"))


MERGED = f"""
{HISTORY},
ra AS (SELECT r.*, cpk, stability_status FROM r LEFT JOIN latest USING (analysis_id)),
kc AS (SELECT k.*, current_cpk FROM k LEFT JOIN c USING (manual_check_id))
"""
UNION_SQL = """
SELECT analysis_id AS id, 'HISTORICAL' AS type, machine_id, parameter_id, chart_type, cpk, coalesce(stability_status, status) AS status, created_at FROM {a}
UNION ALL SELECT manual_check_id, 'MONITORING', machine_id, parameter_id, NULL, current_cpk, coalesce(final_status, status), created_at FROM {k}
"""


def both(spark, sf_dir, limit):
    analyses = analysis_history(runs(spark, sf_dir), results(spark, sf_dir), limit, analysis_type="HISTORICAL")
    return analyses, check_history(checks(spark, sf_dir), comparisons(spark, sf_dir), limit)


def latest_sql(limit):
    return f"""{MERGED},
la AS (SELECT * FROM ra WHERE analysis_type = 'HISTORICAL' ORDER BY created_at DESC LIMIT {limit}),
lk AS (SELECT * FROM kc ORDER BY created_at DESC LIMIT {limit}),
u AS ({UNION_SQL.format(a='la', k='lk')})"""


ROW = "id, type, machine_id, parameter_id, chart_type, round(cpk, 6) AS cpk, status, created_at"


@query("u1_recent_rows", f"WITH {latest_sql(100)} SELECT {ROW} FROM u ORDER BY created_at DESC LIMIT 10")
def recent(spark, sf_dir):
    df = recent_rows(*both(spark, sf_dir, 100))
    return df.select("id", "type", "machine_id", "parameter_id", "chart_type", r6("cpk"), "status", "created_at")


@query(
    "u1_merged_rows",
    f"WITH {MERGED}, u AS ({UNION_SQL.format(a='ra', k='kc')}) SELECT {ROW} FROM u",
)
def merged(spark, sf_dir):
    analyses = analysis_history(runs(spark, sf_dir), results(spark, sf_dir), None)
    df = merged_rows(analyses, check_history(checks(spark, sf_dir), comparisons(spark, sf_dir), None))
    return df.select("id", "type", "machine_id", "parameter_id", "chart_type", r6("cpk"), "status", "created_at")


@query(
    "a16_dashboard_counts",
    f"""
WITH {latest_sql(100)}
SELECT CAST(count(*) FILTER (status IN ('IN_CONTROL', 'NORMAL')) AS BIGINT) AS stable_count, CAST(count(*) FILTER (status = 'WARNING') AS BIGINT) AS warning_count,
       CAST(count(*) FILTER (status IN ('OUT_OF_CONTROL', 'CRITICAL')) AS BIGINT) AS critical_count, CAST(count(*) AS BIGINT) AS total_analyses FROM u
""",
)
def dashboard(spark, sf_dir):
    return dashboard_counts(*both(spark, sf_dir, 100))


@query(
    "t9_history_page",
    f"WITH {latest_sql(200)} SELECT id, type, status, created_at FROM u WHERE type = 'MONITORING' AND lower(id) LIKE '%9%' ORDER BY created_at DESC LIMIT 15 OFFSET 15",
)
def page(spark, sf_dir):
    rows = merged_rows(*both(spark, sf_dir, 200))
    return history_page(rows, kind="MONITORING", search=" 9 ", page=2).select("id", "type", "status", "created_at")


STORED = """
st AS (SELECT 'A' || event_id AS analysis_id, value AS cpk, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value * 2 END AS usl,
              CASE WHEN event_id % 6 = 0 THEN NULL ELSE value * 3 END AS scl FROM events)
"""


def stored(spark, sf_dir):
    key, value = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        text("A", key).alias("analysis_id"), F.col("ts").alias("created_at"), value.alias("cpk"), F.lit(None).cast("double").alias("lsl"),
        F.when(key % 3 != 0, value * 2).alias("usl"), F.when(key % 6 != 0, value * 3).alias("secondary_center_line"),
    )


def parameters(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("parameter_id"), F.when(F.col("event_type") != "view", "mm").alias("unit")
    ).distinct()


@query(
    "j12_analysis_report",
    f"""
WITH r AS ({RUNS}), v AS ({VIOLATIONS}), {STORED},
vc AS (SELECT analysis_id, count(*) AS n, min(start_index) AS f FROM v GROUP BY 1)
SELECT r.analysis_id, r.parameter_id, r.status, CASE WHEN r.parameter_id = 'view' THEN '' ELSE 'mm' END AS unit, round(3 * cpk, 6) AS sigma_level_short_term,
       round(3 * cpk - 1.5, 6) AS sigma_level_long_term, CAST(coalesce(n, 0) AS BIGINT) AS violation_count, usl IS NOT NULL AS has_specification, scl IS NOT NULL AS has_secondary_chart
FROM r JOIN st USING (analysis_id) LEFT JOIN vc USING (analysis_id)
""",
)
def report(spark, sf_dir):
    df = analysis_report(runs(spark, sf_dir), stored(spark, sf_dir), violation_table(spark, sf_dir), parameters(spark, sf_dir))
    return df.select("analysis_id", "parameter_id", "status", "unit", r6("sigma_level_short_term"), r6("sigma_level_long_term"),
                     "violation_count", "has_specification", "has_secondary_chart")


@query(
    "j12_report_violations",
    f"WITH r AS ({RUNS}), v AS ({VIOLATIONS}) SELECT * FROM v WHERE analysis_id IN (SELECT analysis_id FROM r WHERE machine_id = 'M1')",
)
def violations_of_reports(spark, sf_dir):
    return report_violations(runs(spark, sf_dir).filter("machine_id = 'M1'"), violation_table(spark, sf_dir))


@query(
    "j13_check_report",
    f"""
WITH k AS ({CHECKS}), f AS ({FINDINGS}), {STORED},
b AS (SELECT 'B' || event_id AS baseline_id, value AS bmean FROM events),
fc AS (SELECT manual_check_id, string_agg(finding_type || ':' || severity, ',' ORDER BY finding_id) AS fs FROM f GROUP BY 1)
SELECT k.manual_check_id, CASE WHEN k.parameter_id = 'view' THEN coalesce(CASE WHEN b.baseline_id IS NOT NULL THEN 'inch' END, '') ELSE 'mm' END AS unit,
       coalesce(final_status, 'NORMAL') AS final_status, round(bmean, 6) AS baseline_mean, round(st.cpk, 6) AS current_cpk, coalesce(fs, '') AS findings,
       CASE WHEN regexp_replace(k.manual_check_id, 'C', '')::BIGINT % 6 = 1 THEN true ELSE false END AS mean_shift_detected
FROM k LEFT JOIN b USING (baseline_id) LEFT JOIN st ON st.analysis_id = k.current_analysis_id LEFT JOIN fc USING (manual_check_id)
""",
)
def check_reports(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    none = F.lit(None).cast("double")
    base = events.select(
        text("B", F.col("event_id")).alias("baseline_id"), F.col("value").alias("mean"), F.lit("inch").alias("unit"), F.lit("IMR").alias("chart_type"),
        *[none.alias(c) for c in ("center_line", "ucl", "lcl", "within_sigma", "overall_sigma", "cp", "cpk", "pp", "ppk", "lsl", "usl", "target")],
    )
    current = stored(spark, sf_dir).select(
        "analysis_id", "cpk",
        *[none.alias(c) for c in ("mean", "within_sigma", "overall_sigma", "cp", "pp", "ppk", "center_line", "ucl", "lcl")],
    )
    deltas = comparisons(spark, sf_dir).select(
        "manual_check_id",
        *[none.alias(c) for c in ("mean_shift", "mean_shift_percentage", "within_variation_change_percentage",
                                  "overall_variation_change_percentage", "cpk_change", "ppk_change")],
        F.lit(True).alias("mean_shift_detected"),
        *[F.lit(False).alias(f"{c}_detected") for c in ("variation_increase", "variation_reduction", "capability_improvement",
                                                        "capability_degradation")],
    )
    found = finding_rows(spark, sf_dir).withColumn("finding_number", F.col("finding_id"))
    hits = violation_table(spark, sf_dir).withColumnRenamed("analysis_id", "manual_check_id")
    df = check_report(checks(spark, sf_dir), base, current, deltas, hits, found, parameters(spark, sf_dir))
    shown = F.array_join(F.transform("findings", lambda f: F.concat(f["finding_type"], F.lit(":"), f["severity"])), ",")
    return df.select("manual_check_id", "unit", "final_status", r6("baseline_mean"), r6("current_cpk"),
                     F.coalesce(shown, F.lit("")).alias("findings"), "mean_shift_detected")
