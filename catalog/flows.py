"""Whole dataflows: analysis, baselines, manual checks, alerts, result tables."""

import uuid

from pyspark.sql import functions as F

from catalog.charts import COUNTS
from catalog.registry import query
from catalog.sqltext import CHARTS, rules, subgroups
from catalog.statistics import CONFIG_JOIN, SPEC_JOIN, as_of, contexts
from catalog.tables import (
    CTX_SQL, MEASUREMENTS, configurations, measurements, r6, specifications, table, text,
)
from gaugeline.functions.compare import finding_messages, metric_table, percent_change
from gaugeline.operators.layout import context, materialize, scratch_root, unpack
from gaugeline.operators.rules import with_messages
from gaugeline.plans.analysis import (
    SpcConfig, analysis_runs, analyze, historical_analysis, resolved_settings, stored_results,
)
from gaugeline.plans.baseline import approve, archive, create_drafts, draft_rejection
from gaugeline.plans.check import affected_indices, eligible_uploads, mismatches, run_check
from gaugeline.plans.ledger import alert_state
from gaugeline.plans.requests import run_analyses, run_checks
from gaugeline.schema import CONTEXT
from gaugeline.sources.results import (
    append_alerts, append_chart_points, append_comparisons, append_findings, append_results, append_violations,
)

ROWS = ("source_row_number", "measurement_id")


def folder(spark, name):
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Analysis with the configuration and specification of each context.

CUSTOM = "k LIKE 'click|M0|%'"
CUSTOM_RULES = rules(
    trend_up=f"(CASE WHEN {CUSTOM} THEN 3 ELSE 7 END)",
    trend_down=f"(CASE WHEN {CUSTOM} THEN 100000000 ELSE 7 END)",
    run=f"(CASE WHEN {CUSTOM} THEN 100000000 ELSE 8 END)",
)
KEYED = """
ck AS (SELECT *, parameter_id || '|' || machine_id || '|' || operation_id AS k FROM conf),
sk AS (SELECT *, parameter_id || '|' || machine_id || '|' || operation_id AS k FROM spec),
"""
ELIGIBLE = """
SELECT ck.k, subgroup_size AS size, subgroup_method AS method, gap, chart_type AS chart FROM ck
WHERE (SELECT count(*) FROM m WHERE m.k = ck.k) >= minimum_sample_size
"""


def analysis_sql(config_join=CONFIG_JOIN, spec_join=SPEC_JOIN):
    return (
        subgroups(ELIGIBLE, before=f"{config_join}, {spec_join}, {KEYED}")
        + CHARTS
        + CUSTOM_RULES
        + COUNTS
        + """,
tot AS (SELECT k, count(*) AS n, avg(value) AS mean, min(value) AS minimum, max(value) AS maximum, stddev_samp(value) AS os FROM m GROUP BY k),
fin AS (SELECT tot.*, ck.chart_type AS configured, ck.minimum_sample_size, ck.spc_configuration_id, lim.kind, lim.used, lim.pc, gm, ucl, lcl, scl, sucl, slcl, ws,
               sk.lsl, sk.usl, sk.specification_id, pv, tv, sv, ch.formed, ch.kind AS chosen, ck.k AS cfg_k
        FROM tot LEFT JOIN ck USING (k) LEFT JOIN ch USING (k) LEFT JOIN lim USING (k) LEFT JOIN sk USING (k) LEFT JOIN vc USING (k)),
cap AS (SELECT *, (usl - mean) / (3 * nullif(ws, 0)) AS cpu, (mean - lsl) / (3 * nullif(ws, 0)) AS cpl,
               (usl - lsl) / (6 * nullif(ws, 0)) AS cp, (usl - mean) / (3 * nullif(os, 0)) AS ppu,
               (mean - lsl) / (3 * nullif(os, 0)) AS ppl, (usl - lsl) / (6 * nullif(os, 0)) AS pp,
               CASE WHEN cfg_k IS NULL THEN 'MISSING_CONFIGURATION' WHEN n < minimum_sample_size THEN 'INSUFFICIENT_DATA'
                    WHEN coalesce(formed, 0) < 2 THEN 'INVALID_SUBGROUP_SIZE' WHEN chosen IS NULL THEN 'CHART_SELECTION'
                    WHEN ws IS NULL THEN 'UNSUPPORTED_SIZE' END AS error_code FROM fin)
"""
    )


ANALYSIS = analysis_sql()


def full(spark, sf_dir):
    rows = measurements(spark, sf_dir)
    settings = resolved_settings(contexts(spark, sf_dir), configurations(spark), specifications(spark), as_of())
    return analyze(rows, settings, row_columns=ROWS)


@query(
    "f2_full_analysis",
    ANALYSIS + f"""
SELECT {CTX_SQL}, error_code, kind AS chart_type, CAST(coalesce(used, 0) AS BIGINT) AS size_used, CAST(n AS BIGINT) AS valid_observations,
       round(mean, 6) AS mean, round(os, 6) AS overall_sigma, round(ws, 6) AS within_sigma, round(gm, 6) AS center_line,
       round(ucl, 6) AS ucl, round(lcl, 6) AS lcl, round(sucl, 6) AS secondary_ucl, round(slcl, 6) AS secondary_lcl,
       CASE WHEN error_code IS NULL THEN round(cp, 6) END AS cp, CASE WHEN error_code IS NULL THEN round(least(cpu, cpl), 6) END AS cpk,
       CASE WHEN error_code IS NULL THEN round(pp, 6) END AS pp, CASE WHEN error_code IS NULL THEN round(least(ppu, ppl), 6) END AS ppk,
       CASE WHEN error_code IS NULL THEN CASE WHEN coalesce(pv, 0) > 0 THEN 'OUT_OF_CONTROL' WHEN coalesce(tv + sv, 0) > 0 THEN 'WARNING'
            ELSE 'IN_CONTROL' END END AS stability_status,
       CASE WHEN error_code IS NULL THEN CAST(coalesce(pv + tv + sv, 0) AS BIGINT) ELSE 0 END AS violation_count
FROM cap JOIN ids USING (k)
""",
)
def full_analysis(spark, sf_dir):
    return unpack(full(spark, sf_dir).summary).select(
        *CONTEXT, "error_code", "chart_type", F.coalesce("size_used", F.lit(0)).alias("size_used"), "valid_observations",
        *[r6(c) for c in ("mean", "overall_sigma", "within_sigma", "center_line", "ucl", "lcl", "secondary_ucl",
                          "secondary_lcl", "cp", "cpk", "pp", "ppk")],
        "stability_status", F.coalesce("violation_count", F.lit(0)).alias("violation_count"),
    )


NARROW_CONTEXTS = f"SELECT DISTINCT parameter_id, machine_id, NULL::VARCHAR AS product_id, operation_id FROM ({MEASUREMENTS})"
WIDE_CONTEXTS = f"SELECT DISTINCT parameter_id, machine_id, NULL::VARCHAR AS product_id, NULL::VARCHAR AS operation_id FROM ({MEASUREMENTS})"


@query(
    "f3_historical_analysis",
    analysis_sql(
        CONFIG_JOIN.replace(f"SELECT DISTINCT {CTX_SQL} FROM ({MEASUREMENTS})", NARROW_CONTEXTS),
        SPEC_JOIN.replace(f"SELECT DISTINCT {CTX_SQL} FROM ({MEASUREMENTS})", NARROW_CONTEXTS),
    )
    + f"""
SELECT parameter_id, machine_id, NULL AS product_id, operation_id, CASE WHEN error_code IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status,
       error_code, CASE WHEN error_code IS NULL THEN kind WHEN configured = 'AUTO' THEN 'IMR' ELSE configured END AS chart_type,
       spc_configuration_id FROM cap JOIN ids USING (k)
UNION ALL
SELECT parameter_id, machine_id, NULL, NULL, 'FAILED', CASE WHEN parameter_id = 'signup' THEN 'MISSING_CONFIGURATION' ELSE 'INCOMPATIBLE_CONTEXT' END,
       CASE WHEN parameter_id = 'signup' THEN NULL WHEN parameter_id = 'error' THEN CASE machine_id WHEN 'M0' THEN 'XBAR_S' ELSE 'IMR' END
            WHEN parameter_id = 'view' AND machine_id = 'M2' THEN 'XBAR_R' ELSE 'IMR' END,
       CASE parameter_id WHEN 'click' THEN CASE machine_id WHEN 'M0' THEN 'C07' ELSE 'C01' END
            WHEN 'view' THEN CASE machine_id WHEN 'M2' THEN 'C03' ELSE 'C02' END WHEN 'purchase' THEN 'C04'
            WHEN 'error' THEN CASE machine_id WHEN 'M0' THEN 'C06' ELSE 'C05' END END
FROM ({WIDE_CONTEXTS})
""",
)
def historical(spark, sf_dir):
    m = measurements(spark, sf_dir)
    none = F.lit(None).cast("string")
    narrow = m.select("parameter_id", "machine_id", none.alias("product_id"), "operation_id").distinct()
    wide = m.select("parameter_id", "machine_id", none.alias("product_id"), none.alias("operation_id")).distinct()
    done = historical_analysis(
        m, narrow.unionByName(wide), configurations(spark), specifications(spark), as_of(), row_columns=ROWS
    )
    return unpack(analysis_runs(done)).select(*CONTEXT, "status", "error_code", "chart_type", "spc_configuration_id")


# Baseline on the first half of the month, check on the second half.

SPLIT = "2024-01-16"
PLAIN = SpcConfig(subgroup_size=5, maximum_time_gap_seconds=14400, lsl=-50.0, usl=200.0)


def half_sql(before_split):
    sign = "<" if before_split else ">="
    return f"SELECT * FROM ({MEASUREMENTS}) WHERE event_timestamp {sign} TIMESTAMP '{SPLIT}'"


ONE_CONFIG = """
SELECT k, 5 AS size, 'CONSECUTIVE' AS method, 14400 AS gap, 'AUTO' AS chart FROM m GROUP BY k HAVING count(*) >= 20
"""
STATS = """,
tot AS (SELECT k, avg(value) AS mean, stddev_samp(value) AS os, count(*) AS n FROM m GROUP BY k),
st AS (SELECT lim.*, tot.mean, os, n, 250.0 / (6 * nullif(ws, 0)) AS cp, least((200 - mean) / (3 * nullif(ws, 0)), (mean + 50) / (3 * nullif(ws, 0))) AS cpk,
              250.0 / (6 * os) AS pp, least((200 - mean) / (3 * os), (mean + 50) / (3 * os)) AS ppk FROM lim JOIN tot USING (k))"""
WHOLE = subgroups(ONE_CONFIG, f"SELECT * FROM ({MEASUREMENTS})") + CHARTS + STATS
HISTORIC = subgroups(ONE_CONFIG, half_sql(True)) + CHARTS + STATS + f" SELECT st.*, {CTX_SQL} FROM st JOIN ids USING (k)"
CHECKED = (
    subgroups(ONE_CONFIG, half_sql(False), before=f"h AS ({HISTORIC}), ")
    + CHARTS
    + STATS
    + """,
frozen AS (SELECT h.k, h.kind, h.gm, h.ucl, h.lcl FROM h JOIN st ON st.k = h.k AND st.kind = h.kind)"""
    + rules("frozen")
    + COUNTS
    + """,
cmp AS (SELECT h.k, h.mean AS bm, st.mean AS cm, h.ws AS bw, st.ws AS cw, h.os AS bo, st.os AS co, h.cpk AS bk, st.cpk AS ck, h.ppk AS bp, st.ppk AS cpp,
               h.cp AS bcp, st.cp AS ccp, h.pp AS bpp, st.pp AS cpp2,
               coalesce(pv, 0) AS pv, coalesce(tv, 0) AS tv, coalesce(sv, 0) AS sv
        FROM h JOIN st ON st.k = h.k AND st.kind = h.kind LEFT JOIN vc ON vc.k = h.k),
fl AS (SELECT *, cm - bm AS shift, (cm - bm) / nullif(abs(bm), 0) * 100 AS shift_pct, (cw - bw) / nullif(abs(bw), 0) * 100 AS w_pct,
              (co - bo) / nullif(abs(bo), 0) * 100 AS o_pct, ck - bk AS k_change, cpp - bp AS p_change,
              bw > 0 AND abs(cm - bm) >= bw AS f_shift, coalesce((cw - bw) / nullif(abs(bw), 0) * 100 >= 10, false) AS f_up,
              coalesce((cw - bw) / nullif(abs(bw), 0) * 100 <= -10, false) AS f_down, coalesce(ck - bk <= -0.2, false) AS f_worse,
              coalesce(ck - bk >= 0.2, false) AS f_better FROM cmp),
verdict AS (SELECT *, CASE WHEN (pv > 0)::INT + (f_worse AND ck < 1)::INT + (f_worse AND k_change <= -0.5)::INT + (f_shift AND f_up)::INT >= 2 THEN 'CRITICAL'
                  WHEN pv > 0 THEN 'OUT_OF_CONTROL' WHEN f_shift OR f_up OR f_worse OR tv + sv > 0 THEN 'WARNING'
                  WHEN ck < 1.33 THEN 'WARNING' ELSE 'NORMAL' END AS final_status FROM fl),
fd AS (SELECT k, final_status, unnest(list_filter([
    CASE WHEN f_shift THEN 'MEAN_SHIFT:WARNING' END, CASE WHEN f_up THEN 'VARIATION_INCREASE:WARNING' END,
    CASE WHEN f_down THEN 'VARIATION_REDUCTION:INFO' END, CASE WHEN f_worse THEN 'CAPABILITY_DEGRADATION:WARNING' END,
    CASE WHEN f_better THEN 'CAPABILITY_IMPROVEMENT:INFO' END, CASE WHEN pv > 0 THEN 'NEW_LIMIT_VIOLATION:CRITICAL' END,
    CASE WHEN tv > 0 THEN 'TREND_DETECTED:WARNING' END, CASE WHEN sv > 0 THEN 'SHIFT_DETECTED:WARNING' END,
    CASE WHEN NOT (f_shift OR f_up OR f_down OR f_worse OR f_better OR pv > 0 OR tv > 0 OR sv > 0) THEN 'PROCESS_STABLE:INFO' END
   ], lambda x: x IS NOT NULL)) AS f FROM verdict)
"""
)


def halves(spark, sf_dir):
    rows = measurements(spark, sf_dir)
    split = F.lit(SPLIT).cast("timestamp_ntz")
    return rows.filter(F.col("event_timestamp") < split), rows.filter(F.col("event_timestamp") >= split)


def run_tables(rows):
    """Runs and results of an analysis, as the stored tables hold them."""
    done = analyze(rows, PLAIN, row_columns=ROWS).saved()
    ids = done.profile.select(
        "ctx", F.concat_ws("|", "ctx.parameter_id", "ctx.machine_id", "ctx.operation_id").alias("analysis_id")
    )
    results = stored_results(done, ids)
    none = F.lit(None).cast("string")
    runs = unpack(analysis_runs(done).join(ids, "ctx")).withColumns(
        {c: none for c in ("organization_id", "plant_id", "production_line_id", "process_id")}
    ).withColumn("created_at", F.lit(SPLIT).cast("timestamp_ntz"))
    return runs, results


def baselines_of(spark, sf_dir):
    runs, results = run_tables(halves(spark, sf_dir)[0])
    return create_drafts(runs, results).filter("rejection IS NULL").withColumn("status", F.lit("ACTIVE"))


@query(
    "f4_draft_baselines",
    f"""
SELECT 'B-' || k AS baseline_id, {CTX_SQL}, kind AS chart_type, CAST(n AS BIGINT) AS sample_count, round(mean, 6) AS mean,
       round(ws, 6) AS within_sigma, round(ucl, 6) AS ucl, round(cpk, 6) AS cpk, round(ppk, 6) AS ppk, 'DRAFT' AS status
FROM ({WHOLE} SELECT st.*, {CTX_SQL} FROM st JOIN ids USING (k))
""",
)
def drafts(spark, sf_dir):
    return create_drafts(*run_tables(measurements(spark, sf_dir))).filter("rejection IS NULL").select(
        "baseline_id", *CONTEXT, "chart_type", "sample_count", r6("mean"), r6("within_sigma"), r6("ucl"), r6("cpk"),
        r6("ppk"), "status",
    )


def check_of(spark, sf_dir):
    _, second = halves(spark, sf_dir)
    return run_check(analyze(second, PLAIN, row_columns=ROWS), baselines_of(spark, sf_dir))


def done_checks(spark, sf_dir):
    return unpack(check_of(spark, sf_dir).checks.filter("failure IS NULL"))


@query(
    "f6_manual_check",
    CHECKED + f"""
SELECT {CTX_SQL}, final_status, round(shift, 6) AS mean_shift, CAST(pv AS BIGINT) AS point_violations,
       CAST(tv AS BIGINT) AS trend_violations, CAST(sv AS BIGINT) AS shift_violations FROM verdict JOIN ids USING (k)
""",
)
def manual_check(spark, sf_dir):
    return done_checks(spark, sf_dir).select(
        *CONTEXT, "final_status", r6("mean_shift"), "point_violations", "trend_violations", "shift_violations"
    )


@query(
    "c8_baseline_comparison",
    CHECKED + f"""
SELECT {CTX_SQL}, round(shift, 6) AS mean_shift, round(shift_pct, 6) AS mean_shift_percentage, round(cw - bw, 6) AS within_variation_change,
       round(w_pct, 6) AS within_variation_change_percentage, round(co - bo, 6) AS overall_variation_change,
       round(o_pct, 6) AS overall_variation_change_percentage, round(k_change, 6) AS cpk_change, round(p_change, 6) AS ppk_change,
       f_shift AS mean_shift_detected, f_up AS variation_increase_detected, f_down AS variation_reduction_detected,
       f_better AS capability_improvement_detected, f_worse AS capability_degradation_detected, pv > 0 AS new_limit_violations_detected
FROM verdict JOIN ids USING (k)
""",
)
def comparison(spark, sf_dir):
    df = done_checks(spark, sf_dir)
    numbers = ("mean_shift", "mean_shift_percentage", "within_variation_change", "within_variation_change_percentage",
               "overall_variation_change", "overall_variation_change_percentage", "cpk_change", "ppk_change")
    return df.select(*CONTEXT, *[r6(c) for c in numbers], *[c for c in df.columns if c.endswith("_detected")])


FINDING = "split_part(f, ':', 1) AS finding_type, split_part(f, ':', 2) AS severity"
FINDING_TEXT = """
CASE split_part(f, ':', 1)
 WHEN 'MEAN_SHIFT' THEN 'Process mean shifted ' || CASE WHEN shift > 0 THEN 'upward' ELSE 'downward' END || ' by ' || format('{:.4g}', abs(shift)) || ' (from ' || format('{:.4g}', bm) || ' to ' || format('{:.4g}', cm) || ').'
 WHEN 'VARIATION_INCREASE' THEN 'Process variation (within-subgroup sigma) increased from ' || format('{:.4g}', bw) || ' to ' || format('{:.4g}', cw) || ' (' || format('{:.4g}', w_pct) || '%).'
 WHEN 'VARIATION_REDUCTION' THEN 'Process variation (within-subgroup sigma) decreased from ' || format('{:.4g}', bw) || ' to ' || format('{:.4g}', cw) || ' (' || format('{:.4g}', w_pct) || '%).'
 WHEN 'CAPABILITY_DEGRADATION' THEN 'Process capability (Cpk) decreased from ' || format('{:.4g}', bk) || ' to ' || format('{:.4g}', ck) || '.'
 WHEN 'CAPABILITY_IMPROVEMENT' THEN 'Process capability (Cpk) improved from ' || format('{:.4g}', bk) || ' to ' || format('{:.4g}', ck) || '.'
 WHEN 'NEW_LIMIT_VIOLATION' THEN pv || ' point(s) in the new dataset fall outside the fixed historical baseline control limits.'
 WHEN 'TREND_DETECTED' THEN tv || ' trend pattern(s) detected against the historical baseline.'
 WHEN 'SHIFT_DETECTED' THEN sv || ' sustained run(s) on one side of the historical baseline center line detected.'
 ELSE 'No significant deviation from the historical baseline was detected.' END
"""


@query(
    "c9_findings",
    CHECKED + f"SELECT {CTX_SQL}, {FINDING}, {FINDING_TEXT} AS message FROM fd JOIN verdict USING (k) JOIN ids USING (k)",
)
def findings(spark, sf_dir):
    df = finding_messages(check_of(spark, sf_dir).findings)
    return unpack(df).select(*CONTEXT, "finding_type", "severity", "message")


@query("c10_final_status", CHECKED + "SELECT final_status, CAST(count(*) AS BIGINT) AS n FROM verdict GROUP BY final_status")
def final(spark, sf_dir):
    return done_checks(spark, sf_dir).groupBy("final_status").agg(F.count("*").alias("n"))


@query(
    "f7_alerts",
    CHECKED + f"""
SELECT 'A-' || k || '-' || split_part(f, ':', 1) AS alert_id, k AS manual_check_id, 'F-' || k || '-' || split_part(f, ':', 1) AS finding_id, machine_id, parameter_id,
       split_part(f, ':', 2) AS severity, {FINDING_TEXT} AS message, 'OPEN' AS status
FROM fd JOIN (SELECT * EXCLUDE (final_status) FROM verdict) USING (k) JOIN ids USING (k)
WHERE final_status IN ('OUT_OF_CONTROL', 'CRITICAL') AND split_part(f, ':', 2) <> 'INFO'
""",
)
def alerts(spark, sf_dir):
    raised = check_of(spark, sf_dir).alerts
    path = folder(spark, "alerts")
    append_alerts(unpack(raised.withColumn("manual_check_id", check_ids(raised))), path)
    return spark.read.parquet(path).drop("created_at")


@query(
    "c15_metric_table",
    CHECKED + f""",
mt AS (SELECT k, unnest([
  {{'m': 'Mean', 'b': bm, 'c': cm, 'd': shift, 'i': CASE WHEN f_shift THEN 'shifted' ELSE 'none' END}},
  {{'m': 'Within Sigma', 'b': bw, 'c': cw, 'd': cw - bw, 'i': CASE WHEN f_up THEN 'decreased' WHEN f_down THEN 'improved' ELSE 'none' END}},
  {{'m': 'Overall Sigma', 'b': bo, 'c': co, 'd': co - bo, 'i': NULL}},
  {{'m': 'Cp', 'b': bcp, 'c': ccp, 'd': ccp - bcp, 'i': NULL}},
  {{'m': 'Cpk', 'b': bk, 'c': ck, 'd': k_change, 'i': CASE WHEN f_worse THEN 'decreased' WHEN f_better THEN 'improved' ELSE 'none' END}},
  {{'m': 'Pp', 'b': bpp, 'c': cpp2, 'd': cpp2 - bpp, 'i': NULL}},
  {{'m': 'Ppk', 'b': bp, 'c': cpp, 'd': p_change, 'i': NULL}}]) AS r FROM verdict)
SELECT {CTX_SQL}, r.m AS metric, round(r.b, 6) AS baseline_value, round(r.c, 6) AS current_value, round(r.d, 6) AS change,
       r.i AS interpretation FROM mt JOIN ids USING (k)
""",
)
def metrics(spark, sf_dir):
    df = metric_table(done_checks(spark, sf_dir), list(CONTEXT))
    return df.select(*CONTEXT, "metric", r6("baseline_value"), r6("current_value"), r6("change"), "interpretation")


@query(
    "c7_percent_change",
    """
SELECT l_orderkey, l_linenumber, l_suppkey, round((l_quantity - (l_suppkey % 5) * -7.0) / nullif(abs((l_suppkey % 5) * -7.0), 0) * 100, 6) AS change
FROM lineitem
""",
)
def percent(spark, sf_dir):
    base = (F.col("l_suppkey") % 5) * -7.0
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", r6(percent_change(F.col("l_quantity"), base), "change")
    )


# Requests: uploads of every state and type, chosen configurations and baselines.

UPLOADS = """
SELECT DISTINCT 'U' || (user_id % 10) AS upload_id, CASE user_id % 10 WHEN 7 THEN 'VALIDATING' ELSE 'SILVER_COMPLETED' END AS status,
       CASE WHEN user_id % 10 IN (5, 6) THEN 'CURRENT' ELSE 'HISTORICAL' END AS upload_type FROM events
"""


def upload_rows(spark, sf_dir):
    digit = F.col("user_id") % 10
    return table(spark, sf_dir, "events").select(
        text("U", digit).alias("upload_id"), F.when(digit == 7, "VALIDATING").otherwise("SILVER_COMPLETED").alias("status"),
        F.when(digit.isin(5, 6), "CURRENT").otherwise("HISTORICAL").alias("upload_type"),
    ).distinct()


def asked_uploads(good):
    """By parameter and operation: an upload that serves, none, one not ready, one of the other type."""
    other = "U5" if good != "U5" else "U0"
    return (
        f"CASE WHEN parameter_id = 'purchase' AND operation_id = 'O1' THEN 'U77' WHEN parameter_id = 'view' AND operation_id = 'O0' THEN 'U7' "
        f"WHEN parameter_id = 'error' AND operation_id = 'O1' THEN '{other}' ELSE '{good}' END"
    )


C02_ONLY = CONFIG_JOIN.replace(f"SELECT DISTINCT {CTX_SQL} FROM ({MEASUREMENTS})", NARROW_CONTEXTS).replace(
    "JOIN g ON g.parameter_id = cc.parameter_id AND g.is_active", "JOIN g ON cc.parameter_id = 'click' AND g.spc_configuration_id = 'C02'"
).replace("AND (g.machine_id IS NULL OR g.machine_id = cc.machine_id)", "")
RAN = """
SELECT k, parameter_id, machine_id, NULL AS product_id, operation_id, CASE WHEN error_code IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status,
       error_code AS reason, CASE WHEN error_code IS NULL THEN kind WHEN configured = 'AUTO' THEN 'IMR' ELSE configured END AS chart_type,
       spc_configuration_id FROM cap JOIN ids USING (k)
"""


def narrow(sql):
    return sql.replace(f"SELECT DISTINCT {CTX_SQL} FROM ({MEASUREMENTS})", NARROW_CONTEXTS)


@query(
    "f3_requested_analyses",
    f"""
WITH u AS ({UPLOADS}), usual AS ({analysis_sql(narrow(CONFIG_JOIN), narrow(SPEC_JOIN))} {RAN}),
chosen AS ({analysis_sql(C02_ONLY, narrow(SPEC_JOIN)).replace(CUSTOM, "k = ''")} {RAN}),
r AS (SELECT parameter_id || '|' || machine_id || '|' || operation_id AS k, *, {asked_uploads('U0')} AS upload_id FROM ({NARROW_CONTEXTS})),
q AS (SELECT 'R-' || r.k AS request_id, r.upload_id, r.parameter_id, r.machine_id, r.operation_id,
             CASE WHEN u.upload_id IS NULL THEN 'UPLOAD_NOT_FOUND' WHEN u.status <> 'SILVER_COMPLETED' THEN 'UPLOAD_NOT_READY'
                  WHEN u.upload_type <> 'HISTORICAL' THEN 'WRONG_UPLOAD_TYPE' END AS refusal, usual.status, usual.reason, usual.chart_type,
             usual.spc_configuration_id
      FROM r LEFT JOIN u USING (upload_id) LEFT JOIN usual USING (k)
      UNION ALL
      SELECT 'C-' || r.k, 'U1', r.parameter_id, r.machine_id, r.operation_id, CASE WHEN r.operation_id = 'O1' THEN 'MISSING_CONFIGURATION' END,
             chosen.status, chosen.reason, chosen.chart_type, chosen.spc_configuration_id
      FROM r LEFT JOIN chosen USING (k) WHERE r.parameter_id = 'click'
      UNION ALL
      SELECT 'N-' || r.k, 'U1', r.parameter_id, 'M9', r.operation_id, 'NO_MEASUREMENTS', NULL, NULL, NULL, 'C01' FROM r WHERE r.parameter_id = 'click')
SELECT request_id, upload_id, parameter_id, machine_id, operation_id,
       CASE WHEN refusal IS NOT NULL THEN 'REFUSED' WHEN status IS NULL OR reason = 'MISSING_CONFIGURATION' THEN 'REFUSED' ELSE status END AS status,
       coalesce(refusal, reason) AS reason, CASE WHEN refusal IS NULL AND coalesce(reason, '') <> 'MISSING_CONFIGURATION' THEN chart_type END AS chart_type,
       CASE WHEN refusal IS NULL OR refusal = 'NO_MEASUREMENTS' THEN spc_configuration_id END AS spc_configuration_id FROM q
""",
)
def requested_analyses(spark, sf_dir):
    m = measurements(spark, sf_dir)
    contexts = m.select("parameter_id", "machine_id", "operation_id").distinct().withColumn(
        "_k", F.concat_ws("|", "parameter_id", "machine_id", "operation_id")
    )
    clicks = contexts.filter("parameter_id = 'click'")

    def of(rows, prefix, upload, configuration=None, machine=F.col("machine_id")):
        return rows.select(
            F.concat(F.lit(prefix), "_k").alias("request_id"), upload.alias("upload_id"), "parameter_id", machine.alias("machine_id"),
            F.lit(" ").alias("product_id"), "operation_id", (F.lit("") if configuration is None else configuration).alias("spc_configuration_id"),
        )

    picked = F.when(F.col("operation_id") == "O1", "C99").otherwise("C02")
    requests = of(contexts, "R-", F.expr(asked_uploads("U0"))).unionByName(
        of(clicks, "C-", F.lit("U1"), picked)
    ).unionByName(of(clicks, "N-", F.lit("U1"), machine=F.lit("M9")))
    done = run_analyses(
        requests, upload_rows(spark, sf_dir), m, configurations(spark), specifications(spark), as_of(), row_columns=ROWS
    ).requests
    # A configuration found for a request that is refused before it was looked for says nothing.
    shown = F.when(F.coalesce("reason", F.lit("")).isin("UPLOAD_NOT_FOUND", "UPLOAD_NOT_READY", "WRONG_UPLOAD_TYPE"), None)
    return done.select(
        "request_id", "upload_id", "parameter_id", "machine_id", "operation_id", "status", "reason", "chart_type",
        shown.otherwise(F.col("spc_configuration_id")).alias("spc_configuration_id"),
    )


@query(
    "f6_requested_checks",
    CHECKED + f""",
u AS ({UPLOADS}),
r AS (SELECT DISTINCT k, {CTX_SQL}, {asked_uploads('U5')} AS upload_id FROM ({MEASUREMENTS})),
base AS (SELECT k FROM h WHERE k NOT LIKE '%|M2|O1'),
q AS (SELECT 'R-' || r.k AS request_id, r.upload_id, r.k, r.parameter_id, r.machine_id, r.product_id, r.operation_id, 'B-' || base.k AS baseline_id,
             CASE WHEN u.upload_id IS NULL THEN 'UPLOAD_NOT_FOUND' WHEN u.status <> 'SILVER_COMPLETED' THEN 'UPLOAD_NOT_READY'
                  WHEN u.upload_type <> 'CURRENT' THEN 'WRONG_UPLOAD_TYPE' WHEN base.k IS NULL THEN 'MISSING_ACTIVE_BASELINE'
                  WHEN r.parameter_id = 'signup' THEN 'MISSING_CONFIGURATION' END AS refusal, st.k IS NULL AS short, h.kind <> st.kind AS other
      FROM r LEFT JOIN u USING (upload_id) LEFT JOIN base USING (k) LEFT JOIN h USING (k) LEFT JOIN st USING (k)
      UNION ALL
      SELECT 'C-' || r.k, 'U6', r.k, r.parameter_id, r.machine_id, r.product_id, r.operation_id, CASE WHEN 'click|M0|O0' IN (SELECT k FROM base) THEN 'B-click|M0|O0' END,
             CASE WHEN 'click|M0|O0' NOT IN (SELECT k FROM base) THEN 'MISSING_ACTIVE_BASELINE' END, st.k IS NULL, true
      FROM r LEFT JOIN st USING (k) WHERE r.parameter_id = 'view'
      UNION ALL
      SELECT 'D-' || r.k, 'U6', r.k, r.parameter_id, r.machine_id, r.product_id, r.operation_id, 'B-' || base.k, CASE WHEN base.k IS NULL THEN 'MISSING_ACTIVE_BASELINE' END, st.k IS NULL, h.kind <> st.kind
      FROM r LEFT JOIN base USING (k) LEFT JOIN h USING (k) LEFT JOIN st USING (k) WHERE r.parameter_id = 'click')
SELECT request_id, q.upload_id, q.parameter_id, q.machine_id, q.product_id, q.operation_id, CASE WHEN refusal IS NULL OR refusal = 'MISSING_CONFIGURATION' THEN q.baseline_id END AS baseline_id,
       CASE WHEN refusal IS NOT NULL THEN 'REFUSED' WHEN short OR other THEN 'FAILED' ELSE 'COMPLETED' END AS status,
       coalesce(refusal, CASE WHEN short THEN 'INSUFFICIENT_DATA' WHEN other THEN 'BASELINE_CONTEXT_MISMATCH' END) AS reason,
       CASE WHEN refusal IS NULL AND NOT short AND NOT other THEN final_status END AS final_status
FROM q LEFT JOIN verdict USING (k)
""",
)
def requested_checks(spark, sf_dir):
    _, second = halves(spark, sf_dir)
    kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("parameter_id")).filter("event_type <> 'signup'").distinct()
    nothing = [F.lit(None).cast("string").alias(c) for c in CONTEXT[1:]]
    since = F.lit("2023-01-01").cast("timestamp_ntz")
    configs = kinds.select(
        F.concat(F.lit("K-"), "parameter_id").alias("spc_configuration_id"), "parameter_id", *nothing, F.lit("AUTO").alias("chart_type"),
        F.lit(5).alias("subgroup_size"), F.lit("CONSECUTIVE").alias("subgroup_method"), F.lit(14400).alias("maximum_time_gap_seconds"),
        F.lit(20).alias("minimum_sample_size"), F.lit("[]").alias("ruleset"), F.lit(True).alias("is_active"), since.alias("created_at"),
    )
    specs = kinds.select(
        F.concat(F.lit("S-"), "parameter_id").alias("specification_id"), "parameter_id", *nothing, F.lit(-50.0).alias("lsl"), F.lit(200.0).alias("usl"),
        F.lit(None).cast("double").alias("target"), since.alias("effective_from"), F.lit(None).cast("timestamp_ntz").alias("effective_to"),
        F.lit("ACTIVE").alias("status"),
    )
    draft = F.col("baseline_id").like("%|M2|O1")
    baselines = materialize(baselines_of(spark, sf_dir).withColumn("status", F.when(draft, "DRAFT").otherwise("ACTIVE")), "baselines")
    contexts = measurements(spark, sf_dir).select(*CONTEXT).distinct()
    own = F.concat_ws("|", "parameter_id", "machine_id", "operation_id")

    def of(rows, prefix, upload, baseline):
        return rows.select(F.concat(F.lit(prefix), own).alias("request_id"), upload.alias("upload_id"), *CONTEXT, baseline.alias("baseline_id"))

    requests = of(contexts, "R-", F.expr(asked_uploads("U5")), F.lit("")).unionByName(
        of(contexts.filter("parameter_id = 'view'"), "C-", F.lit("U6"), F.lit("B-click|M0|O0"))
    ).unionByName(of(contexts.filter("parameter_id = 'click'"), "D-", F.lit("U6"), F.concat(F.lit("B-"), own)))
    done = run_checks(
        requests, upload_rows(spark, sf_dir), second, baselines, configs, specs, as_of(), row_columns=ROWS
    ).requests
    # A baseline found for a request that is refused before it was looked for says nothing.
    shown = F.when(F.coalesce("reason", F.lit("")).isin("UPLOAD_NOT_FOUND", "UPLOAD_NOT_READY", "WRONG_UPLOAD_TYPE"), None)
    return done.select(
        "request_id", "upload_id", *CONTEXT, shown.otherwise(F.col("baseline_id")).alias("baseline_id"), "status", "reason", "final_status"
    )


# Stored result tables.


@query(
    "s11_result_tables",
    WHOLE + """
SELECT k AS analysis_id, CAST(pc AS BIGINT) AS subgroup_count, CAST(used AS BIGINT) AS subgroup_size_used, round(mean, 6) AS mean, round(ws, 6) AS within_sigma,
       round(os, 6) AS overall_sigma, CAST(n AS BIGINT) AS valid_observations, round(gm, 6) AS center_line, round(ucl, 6) AS ucl, round(lcl, 6) AS lcl,
       -50.0::DOUBLE AS lsl, 200.0::DOUBLE AS usl, round(cp, 6) AS cp, round(cpk, 6) AS cpk, round(pp, 6) AS pp, round(ppk, 6) AS ppk,
       round(slcl, 6) AS secondary_lcl, CAST(pc + CASE WHEN kind = 'IMR' THEN pc - 1 ELSE pc END AS BIGINT) AS stored_points FROM st
""",
)
def result_tables(spark, sf_dir):
    done = analyze(measurements(spark, sf_dir), PLAIN, row_columns=ROWS).saved()
    ids = done.profile.select(
        "ctx", F.concat_ws("|", "ctx.parameter_id", "ctx.machine_id", "ctx.operation_id").alias("analysis_id")
    )
    results, points = folder(spark, "results"), folder(spark, "points")
    append_results(stored_results(done, ids), results)
    append_chart_points(done.chart_points.join(ids, "ctx").drop("ctx"), points)
    counted = spark.read.parquet(points).groupBy("analysis_id").agg(F.count("*").alias("stored_points"))
    return spark.read.parquet(results).join(counted, "analysis_id").select(
        "analysis_id", "subgroup_count", "subgroup_size_used", "valid_observations", "lsl", "usl", "stored_points",
        *[r6(c) for c in ("mean", "within_sigma", "overall_sigma", "center_line", "ucl", "lcl", "cp", "cpk", "pp", "ppk", "secondary_lcl")],
    )


def check_ids(check):
    return F.concat_ws("|", "ctx.parameter_id", "ctx.machine_id", "ctx.operation_id")


@query(
    "s12_violation_table",
    CHECKED + """
SELECT k AS manual_check_id, NULL AS analysis_id, rule_name, CAST(s AS BIGINT) AS start_index, CAST(e AS BIGINT) AS end_index FROM vi
""",
)
def violation_table(spark, sf_dir):
    found = check_of(spark, sf_dir).violations
    path = folder(spark, "violations")
    append_violations(with_messages(found).withColumn("manual_check_id", check_ids(found)), path)
    return spark.read.parquet(path).select("manual_check_id", "analysis_id", "rule_name", "start_index", "end_index")


@query(
    "s13_comparison_table",
    CHECKED + """
SELECT k AS manual_check_id, round(bm, 6) AS baseline_mean, round(cm, 6) AS current_mean, round(shift, 6) AS mean_shift, round(shift_pct, 6) AS mean_shift_percentage,
       round(bw, 6) AS baseline_within_sigma, round(cw, 6) AS current_within_sigma, round(cw - bw, 6) AS within_variation_change,
       round(w_pct, 6) AS within_variation_change_percentage, round(bo, 6) AS baseline_overall_sigma, round(co, 6) AS current_overall_sigma,
       round(co - bo, 6) AS overall_variation_change, round(o_pct, 6) AS overall_variation_change_percentage, round(bk, 6) AS baseline_cpk, round(ck, 6) AS current_cpk,
       round(k_change, 6) AS cpk_change, round(bp, 6) AS baseline_ppk, round(cpp, 6) AS current_ppk, round(p_change, 6) AS ppk_change, f_shift AS mean_shift_detected,
       f_up AS variation_increase_detected, f_down AS variation_reduction_detected, f_better AS capability_improvement_detected,
       f_worse AS capability_degradation_detected, pv > 0 AS new_limit_violations_detected FROM verdict
""",
)
def comparison_table(spark, sf_dir):
    checks = check_of(spark, sf_dir).checks.filter("failure IS NULL")
    path = folder(spark, "comparisons")
    append_comparisons(checks.withColumn("manual_check_id", check_ids(checks)), path)
    stored = spark.read.parquet(path)
    return stored.select(*[r6(c) if kind == "double" else c for c, kind in stored.dtypes])


FACT = """
CASE split_part(f, ':', 1) WHEN 'MEAN_SHIFT' THEN shift WHEN 'VARIATION_INCREASE' THEN w_pct WHEN 'VARIATION_REDUCTION' THEN w_pct
 WHEN 'CAPABILITY_DEGRADATION' THEN k_change WHEN 'CAPABILITY_IMPROVEMENT' THEN k_change WHEN 'NEW_LIMIT_VIOLATION' THEN pv
 WHEN 'TREND_DETECTED' THEN tv WHEN 'SHIFT_DETECTED' THEN sv END
"""


@query(
    "s14_findings_table",
    CHECKED + f"""
SELECT 'F-' || k || '-' || split_part(f, ':', 1) AS finding_id, NULL::VARCHAR AS analysis_id, k AS manual_check_id, {FINDING}, {FINDING_TEXT} AS message,
       round(CAST({FACT} AS DOUBLE), 6) AS fact FROM fd JOIN verdict USING (k)
""",
)
def findings_table(spark, sf_dir):
    found = check_of(spark, sf_dir).findings
    path = folder(spark, "findings")
    append_findings(found.withColumn("manual_check_id", check_ids(found)), path)
    changes = ("mean_shift", "within_variation_change_percentage", "cpk_change", "violation_count")
    fact = F.coalesce(*[F.get_json_object("statistical_fact", f"$.{c}") for c in changes]).cast("double")
    return spark.read.parquet(path).select(
        "finding_id", "analysis_id", "manual_check_id", "finding_type", "severity", "message", r6(fact, "fact")
    )


@query(
    "a13_affected_indices",
    CHECKED + f"SELECT {CTX_SQL}, CAST(s AS BIGINT) AS affected_index FROM vi JOIN ids USING (k) WHERE rule_name = 'POINT_OUTSIDE_LIMITS'",
)
def affected(spark, sf_dir):
    return unpack(affected_indices(check_of(spark, sf_dir).violations))


# Approvals, eligibility and alert states over ledger-like rows.

BASELINES = """
b0 AS (SELECT 'B' || (event_id + 1000000) AS baseline_id, event_type AS parameter_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'M' || (user_id % 3) END AS machine_id,
              'P' || (user_id % 20) AS product_id, NULL::VARCHAR AS operation_id, event_id, ts FROM events),
b AS (SELECT *, CASE WHEN event_id = min(event_id) OVER (PARTITION BY parameter_id, machine_id, product_id) THEN 'ACTIVE'
                     WHEN event_id % 2 = 0 THEN 'DRAFT' ELSE 'SUPERSEDED' END AS status FROM b0)
"""


def baseline_rows(spark, sf_dir):
    user = F.col("user_id")
    df = table(spark, sf_dir, "events").select(
        text("B", F.col("event_id") + 1000000).alias("baseline_id"), F.col("event_type").alias("parameter_id"),
        F.when(user % 3 != 0, text("M", user % 3)).alias("machine_id"), text("P", user % 20).alias("product_id"),
        F.lit(None).cast("string").alias("operation_id"), "event_id", "ts",
    )
    keyed = context(df, CONTEXT)
    first = keyed.groupBy("ctx").agg(F.min("event_id").alias("_first"))
    status = F.when(F.col("event_id") == F.col("_first"), "ACTIVE").when(F.col("event_id") % 2 == 0, "DRAFT")
    return keyed.join(first, "ctx").withColumn("status", status.otherwise("SUPERSEDED")).drop("ctx", "_first").withColumn(
        "superseded_by_baseline_id", F.lit(None).cast("string")
    )


def approval_rows(df):
    return df.filter("event_id % 4 = 0 OR event_id % 15 = 1").select(
        "baseline_id", F.col("ts").alias("approved_at"), F.lit("qa").alias("approved_by")
    )


APPROVED = f"""
WITH {BASELINES},
a AS (SELECT *, event_id % 4 = 0 OR event_id % 15 = 1 AS asked FROM b),
line AS (SELECT *, row_number() OVER (PARTITION BY parameter_id, machine_id, product_id ORDER BY status = 'DRAFT', CASE WHEN status = 'DRAFT' THEN ts END, baseline_id) AS turn
         FROM a WHERE status = 'ACTIVE' OR (status = 'DRAFT' AND asked)),
nx AS (SELECT l.*, n.baseline_id AS next_id FROM line l LEFT JOIN line n ON n.parameter_id = l.parameter_id AND n.product_id = l.product_id
         AND n.machine_id IS NOT DISTINCT FROM l.machine_id AND n.turn = l.turn + 1)
"""


@query(
    "f5_approve_baselines",
    APPROVED + """
SELECT baseline_id, CASE WHEN next_id IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status, next_id AS superseded_by_baseline_id,
       CASE WHEN status = 'DRAFT' THEN ts END AS approved_at FROM nx
UNION ALL SELECT baseline_id, status, NULL, NULL FROM a WHERE NOT (status = 'ACTIVE' OR (status = 'DRAFT' AND asked))
""",
)
def approvals(spark, sf_dir):
    df = baseline_rows(spark, sf_dir)
    after, _ = approve(df, approval_rows(df))
    return after.select("baseline_id", "status", "superseded_by_baseline_id", "approved_at")


@query("f5_refused_approvals", APPROVED + "SELECT baseline_id, status FROM a WHERE asked AND status <> 'DRAFT'")
def refused(spark, sf_dir):
    df = baseline_rows(spark, sf_dir)
    return approve(df, approval_rows(df))[1]


@query(
    "f5_archive_baselines",
    f"WITH {BASELINES} SELECT baseline_id, CASE WHEN event_id % 10 = 0 THEN 'ARCHIVED' ELSE status END AS status FROM b",
)
def archived(spark, sf_dir):
    df = baseline_rows(spark, sf_dir)
    return archive(df, df.filter("event_id % 10 = 0")).select("baseline_id", "status")


@query(
    "p15_eligible_uploads",
    """
SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 2 = 0
""",
)
def eligible(spark, sf_dir):
    uploads = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "SILVER_COMPLETED").otherwise("VALIDATING").alias("status"),
        F.when(F.col("o_custkey") % 2 == 0, "HISTORICAL").otherwise("CURRENT").alias("upload_type"),
    )
    return eligible_uploads(uploads, "HISTORICAL").select("o_orderkey")


@query(
    "p16_baseline_compatibility",
    """
SELECT event_id, concat_ws(',', CASE WHEN event_id % 7 = 0 THEN 'parameter' END, CASE WHEN event_id % 2 = 0 THEN 'machine' END,
   CASE WHEN (event_id % 3 = 0) <> (event_id % 5 = 0) THEN 'product' END, CASE WHEN event_id % 11 = 0 THEN 'chart type' END) AS mismatches
FROM events
""",
)
def compatibility(spark, sf_dir):
    key = F.col("event_id")
    df = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("parameter_id"), F.lit("M1").alias("machine_id"),
        F.when(key % 3 != 0, "P1").alias("product_id"), F.lit(None).cast("string").alias("operation_id"), F.lit("IMR").alias("chart_type"),
        F.when(key % 7 == 0, "other").otherwise(F.col("event_type")).alias("baseline_parameter_id"),
        F.when(key % 2 == 0, F.lit(None)).otherwise("M1").alias("baseline_machine_id"),
        F.when(key % 5 != 0, "P1").alias("baseline_product_id"), F.lit(None).cast("string").alias("baseline_operation_id"),
        F.when(key % 11 == 0, "XBAR_R").otherwise("IMR").alias("baseline_chart_type"),
    )
    return df.select("event_id", F.array_join(mismatches(), ",").alias("mismatches"))


@query(
    "p17_draft_eligibility",
    """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'NOT_COMPLETED' WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'NO_SIGMA' END AS rejection FROM events
""",
)
def draft_eligibility(spark, sf_dir):
    key = F.col("event_id")
    df = table(spark, sf_dir, "events").select(
        "event_id", F.when(key % 3 == 0, "FAILED").otherwise("COMPLETED").alias("status"),
        F.when(key % 5 != 0, F.col("value")).alias("within_sigma"), F.when(key % 7 != 0, F.col("value")).alias("overall_sigma"),
    )
    return df.select("event_id", draft_rejection().alias("rejection"))


@query(
    "f8_alert_states",
    """
WITH al AS (SELECT DISTINCT 'AL' || user_id AS alert_id FROM events),
ev AS (SELECT 'AL' || (user_id * 2) AS alert_id, ts, event_id, CASE event_type WHEN 'click' THEN 'ACKNOWLEDGED' WHEN 'error' THEN 'RESOLVED' END AS action,
              'op' || (event_id % 9) AS actor FROM events WHERE event_type IN ('click', 'error')),
st AS (SELECT alert_id, arg_max(action, ts) AS action, arg_max(ts, ts) FILTER (action = 'ACKNOWLEDGED') AS acknowledged_at,
              arg_max(actor, ts) FILTER (action = 'ACKNOWLEDGED') AS acknowledged_by, max(ts) FILTER (action = 'RESOLVED') AS resolved_at,
              arg_max(actor, ts) FILTER (action = 'RESOLVED') AS resolved_by FROM ev GROUP BY alert_id)
SELECT al.alert_id, coalesce(action, 'OPEN') AS status, acknowledged_at, acknowledged_by, resolved_at, resolved_by FROM al LEFT JOIN st USING (alert_id)
""",
)
def alert_states(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    opened = events.select(text("AL", F.col("user_id")).alias("alert_id"), F.lit("OPEN").alias("status")).distinct()
    actions = events.select(
        text("AL", F.col("user_id") * 2).alias("alert_id"), "event_id", F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "click", "ACKNOWLEDGED").when(F.col("event_type") == "error", "RESOLVED")
        .otherwise(F.col("event_type")).alias("action"),
        text("op", F.col("event_id") % 9).alias("actor"),
    )
    return alert_state(opened, actions)
