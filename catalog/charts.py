"""Charts, limits, sigma, rules and display rows."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sqltext import CHARTS, FACTORS, SIZES, rules, setting, subgroups
from catalog.subgroups import formed
from catalog.tables import CTX_SQL, by_context, r6, table
from gaugeline.functions.constants import COLUMNS, factors
from gaugeline.functions.text import significant
from gaugeline.operators.charts import (
    chart_points, control_limits, select_chart, series, subgroup_sizes, with_limits, with_sizes,
)
from gaugeline.operators.display import (
    axis_range, bin_of, downsample, histogram, point_status, sigma_zones,
)
from gaugeline.operators.layout import materialize, measure, unpack
from gaugeline.operators.rules import (
    decode_ruleset, default_ruleset, judge, stability, violation_counts, violations, with_messages,
)
from gaugeline.schema import CONTEXT


def points_of(spark, sf_dir, size, method="CONSECUTIVE", chart="AUTO"):
    subgroups_, layout = formed(spark, sf_dir, size, method)
    sized = with_sizes(subgroups_, layout).withColumn("configured_chart", F.lit(chart))
    return chart_points(sized, layout), layout


def judged_of(spark, sf_dir, size, method="CONSECUTIVE", chart="AUTO", ruleset=None):
    points, layout = points_of(spark, sf_dir, size, method, chart)
    limited = with_limits(points, layout).withColumn("ruleset", ruleset if ruleset is not None else default_ruleset())
    # Points and their violations are read from one written table.
    return materialize(judge(limited, layout), "judged"), layout


def base(size, method="CONSECUTIVE", chart="AUTO"):
    return subgroups(setting(size, method, chart=chart)) + CHARTS


LIMITS_OUT = f"""
SELECT {CTX_SQL}, kind AS chart_type, CAST(used AS BIGINT) AS size_used, CAST(pc AS BIGINT) AS point_count,
       round(gm, 6) AS center_line, round(ucl, 6) AS ucl, round(lcl, 6) AS lcl, round(scl, 6) AS secondary_center_line,
       round(sucl, 6) AS secondary_ucl, round(slcl, 6) AS secondary_lcl, round(ws, 6) AS within_sigma
FROM lim JOIN ids USING (k)
"""


def limits_out(points):
    df = unpack(control_limits(points)).filter(F.col("center_line").isNotNull())
    return df.select(
        *CONTEXT, "chart_type", "size_used", "point_count",
        *[r6(c) for c in ("center_line", "ucl", "lcl", "secondary_center_line", "secondary_ucl", "secondary_lcl",
                          "within_sigma")],
    )


@query(
    "c1_control_chart_constants",
    f"""
WITH f AS (SELECT * FROM (VALUES {FACTORS}) AS t({', '.join(COLUMNS)})),
s AS (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY l_orderkey)
SELECT CAST(size AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS orders, CAST(any_value(a2) AS DOUBLE) AS a2,
       CAST(any_value(big_d4) AS DOUBLE) AS big_d4, CAST(any_value(c4) AS DOUBLE) AS c4, any_value(a2) IS NULL AS unsupported
FROM s LEFT JOIN f ON f.n = s.size GROUP BY size
""",
)
def constants(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size"))
    counted = sizes.groupBy("size").agg(F.count("*").alias("orders"))
    joined = counted.join(F.broadcast(factors(spark)), F.col("size") == F.col("n"), "left")
    return joined.select("size", "orders", "a2", "big_d4", "c4", F.col("a2").isNull().alias("unsupported"))


@query(
    "c2_chart_selection",
    """
WITH s AS (SELECT l_suppkey, l_returnflag, 1 + count(*) % 12 AS size,
                  CASE l_suppkey % 5 WHEN 0 THEN 'AUTO' WHEN 1 THEN 'XBAR_R' WHEN 2 THEN 'XBAR_S' WHEN 3 THEN 'IMR' ELSE 'P' END AS c
           FROM lineitem GROUP BY ALL),
t AS (SELECT *, CASE WHEN size <= 1 THEN 'IMR' WHEN size <= 8 THEN 'XBAR_R' ELSE 'XBAR_S' END AS rec FROM s)
SELECT l_suppkey, l_returnflag, CAST(size AS BIGINT) AS detected_size, rec AS recommended_chart,
       CASE WHEN c = 'AUTO' THEN rec WHEN c = 'P' OR (c = 'IMR') <> (size <= 1) THEN NULL ELSE c END AS chart_type
FROM t
""",
)
def selection(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        (F.count("*") % 12 + 1).alias("detected_size")
    )
    turn = F.col("l_suppkey") % 5
    wanted = F.when(turn == 0, "AUTO").when(turn == 1, "XBAR_R").when(turn == 2, "XBAR_S").when(turn == 3, "IMR")
    df = select_chart(sizes.withColumn("configured_chart", wanted.otherwise("P")))
    return df.select("l_suppkey", "l_returnflag", "detected_size", "recommended_chart", "chart_type")


@query("c3_xbar_r_chart", base(5, "FIXED_SIZE") + LIMITS_OUT)
def xbar_r(spark, sf_dir):
    return limits_out(points_of(spark, sf_dir, 5, "FIXED_SIZE")[0])


@query("c4_xbar_s_chart", base(10, "FIXED_SIZE") + LIMITS_OUT)
def xbar_s(spark, sf_dir):
    return limits_out(points_of(spark, sf_dir, 10, "FIXED_SIZE")[0])


@query("c5_imr_chart", base(1) + LIMITS_OUT)
def imr(spark, sf_dir):
    return limits_out(points_of(spark, sf_dir, 1)[0])


@query(
    "a5_conforming_subgroups",
    subgroups(setting(3, "CONSECUTIVE", 10800)) + SIZES + f"""
SELECT {CTX_SQL}, CAST(modal AS BIGINT) AS modal_size, CAST(formed AS BIGINT) AS subgroups_formed,
       CAST(excluded AS BIGINT) AS subgroups_excluded,
       coalesce((SELECT string_agg(CAST(cnt AS VARCHAR), ',' ORDER BY cnt) FROM sz WHERE sz.k = md.k AND cnt <> modal), '') AS excluded_sizes
FROM md JOIN ids USING (k)
""",
)
def conforming(spark, sf_dir):
    df = subgroup_sizes(formed(spark, sf_dir, 3, "CONSECUTIVE", 10800)[0])
    return unpack(df).select(
        *CONTEXT, "modal_size", "subgroups_formed", "subgroups_excluded",
        F.array_join(F.col("excluded_sizes").cast("array<string>"), ",").alias("excluded_sizes"),
    )


@query(
    "a6_detected_size",
    subgroups(setting(5, "EXISTING_ID")) + SIZES
    + f"SELECT {CTX_SQL}, CAST(detected AS BIGINT) AS detected_size, CAST(modal AS BIGINT) AS modal_size FROM md JOIN ids USING (k)",
)
def detected(spark, sf_dir):
    subgroups_, layout = formed(spark, sf_dir, 5, "EXISTING_ID")
    df = with_sizes(subgroups_, layout).groupBy("ctx").agg(
        F.first("detected_size").alias("detected_size"), F.first("modal_size").alias("modal_size")
    )
    return unpack(df)


@query(
    "a7_grand_mean",
    base(5) + f"SELECT {CTX_SQL}, CAST(pc AS BIGINT) AS point_count, round(gm, 6) AS grand_mean FROM agg JOIN ids USING (k)",
)
def grand_mean(spark, sf_dir):
    df = unpack(control_limits(points_of(spark, sf_dir, 5)[0]))
    return df.select(*CONTEXT, "point_count", r6("grand_mean"))


@query(
    "a8_mean_spread",
    base(5, "FIXED_SIZE") + f"""
SELECT {CTX_SQL}, round(rb, 6) AS mean_range, round(sb, 6) AS mean_std_dev, round(mb, 6) AS mean_moving_range
FROM agg JOIN ids USING (k)
""",
)
def mean_spread(spark, sf_dir):
    df = unpack(control_limits(points_of(spark, sf_dir, 5, "FIXED_SIZE")[0]))
    return df.select(*CONTEXT, r6("mean_range"), r6("mean_std_dev"), r6("mean_moving_range"))


@query(
    "a11_within_sigma",
    base(9, "FIXED_SIZE", "XBAR_R") + f"SELECT {CTX_SQL}, kind AS chart_type, round(ws, 6) AS within_sigma FROM lim JOIN ids USING (k)",
)
def within_sigma(spark, sf_dir):
    df = unpack(control_limits(points_of(spark, sf_dir, 9, "FIXED_SIZE", "XBAR_R")[0]))
    return df.select(*CONTEXT, "chart_type", r6("within_sigma"))


@query(
    "w8_moving_range",
    base(1) + f"""
SELECT {CTX_SQL}, CAST(pn - 1 AS BIGINT) AS "index", CAST(2 AS BIGINT) AS n, et AS timestamp, round(mr, 6) AS value
FROM p JOIN ids USING (k) WHERE mr IS NOT NULL
""",
)
def moving_range(spark, sf_dir):
    df = series(points_of(spark, sf_dir, 1)[0]).filter("series = 'SECONDARY'")
    return unpack(df).select(*CONTEXT, "index", "n", "timestamp", r6("value"))


RULE_OUT = f"""
SELECT {CTX_SQL}, CAST(s AS BIGINT) AS start_index, CAST(e AS BIGINT) AS end_index FROM vi JOIN ids USING (k)
WHERE rule_name = """


def rule_rows(judged, name):
    df = unpack(violations(judged)).filter(F.col("rule_name") == name)
    return df.select(*CONTEXT, "start_index", "end_index")


@query("w9_points_outside_limits", base(1) + rules() + RULE_OUT + "'POINT_OUTSIDE_LIMITS'")
def outside(spark, sf_dir):
    return rule_rows(judged_of(spark, sf_dir, 1)[0], "POINT_OUTSIDE_LIMITS")


SHORT = '[{"rule_name":"TREND_INCREASING","parameters":{"consecutive_points":3}},{"rule_name":"TREND_DECREASING","parameters":{"consecutive_points":3}},{"rule_name":"RUN_SAME_SIDE","parameters":{"consecutive_points":4}},{"rule_name":"POINT_OUTSIDE_LIMITS","enabled":false}]'


@query(
    "w10_trend_rule",
    base(1) + rules(trend_up=3, trend_down=3, run=4) + RULE_OUT + "'TREND_INCREASING' UNION ALL " + RULE_OUT.strip() + "'TREND_DECREASING'",
)
def trend(spark, sf_dir):
    judged, _ = judged_of(spark, sf_dir, 1, ruleset=decode_ruleset(F.lit(SHORT)))
    df = unpack(violations(judged)).filter(F.col("rule_name").startswith("TREND"))
    return df.select(*CONTEXT, "start_index", "end_index")


@query("w11_run_same_side_rule", base(1) + rules(trend_up=3, trend_down=3, run=4) + RULE_OUT + "'RUN_SAME_SIDE'")
def same_side(spark, sf_dir):
    return rule_rows(judged_of(spark, sf_dir, 1, ruleset=decode_ruleset(F.lit(SHORT)))[0], "RUN_SAME_SIDE")


@query(
    "w12_rule_set",
    base(1) + rules() + f"""
SELECT {CTX_SQL}, CAST(pos AS BIGINT) AS rule_position, rule_name, 'IMR' AS chart_type, 'WARNING' AS severity,
       CAST(s AS BIGINT) AS start_index, CAST(e AS BIGINT) AS end_index,
       array_to_string(range(CAST(s AS BIGINT), CAST(e AS BIGINT) + 1), ',') AS affected_points FROM vi JOIN ids USING (k)
""",
)
def rule_set(spark, sf_dir):
    df = unpack(violations(judged_of(spark, sf_dir, 1)[0]))
    return df.select(
        *CONTEXT, "rule_position", "rule_name", "chart_type", "severity", "start_index", "end_index",
        F.array_join(F.col("affected_points").cast("array<string>"), ",").alias("affected_points"),
    )


COUNTS = """,
vc AS (SELECT k, count(*) FILTER (rule_name = 'POINT_OUTSIDE_LIMITS') AS pv,
              count(*) FILTER (rule_name LIKE 'TREND%') AS tv, count(*) FILTER (rule_name = 'RUN_SAME_SIDE') AS sv
       FROM vi GROUP BY k)"""


@query(
    "a13_violation_rollup",
    base(1) + rules() + COUNTS + f"""
SELECT {CTX_SQL}, CAST(pv AS BIGINT) AS point_violations, CAST(tv AS BIGINT) AS trend_violations,
       CAST(sv AS BIGINT) AS shift_violations FROM vc JOIN ids USING (k)
""",
)
def rollup(spark, sf_dir):
    df = violation_counts(violations(judged_of(spark, sf_dir, 1)[0]))
    return unpack(df).select(*CONTEXT, "point_violations", "trend_violations", "shift_violations")


@query(
    "a14_stability",
    base(5) + rules() + COUNTS + f"""
SELECT {CTX_SQL}, CASE WHEN coalesce(pv, 0) > 0 THEN 'OUT_OF_CONTROL' WHEN coalesce(tv + sv, 0) > 0 THEN 'WARNING'
       ELSE 'IN_CONTROL' END AS stability_status FROM ids LEFT JOIN vc USING (k)
""",
)
def stability_status(spark, sf_dir):
    counts = violation_counts(violations(judged_of(spark, sf_dir, 5)[0]))
    every = by_context(spark, sf_dir).select("ctx").distinct()
    return unpack(stability(every.join(counts, "ctx", "left"))).select(*CONTEXT, "stability_status")


@query(
    "c11_sigma_zones",
    base(5) + f"""
SELECT {CTX_SQL}, round(gm + (ucl - gm) / 3, 6) AS one_sigma_upper, round(gm + 2 * (ucl - gm) / 3, 6) AS two_sigma_upper,
       round(gm - (gm - lcl) / 3, 6) AS one_sigma_lower, round(gm - 2 * (gm - lcl) / 3, 6) AS two_sigma_lower
FROM lim JOIN ids USING (k)
""",
)
def zones(spark, sf_dir):
    df = sigma_zones(unpack(control_limits(points_of(spark, sf_dir, 5)[0])).filter("center_line IS NOT NULL"))
    return df.select(*CONTEXT, *[r6(f"{n}_sigma_{s}") for n in ("one", "two") for s in ("upper", "lower")])


MESSAGE = """
CASE rule_name WHEN 'POINT_OUTSIDE_LIMITS' THEN 'Point at index ' || s || ' (value=' || format('{:.6g}', mean) || ') is '
     || CASE WHEN mean > ucl THEN 'above UCL' ELSE 'below LCL' END || ' (UCL=' || format('{:.6g}', ucl) || ', LCL=' || format('{:.6g}', lcl) || ').'
 WHEN 'RUN_SAME_SIDE' THEN (e - s + 1) || ' consecutive points ' || CASE WHEN mean > cl THEN 'above' ELSE 'below' END
     || ' the center line detected (indices ' || s || '..' || e || '); this indicates a sustained process shift.'
 ELSE (e - s + 1) || ' consecutive ' || CASE rule_name WHEN 'TREND_INCREASING' THEN 'increasing' ELSE 'decreasing' END
     || ' points detected (indices ' || s || '..' || e || ').' END
"""


@query(
    "j11_point_status",
    base(1) + rules() + f""",
ex AS (SELECT k, s, pos, CASE WHEN pos = 0 THEN 2 ELSE 1 END AS rk, {MESSAGE} AS msg,
              unnest(range(CAST(s AS BIGINT), CAST(e AS BIGINT) + 1)) AS i FROM vi),
o AS (SELECT *, row_number() OVER (PARTITION BY k, i ORDER BY s, pos) AS turn, max(rk) OVER (PARTITION BY k, i) AS worst FROM ex),
f AS (SELECT *, min(CASE WHEN rk = worst THEN turn END) OVER (PARTITION BY k, i) AS since FROM o),
g AS (SELECT k, i, any_value(worst) AS worst, string_agg(msg, ' | ' ORDER BY turn) FILTER (turn >= since) AS messages FROM f GROUP BY k, i)
SELECT {CTX_SQL}, CAST(pn - 1 AS BIGINT) AS "index", CASE worst WHEN 2 THEN 'OUT_OF_CONTROL' WHEN 1 THEN 'WARNING' ELSE 'NORMAL' END AS status,
       coalesce(messages, '') AS messages
FROM p JOIN ids USING (k) LEFT JOIN g ON g.k = p.k AND g.i = p.pn - 1
""",
)
def status(spark, sf_dir):
    judged, _ = judged_of(spark, sf_dir, 1)
    points = judged.select("ctx", (F.col("point_number") - 1).alias("index"))
    df = point_status(points, with_messages(violations(judged)), "message")
    return unpack(df).select(*CONTEXT, "index", "status", F.array_join("messages", " | ").alias("messages"))


@query(
    "w13_display_downsample",
    base(1) + rules() + f""",
st AS (SELECT DISTINCT k, unnest(range(CAST(s AS BIGINT), CAST(e AS BIGINT) + 1)) AS i FROM vi),
q AS (SELECT p.k, p.pn - 1 AS i, st.i IS NOT NULL AS hit, count(*) OVER (PARTITION BY p.k) AS n,
             count(st.i) OVER (PARTITION BY p.k) AS kept FROM p LEFT JOIN st ON st.k = p.k AND st.i = p.pn - 1),
z AS (SELECT *, CASE WHEN 60 - kept > 0 THEN CAST(ceil(n / (60.0 - kept)) AS BIGINT) ELSE n + 1 END AS stride FROM q)
SELECT {CTX_SQL}, CAST(i AS BIGINT) AS "index", n > 60 AS was_downsampled FROM z JOIN ids USING (k)
WHERE n <= 60 OR hit OR i % stride = 0 OR i = n - 1
""",
)
def display(spark, sf_dir):
    judged, layout = judged_of(spark, sf_dir, 1)
    points = judged.select("ctx", (F.col("point_number") - 1).alias("index"))
    df = downsample(point_status(points, violations(judged)), layout, 60)
    return unpack(df).select(*CONTEXT, "index", "was_downsampled")


HISTOGRAM = """,
hv AS (SELECT k, avg(value) AS hm, stddev_samp(value) AS hs FROM m GROUP BY k),
hb AS (SELECT p.k, min(mean) AS mn, max(mean) AS mx, count(*) AS n, any_value(hm) AS hm, any_value(hs) AS hs FROM p JOIN hv USING (k) GROUP BY p.k),
hc AS (SELECT *, (CASE WHEN mx = mn THEN 1 ELSE mx - mn END) / 16 AS w, least(mn, hm - 4 * hs, -10.0, 45.0) AS lo,
              greatest(mx, hm + 4 * hs, 300.0, 45.0) AS hi FROM hb),
hd AS (SELECT *, least(40, greatest(0, ceil((mn - lo) / w)))::BIGINT AS pl, least(40, greatest(0, ceil((hi - mx) / w)))::BIGINT AS pr FROM hc),
he AS (SELECT *, mn - pl * w AS start, 16 + pl + pr AS total FROM hd),
slot AS (SELECT k, unnest(range(0, total)) AS bin, start, w, hm, hs, n FROM he),
hn AS (SELECT he.k, least(greatest(floor((mean - start) / w), 0), total - 1)::BIGINT AS bin, count(*) AS c FROM p JOIN he USING (k) GROUP BY 1, 2),
hist AS (SELECT slot.k, slot.bin, start + slot.bin * w AS range_start, start + slot.bin * w + w AS range_end,
                start + slot.bin * w + w / 2 AS center, w, hm, hs, n, coalesce(c, 0) AS c
         FROM slot LEFT JOIN hn ON hn.k = slot.k AND hn.bin = slot.bin)"""


def histogram_of(spark, sf_dir):
    points, layout = points_of(spark, sf_dir, 3)
    values = by_context(spark, sf_dir).groupBy("ctx").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("overall_sigma")
    ).withColumns({"lsl": F.lit(-10.0), "usl": F.lit(300.0), "target": F.lit(45.0)})
    primary = series(points).filter("series = 'PRIMARY'")
    return histogram(primary, values, layout)


@query(
    "a15_histogram",
    base(3) + HISTOGRAM + f"""
SELECT {CTX_SQL}, CAST(bin AS BIGINT) AS bin, round(range_start, 6) AS range_start, round(range_end, 6) AS range_end,
       CAST(c AS BIGINT) AS count FROM hist JOIN ids USING (k)
""",
)
def bins(spark, sf_dir):
    df = unpack(histogram_of(spark, sf_dir))
    return df.select(*CONTEXT, "bin", r6("range_start"), r6("range_end"), "count")


@query(
    "c12_normal_curve",
    base(3) + HISTOGRAM + f"""
SELECT {CTX_SQL}, CAST(bin AS BIGINT) AS bin,
       round(exp(-power(center - hm, 2) / (2 * hs * hs)) / (hs * sqrt(2 * pi())) * n * w, 6) AS normal_curve
FROM hist JOIN ids USING (k)
""",
)
def curve(spark, sf_dir):
    return unpack(histogram_of(spark, sf_dir)).select(*CONTEXT, "bin", r6("normal_curve"))


@query(
    "c13_bin_of_limit",
    base(3) + HISTOGRAM + f""",
mk AS (SELECT * FROM (VALUES ('USL', 300.0), ('TARGET', 45.0), ('LOW', -100000.0), ('HIGH', 100000.0)) AS t(mark, mv)),
b AS (SELECT k, mark, mv, min(CASE WHEN mv >= range_start AND mv <= range_end THEN bin END) AS hit, min(range_start) AS st, max(bin) AS last
      FROM hist, mk GROUP BY k, mark, mv)
SELECT {CTX_SQL}, mark, CAST(coalesce(hit, CASE WHEN mv < st THEN 0 ELSE last END) AS BIGINT) AS bin FROM b JOIN ids USING (k)
""",
)
def limit_bins(spark, sf_dir):
    hist = histogram_of(spark, sf_dir)
    marks = by_context(spark, sf_dir).select("ctx").distinct().withColumn(
        "_m",
        F.explode(F.array(*[F.struct(F.lit(n).alias("mark"), F.lit(v).alias("mark_value")) for n, v in
                            (("USL", 300.0), ("TARGET", 45.0), ("LOW", -100000.0), ("HIGH", 100000.0))])),
    ).select("ctx", "_m.*")
    return unpack(bin_of(hist, marks)).select(*CONTEXT, "mark", "bin")


@query(
    "a17_axis_range",
    base(5) + f""",
ax AS (SELECT p.k, least(min(mean), any_value(lim.lcl)) AS lo, greatest(max(mean), any_value(lim.ucl)) AS hi
       FROM p JOIN lim USING (k) GROUP BY p.k),
sp AS (SELECT *, coalesce(nullif(hi - lo, 0), nullif(abs(hi), 0), 1) AS span FROM ax)
SELECT {CTX_SQL}, CAST(format('{{:.8g}}', lo - span * 0.08) AS DOUBLE) AS axis_low,
       CAST(format('{{:.8g}}', hi + span * 0.08) AS DOUBLE) AS axis_high FROM sp JOIN ids USING (k)
""",
)
def axis(spark, sf_dir):
    points, _ = points_of(spark, sf_dir, 5)
    lines = control_limits(points).filter("center_line IS NOT NULL").select("ctx", "ucl", "lcl")
    return unpack(axis_range(series(points).filter("series = 'PRIMARY'"), lines))


@query(
    "c17_significant_digits",
    "SELECT event_id, format('{:.4g}', value * 1.234567) AS four, format('{:.6g}', value * 0.000123) AS six FROM events",
)
def digits(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", significant(F.col("value") * 1.234567, 4).alias("four"),
        significant(F.col("value") * 0.000123, 6).alias("six"),
    )
