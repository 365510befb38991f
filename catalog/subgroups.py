"""Sequence order and the ways to form subgroups."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sqltext import setting, subgroups
from catalog.tables import CTX_SQL, MEASUREMENTS, by_context, r6
from gaugeline.operators.layout import measure, unpack
from gaugeline.operators.subgroups import form_subgroups, sequence_rows
from gaugeline.plans.analysis import SpcConfig
from gaugeline.schema import CONTEXT

ROWS = ["source_row_number", "measurement_id"]
SEQUENCE = f"""
WITH m AS ({MEASUREMENTS})
SELECT {CTX_SQL}, measurement_id,
       CAST(row_number() OVER (PARTITION BY k ORDER BY event_timestamp, source_row_number) AS BIGINT) AS seq FROM m
"""


def sequenced(spark, sf_dir, config):
    rows = by_context(spark, sf_dir).select("ctx", "value", "event_timestamp", "subgroup_id", *ROWS)
    layout = measure(rows)
    numbered = sequence_rows(rows, layout, ROWS).drop(*ROWS)
    return numbered.withColumns(config.columns()), layout


def formed(spark, sf_dir, size, method, gap=14400, **options):
    rows, layout = sequenced(spark, sf_dir, SpcConfig(subgroup_size=size, subgroup_method=method, maximum_time_gap_seconds=gap))
    return form_subgroups(rows, layout, [method], **options), layout


def shown(df):
    return unpack(df).select(
        *CONTEXT, F.col("subgroup_id").alias("label"), "subgroup_index", F.col("count"), r6("mean"), r6("range"),
        r6("std_dev"), "start_timestamp", "end_timestamp",
    )


def shown_sql(size, method, gap=14400):
    return subgroups(setting(size, method, gap)) + f"""
SELECT {CTX_SQL}, label, CAST(idx AS BIGINT) AS subgroup_index, CAST(cnt AS BIGINT) AS count, round(mean, 6) AS mean,
       round(rng, 6) AS "range", round(sd, 6) AS std_dev, st AS start_timestamp, et AS end_timestamp
FROM sg JOIN ids USING (k)
"""


@query("w1_sequence_order", SEQUENCE)
def sequence_order(spark, sf_dir):
    rows = by_context(spark, sf_dir)
    return unpack(sequence_rows(rows, measure(rows), ROWS)).select(*CONTEXT, "measurement_id", "seq")


@query(
    "w1_sequence_without_times",
    f"""
WITH m AS ({MEASUREMENTS}), t AS (SELECT k, count(*) = count(CASE WHEN machine_id <> 'M1' OR source_row_number % 10 > 0 THEN 1 END) AS timed FROM m GROUP BY k)
SELECT {CTX_SQL}, measurement_id, CAST(row_number() OVER (PARTITION BY k
       ORDER BY CASE WHEN timed THEN event_timestamp END, source_row_number) AS BIGINT) AS seq FROM m JOIN t USING (k)
""",
)
def sequence_without_times(spark, sf_dir):
    rows = by_context(spark, sf_dir).withColumn(
        "event_timestamp",
        F.when((F.col("machine_id") != "M1") | (F.col("source_row_number") % 10 > 0), F.col("event_timestamp")),
    )
    return unpack(sequence_rows(rows, measure(rows), ROWS, stored_order=False)).select(*CONTEXT, "measurement_id", "seq")


@query("w2_single_subgroups", shown_sql(1, "TIME_WINDOW"))
def single(spark, sf_dir):
    return shown(formed(spark, sf_dir, 1, "TIME_WINDOW")[0])


@query("w3_existing_id_subgroups", shown_sql(5, "EXISTING_ID"))
def existing(spark, sf_dir):
    return shown(formed(spark, sf_dir, 5, "EXISTING_ID")[0])


@query("w4_fixed_size_subgroups", shown_sql(5, "FIXED_SIZE"))
def fixed(spark, sf_dir):
    return shown(formed(spark, sf_dir, 5, "FIXED_SIZE")[0])


@query("w5_consecutive_subgroups", shown_sql(5, "CONSECUTIVE"))
def consecutive(spark, sf_dir):
    return shown(formed(spark, sf_dir, 5, "CONSECUTIVE")[0])


@query("w6_time_window_subgroups", shown_sql(5, "TIME_WINDOW", 28800))
def window(spark, sf_dir):
    return shown(formed(spark, sf_dir, 5, "TIME_WINDOW", 28800)[0])


METHOD_OF = (
    "CASE parameter_id WHEN 'click' THEN 'CONSECUTIVE' WHEN 'view' THEN 'FIXED_SIZE' WHEN 'purchase' THEN 'TIME_WINDOW' "
    "WHEN 'error' THEN 'EXISTING_ID' ELSE 'CONSECUTIVE' END"
)
SIZE_OF = "CASE parameter_id WHEN 'view' THEN 4 WHEN 'signup' THEN 1 ELSE 5 END"


@query(
    "w7_subgroup_dispatch",
    subgroups(f"SELECT DISTINCT k, {SIZE_OF} AS size, {METHOD_OF} AS method, 28800 AS gap, 'AUTO' AS chart FROM m")
    + f"""
SELECT {CTX_SQL}, label, CAST(idx AS BIGINT) AS subgroup_index, CAST(cnt AS BIGINT) AS count, round(mean, 6) AS mean,
       round(rng, 6) AS "range", round(sd, 6) AS std_dev, st AS start_timestamp, et AS end_timestamp
FROM sg JOIN ids USING (k)
""",
)
def dispatch(spark, sf_dir):
    rows, layout = sequenced(spark, sf_dir, SpcConfig(maximum_time_gap_seconds=28800))
    name = F.col("ctx.parameter_id")
    rows = rows.withColumns(
        {
            "subgroup_method": F.when(name == "view", "FIXED_SIZE").when(name == "purchase", "TIME_WINDOW")
            .when(name == "error", "EXISTING_ID").otherwise("CONSECUTIVE"),
            "subgroup_size": F.when(name == "view", 4).when(name == "signup", 1).otherwise(5),
        }
    )
    return shown(form_subgroups(rows, layout))


@query(
    "a4_subgroup_members",
    subgroups(setting(4, "CONSECUTIVE"))
    + f"""
SELECT {CTX_SQL}, CAST(first_seq AS BIGINT) AS first_seq, round(sd0, 6) AS std_dev, indices, members FROM (
  SELECT k, min(seq) AS first_seq, stddev_samp(value) AS sd0,
         array_to_string(list(seq ORDER BY seq), ',') AS indices, array_to_string(list(value ORDER BY seq), ',') AS members
  FROM marked GROUP BY k, first_of) JOIN ids USING (k)
""",
)
def members(spark, sf_dir):
    df, _ = formed(spark, sf_dir, 4, "CONSECUTIVE", with_members=True)
    return unpack(df).select(
        *CONTEXT, "first_seq", r6("std_dev"), F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"),
        F.array_join(F.col("values").cast("array<string>"), ",").alias("members"),
    )


@query(
    "p14_subgroup_preconditions",
    subgroups(setting(150, "FIXED_SIZE"), longest=2)
    + f"""
SELECT {CTX_SQL}, CAST(count(sg.k) AS BIGINT) AS subgroups, count(sg.k) >= 2 AS enough FROM ids LEFT JOIN sg USING (k)
GROUP BY {CTX_SQL}
""",
)
def preconditions(spark, sf_dir):
    df, _ = formed(spark, sf_dir, 150, "FIXED_SIZE")
    every = by_context(spark, sf_dir).select("ctx").distinct()
    counted = every.join(df.groupBy("ctx").agg(F.count("*").alias("n")), "ctx", "left")
    counted = counted.withColumn("subgroups", F.coalesce("n", F.lit(0))).drop("n")
    return unpack(counted.withColumn("enough", F.col("subgroups") >= 2))
