"""Profiles, preconditions, descriptive statistics, effective settings."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import (
    CONFIGURATIONS, CTX_SQL, MEASUREMENTS, SPECIFICATIONS, by_context, configurations, measurements, r6, specifications,
    table, text,
)
from gaugeline.functions.capability import capability_band, capability_long, sigma_level_band, with_capability
from gaugeline.operators.effective import active_baselines, effective_configurations, effective_specifications
from gaugeline.operators.layout import context, measure, unpack
from gaugeline.operators.statistics import (
    MissingColumns, candidate_sizes, descriptive_statistics, overall_sigma, precondition_profile, profile_dataset, require_columns, sampling_interval,
    upload_counts, valid_value,
)
from gaugeline.schema import CONTEXT

PER_MACHINE = f"""
WITH m AS ({MEASUREMENTS})
SELECT machine_id, CAST(count(*) AS BIGINT) AS total_observations,
       CAST(count(value) AS BIGINT) AS valid_observations, CAST(0 AS BIGINT) AS invalid_observations,
       CAST(count(DISTINCT product_id) AS BIGINT) AS unique_products,
       CAST(count(DISTINCT process_id) AS BIGINT) AS unique_processs,
       CAST(count(DISTINCT operation_id) AS BIGINT) AS unique_operations,
       CAST(count(DISTINCT parameter_id) AS BIGINT) AS unique_parameters,
       array_to_string(list_sort(list(DISTINCT parameter_id)), ',') AS parameters,
       min(event_timestamp) AS time_start, max(event_timestamp) AS time_end,
       count(subgroup_id) > 0 AS existing_subgroup_ids_detected,
       round((epoch_us(max(event_timestamp)) - epoch_us(min(event_timestamp))) / 1e6 / (count(*) - 1), 3) AS average_interval
FROM m GROUP BY machine_id
"""


@query("a1_dataset_profile", PER_MACHINE)
def dataset_profile(spark, sf_dir):
    profile = profile_dataset(context(measurements(spark, sf_dir), ["machine_id"]))
    return unpack(profile).select(
        "machine_id", "total_observations", "valid_observations", "invalid_observations", "unique_products",
        "unique_processs", "unique_operations", "unique_parameters",
        F.array_join("parameters", ",").alias("parameters"), "time_start", "time_end", "existing_subgroup_ids_detected",
        F.round("average_sampling_interval_seconds", 3).alias("average_interval"),
    )


@query(
    "a2_sampling_interval",
    f"""
WITH m AS ({MEASUREMENTS}),
g AS (SELECT k, {CTX_SQL}, epoch_us(event_timestamp) - lag(epoch_us(event_timestamp))
      OVER (PARTITION BY k ORDER BY event_timestamp) AS gap FROM m)
SELECT {CTX_SQL}, round(avg(gap) / 1e6, 3) AS average_interval FROM g GROUP BY {CTX_SQL}
""",
)
def interval(spark, sf_dir):
    df = by_context(spark, sf_dir).groupBy("ctx").agg(
        sampling_interval(F.min("event_timestamp"), F.max("event_timestamp"), F.count("event_timestamp")).alias("s")
    )
    return unpack(df.select("ctx", F.round("s", 3).alias("average_interval")))


@query(
    "a3_candidate_sizes",
    """
SELECT l_suppkey, array_to_string(list_filter([2,3,4,5,6,8,10], lambda n: count(*) // n >= 2), ',') AS sizes
FROM lineitem GROUP BY l_suppkey, l_returnflag
""",
)
def sizes(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return df.select("l_suppkey", F.array_join(candidate_sizes(F.col("n")).cast("array<string>"), ",").alias("sizes"))


@query(
    "a9_descriptive_statistics",
    f"""
WITH m AS ({MEASUREMENTS})
SELECT {CTX_SQL}, round(avg(value), 6) AS mean, min(value) AS minimum, max(value) AS maximum,
       CAST(count(*) AS BIGINT) AS count, round(median(value), 6) AS median, round(max(value) - min(value), 6) AS "range"
FROM m GROUP BY {CTX_SQL}
""",
)
def descriptive(spark, sf_dir):
    rows = by_context(spark, sf_dir)
    df = descriptive_statistics(rows, measure(rows))
    return unpack(df).select(*CONTEXT, r6("mean"), "minimum", "maximum", "count", r6("median"), r6("range"))


@query(
    "a9_median_by_supplier",
    """
SELECT l_suppkey, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY l_suppkey
""",
)
def median_by_supplier(spark, sf_dir):
    rows = context(
        table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("value")), ["l_suppkey"]
    )
    return unpack(descriptive_statistics(rows, measure(rows))).select("l_suppkey", r6("median"))


@query(
    "a10_overall_sigma",
    """
SELECT l_suppkey, CAST(count(*) AS BIGINT) AS count, round(stddev_samp(l_quantity), 6) AS overall_sigma
FROM lineitem GROUP BY l_suppkey
""",
)
def sigma(spark, sf_dir):
    rows = context(
        table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("value")), ["l_suppkey"]
    )
    return unpack(overall_sigma(rows)).select("l_suppkey", "count", r6("overall_sigma"))


@query(
    "a12_upload_counts",
    """
SELECT 'U' || (event_id % 4) AS upload_id, CAST(count(*) AS BIGINT) AS total_rows,
       CAST(count(*) FILTER (value < 100) AS BIGINT) AS valid_rows,
       CAST(count(*) FILTER (NOT value < 100) AS BIGINT) AS invalid_rows
FROM events GROUP BY 1
""",
)
def counts(spark, sf_dir):
    rows = measurements(spark, sf_dir).withColumn(
        "quality_status", F.when(F.col("value") < 100, "VALID").otherwise("INVALID_NUMERIC_VALUE")
    )
    return upload_counts(rows)


@query(
    "p10_valid_values",
    """
SELECT event_id, value FROM events WHERE event_id % 9 <> 0 AND event_id % 7 <> 0
""",
)
def valid_values(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 9 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, F.lit(float("nan")))
        .otherwise(F.col("value")).alias("value"),
    )
    return rows.filter(valid_value())


@query(
    "p11_required_columns",
    """
SELECT 'events' AS dataset, CAST(count(*) AS BIGINT) AS n, NULL AS problem FROM events
UNION ALL SELECT 'lineitem', count(*), 'Measurement dataset is missing required column(s): value.' FROM lineitem
UNION ALL SELECT 'orders', count(*), 'Measurement dataset is missing required column(s): value.' FROM orders
""",
)
def required_columns(spark, sf_dir):
    def checked(name):
        df, problem = table(spark, sf_dir, name), None
        try:
            require_columns(df)
        except MissingColumns as error:
            problem = str(error)
        return df.agg(F.count("*").alias("n")).select(
            F.lit(name).alias("dataset"), "n", F.lit(problem).cast("string").alias("problem")
        )

    return checked("events").unionByName(checked("lineitem")).unionByName(checked("orders"))


@query(
    "p12_sample_size",
    """
SELECT l_suppkey, l_returnflag, CAST(count(*) AS BIGINT) AS valid_observations,
       CASE WHEN count(*) < 150 THEN 'INSUFFICIENT_DATA' END AS error_code
FROM lineitem GROUP BY ALL
""",
)
def sample_size(spark, sf_dir):
    rows = context(
        table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_quantity").alias("value"))
        .withColumns({"event_timestamp": F.lit(None).cast("timestamp_ntz"), "subgroup_id": F.lit(None).cast("string")}),
        ["l_suppkey", "l_returnflag"],
    )
    df = unpack(precondition_profile(rows).select("ctx", "valid_observations"))
    return df.withColumn("error_code", F.when(F.col("valid_observations") < 150, "INSUFFICIENT_DATA"))


@query(
    "p13_single_context",
    f"""
WITH m AS ({MEASUREMENTS})
SELECT upload_id, machine_id,
       array_to_string(list_filter([
         CASE WHEN count(DISTINCT product_id) > 1 THEN 'product_id' END,
         CASE WHEN count(DISTINCT process_id) > 1 THEN 'process_id' END,
         CASE WHEN count(DISTINCT operation_id) > 1 THEN 'operation_id' END,
         CASE WHEN count(DISTINCT parameter_id) > 1 THEN 'parameter_id' END], lambda x: x IS NOT NULL), ',') AS mixed
FROM m GROUP BY upload_id, machine_id
""",
)
def single_context(spark, sf_dir):
    rows = context(measurements(spark, sf_dir), ["upload_id", "machine_id"])
    df = unpack(precondition_profile(rows).select("ctx", "mixed_columns"))
    return df.select("upload_id", "machine_id", F.array_join("mixed_columns", ",").alias("mixed"))


CONTEXTS_SQL = f"SELECT DISTINCT {CTX_SQL} FROM ({MEASUREMENTS})"
SPEC_JOIN = f"""
c AS ({CONTEXTS_SQL}), s AS ({SPECIFICATIONS}),
best AS (SELECT c.*, s.specification_id, s.lsl, s.usl, s.target, row_number() OVER (
    PARTITION BY c.parameter_id, c.machine_id, c.product_id, c.operation_id
    ORDER BY (s.machine_id IS NOT NULL)::INT + (s.product_id IS NOT NULL)::INT + (s.operation_id IS NOT NULL)::INT DESC,
             s.effective_from DESC, s.specification_id) AS rn
  FROM c JOIN s ON s.parameter_id = c.parameter_id AND s.status = 'ACTIVE'
   AND (s.machine_id IS NULL OR s.machine_id = c.machine_id)
   AND (s.product_id IS NULL OR s.product_id = c.product_id)
   AND (s.operation_id IS NULL OR s.operation_id = c.operation_id)
   AND s.effective_from <= TIMESTAMP '2024-01-20 00:00:00'
   AND (s.effective_to IS NULL OR s.effective_to > TIMESTAMP '2024-01-20 00:00:00')),
spec AS (SELECT * EXCLUDE (rn) FROM best WHERE rn = 1)
"""
AS_OF = "2024-01-20 00:00:00"


def contexts(spark, sf_dir):
    return measurements(spark, sf_dir).select(*CONTEXT).distinct()


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("j6_effective_specification", f"WITH {SPEC_JOIN} SELECT * FROM spec")
def effective_specification(spark, sf_dir):
    df = effective_specifications(contexts(spark, sf_dir), specifications(spark), as_of())
    return df.select(*CONTEXT, "specification_id", "lsl", "usl", "target")


CONFIG_JOIN = f"""
cc AS ({CONTEXTS_SQL}), g AS ({CONFIGURATIONS}),
gbest AS (SELECT cc.*, g.spc_configuration_id, g.chart_type, g.subgroup_size, g.subgroup_method,
    g.maximum_time_gap_seconds AS gap, g.minimum_sample_size, row_number() OVER (
    PARTITION BY cc.parameter_id, cc.machine_id, cc.product_id, cc.operation_id
    ORDER BY (g.machine_id IS NOT NULL)::INT + (g.product_id IS NOT NULL)::INT + (g.operation_id IS NOT NULL)::INT DESC,
             g.created_at DESC, g.spc_configuration_id) AS rn
  FROM cc JOIN g ON g.parameter_id = cc.parameter_id AND g.is_active
   AND (g.machine_id IS NULL OR g.machine_id = cc.machine_id)
   AND (g.product_id IS NULL OR g.product_id = cc.product_id)
   AND (g.operation_id IS NULL OR g.operation_id = cc.operation_id)),
conf AS (SELECT * EXCLUDE (rn) FROM gbest WHERE rn = 1)
"""


@query(
    "j7_effective_configuration",
    f"WITH {CONFIG_JOIN} SELECT {CTX_SQL}, spc_configuration_id, chart_type, subgroup_size, subgroup_method FROM conf",
)
def effective_configuration(spark, sf_dir):
    df = effective_configurations(contexts(spark, sf_dir), configurations(spark))
    return df.select(*CONTEXT, "spc_configuration_id", "chart_type", "subgroup_size", "subgroup_method")


@query(
    "j8_active_baseline",
    f"""
WITH m AS ({MEASUREMENTS}), c AS ({CONTEXTS_SQL}),
b AS (SELECT parameter_id, CASE WHEN machine_id = 'M2' THEN NULL ELSE machine_id END AS machine_id, product_id,
             operation_id, 'B-' || k AS baseline_id,
             CASE WHEN max(value) > 250 THEN 'ACTIVE' ELSE 'DRAFT' END AS status FROM m GROUP BY ALL)
SELECT c.*, b.baseline_id FROM c JOIN b ON b.parameter_id = c.parameter_id AND b.status = 'ACTIVE'
 AND b.machine_id IS NOT DISTINCT FROM c.machine_id AND b.product_id IS NOT DISTINCT FROM c.product_id
 AND b.operation_id IS NOT DISTINCT FROM c.operation_id
""",
)
def active_baseline(spark, sf_dir):
    m = measurements(spark, sf_dir)
    b = m.groupBy(*CONTEXT).agg(F.max("value").alias("top")).select(
        "parameter_id", F.when(F.col("machine_id") != "M2", F.col("machine_id")).alias("machine_id"), "product_id",
        "operation_id", F.concat_ws("|", text("B-", F.col("parameter_id")), "machine_id", "operation_id").alias("baseline_id"),
        F.when(F.col("top") > 250, "ACTIVE").otherwise("DRAFT").alias("status"),
    )
    return active_baselines(contexts(spark, sf_dir), b).select(*CONTEXT, "baseline_id")


SUPPLIER_CAPABILITY = """
WITH p AS (SELECT l_suppkey, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS overall_sigma,
                  CASE WHEN l_suppkey % 10 = 0 THEN 0.0 ELSE stddev_samp(l_quantity) * 0.9 END AS within_sigma,
                  CAST(count(*) AS BIGINT) AS n,
                  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE -20.0 END AS lsl,
                  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 90.0 END AS usl FROM lineitem GROUP BY l_suppkey),
q AS (SELECT *, (usl - mean) / (3 * nullif(within_sigma, 0)) AS cpu, (mean - lsl) / (3 * nullif(within_sigma, 0)) AS cpl,
             (usl - lsl) / (6 * nullif(within_sigma, 0)) AS cp, (usl - mean) / (3 * overall_sigma) AS ppu,
             (mean - lsl) / (3 * overall_sigma) AS ppl, (usl - lsl) / (6 * overall_sigma) AS pp FROM p),
c AS (SELECT *, least(cpu, cpl) AS cpk, least(ppu, ppl) AS ppk FROM q)
"""


def supplier_capability(spark, sf_dir):
    q = F.col("l_quantity")
    df = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.avg(q).alias("mean"), F.stddev_samp(q).alias("overall_sigma"), F.count("*").alias("valid_observations")
    )
    key = F.col("l_suppkey")
    df = df.withColumns(
        {
            "within_sigma": F.when(key % 10 == 0, 0.0).otherwise(F.col("overall_sigma") * 0.9),
            "lsl": F.when(key % 3 != 0, -20.0),
            "usl": F.when(key % 4 != 0, 90.0),
        }
    )
    return with_capability(df)


@query(
    "c6_capability",
    SUPPLIER_CAPABILITY
    + """
SELECT l_suppkey, round(cp, 6) AS cp, round(cpk, 6) AS cpk, round(cpu, 6) AS cpu, round(cpl, 6) AS cpl,
       round(pp, 6) AS pp, round(ppk, 6) AS ppk, round(ppu, 6) AS ppu, round(ppl, 6) AS ppl,
       round(3 * cpk, 6) AS sigma_level_short_term, round(3 * cpk - 1.5, 6) AS sigma_level_long_term,
       CAST(CASE WHEN lsl IS NULL AND usl IS NULL THEN 1 ELSE (n < 20)::INT + (within_sigma = 0)::INT
            + (usl IS NULL)::INT + (lsl IS NULL)::INT END AS BIGINT) AS warnings
FROM c
""",
)
def capability(spark, sf_dir):
    names = ("cp", "cpk", "cpu", "cpl", "pp", "ppk", "ppu", "ppl", "sigma_level_short_term", "sigma_level_long_term")
    return supplier_capability(spark, sf_dir).select(
        "l_suppkey", *[r6(c) for c in names], F.size("capability_warnings").cast("long").alias("warnings")
    )


@query(
    "c14_capability_bands",
    SUPPLIER_CAPABILITY
    + """
SELECT l_suppkey,
       CASE WHEN cpk IS NULL THEN 'warning' WHEN cpk >= 1.33 THEN 'normal' WHEN cpk >= 1.0 THEN 'warning'
            ELSE 'critical' END AS cpk_band,
       CASE WHEN cpk IS NULL THEN 'warning' WHEN 3 * cpk >= 6 THEN 'normal' WHEN 3 * cpk >= 3 THEN 'warning'
            ELSE 'critical' END AS sigma_band FROM c
""",
)
def bands(spark, sf_dir):
    return supplier_capability(spark, sf_dir).select(
        "l_suppkey", capability_band(F.col("cpk")).alias("cpk_band"),
        sigma_level_band(F.col("sigma_level_short_term")).alias("sigma_band"),
    )


@query(
    "c16_capability_long",
    SUPPLIER_CAPABILITY
    + """
, u AS (SELECT l_suppkey, 'Cp' AS metric, cp AS value, 'Short-term (potential)' AS "group" FROM c
 UNION ALL SELECT l_suppkey, 'Cpk', cpk, 'Short-term (actual)' FROM c
 UNION ALL SELECT l_suppkey, 'Pp', pp, 'Long-term (potential)' FROM c
 UNION ALL SELECT l_suppkey, 'Ppk', ppk, 'Long-term (actual)' FROM c)
SELECT l_suppkey, metric, round(value, 6) AS value, "group" FROM u WHERE value IS NOT NULL
""",
)
def capability_rows(spark, sf_dir):
    df = capability_long(supplier_capability(spark, sf_dir), ["l_suppkey"])
    return df.select("l_suppkey", "metric", r6("value"), "group")
