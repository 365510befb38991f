"""The given tables read as measurements, hierarchy, specifications and configurations.

``events`` is the measurement stream, ``lineitem`` gives rows with codes to resolve,
``supplier``, ``part`` and ``nation`` stand in for machines, products and processes.
Every function has a SQL twin with the same columns.
"""

from pyspark.sql import functions as F

from catalog.registry import STEP
from gaugeline.operators.layout import context
from gaugeline.schema import CONTEXT

MEASUREMENTS = """
    SELECT 'E' || event_id AS measurement_id, 'U' || (event_id % 4) AS upload_id, ts AS event_timestamp,
           event_type AS parameter_id, 'M' || (user_id % 3) AS machine_id,
           CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'P1' END AS product_id,
           'PR' || (user_id % 2) AS process_id, 'O' || (user_id % 2) AS operation_id,
           value, event_id AS source_row_number, strftime(ts, '%Y-%m-%d-%H') AS subgroup_id,
           event_type || '|M' || (user_id % 3) || '|O' || (user_id % 2) AS k
    FROM events
"""
CTX_SQL = "parameter_id, machine_id, product_id, operation_id"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(prefix, column):
    return F.concat(F.lit(prefix), column.cast("string"))


def measurements(spark, sf_dir):
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        text("E", F.col("event_id")).alias("measurement_id"),
        text("U", F.col("event_id") % 4).alias("upload_id"),
        F.col("ts").alias("event_timestamp"),
        F.col("event_type").alias("parameter_id"),
        text("M", user % 3).alias("machine_id"),
        F.when(user % 3 != 0, "P1").alias("product_id"),
        text("PR", user % 2).alias("process_id"),
        text("O", user % 2).alias("operation_id"),
        "value",
        F.col("event_id").alias("source_row_number"),
        F.date_format("ts", "yyyy-MM-dd-HH").alias("subgroup_id"),
    )


def by_context(spark, sf_dir):
    return context(measurements(spark, sf_dir), CONTEXT)


def r6(column, name=None):
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c + STEP, 6).alias(name or column)


def specifications(spark):
    return spark.sql(
        "SELECT specification_id, parameter_id, machine_id, product_id, operation_id, lsl, usl, target, "
        "CAST(effective_from AS TIMESTAMP_NTZ) AS effective_from, CAST(effective_to AS TIMESTAMP_NTZ) AS effective_to, "
        f"status FROM VALUES {SPECIFICATION_VALUES} AS t({SPECIFICATION_COLUMNS})"
    )


SPECIFICATION_COLUMNS = (
    "specification_id, parameter_id, machine_id, product_id, operation_id, lsl, usl, target, effective_from, "
    "effective_to, status"
)
SPECIFICATION_VALUES = """
    ('S01', 'click',    NULL, NULL, NULL, CAST(0 AS DOUBLE), CAST(200 AS DOUBLE), CAST(50 AS DOUBLE), '2024-01-01', NULL, 'ACTIVE'),
    ('S02', 'click',    'M1', NULL, NULL, CAST(1 AS DOUBLE), CAST(150 AS DOUBLE), CAST(40 AS DOUBLE), '2024-01-01', NULL, 'ACTIVE'),
    ('S03', 'click',    'M1', 'P1', 'O1', CAST(2 AS DOUBLE), CAST(120 AS DOUBLE), CAST(NULL AS DOUBLE), '2024-01-01', '2024-02-01', 'ACTIVE'),
    ('S04', 'click',    'M1', 'P1', 'O1', CAST(3 AS DOUBLE), CAST(110 AS DOUBLE), CAST(NULL AS DOUBLE), '2024-01-02', NULL, 'ARCHIVED'),
    ('S05', 'view',     NULL, NULL, 'O0', CAST(NULL AS DOUBLE), CAST(180 AS DOUBLE), CAST(NULL AS DOUBLE), '2024-01-01', NULL, 'ACTIVE'),
    ('S06', 'view',     NULL, NULL, NULL, CAST(-50 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), '2023-01-01', NULL, 'ACTIVE'),
    ('S07', 'view',     NULL, NULL, NULL, CAST(-60 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), '2023-06-01', NULL, 'ACTIVE'),
    ('S08', 'purchase', NULL, 'P1', NULL, CAST(-100 AS DOUBLE), CAST(400 AS DOUBLE), CAST(60 AS DOUBLE), '2024-01-01', NULL, 'ACTIVE'),
    ('S09', 'purchase', NULL, NULL, NULL, CAST(-300 AS DOUBLE), CAST(400 AS DOUBLE), CAST(60 AS DOUBLE), '2030-01-01', NULL, 'ACTIVE'),
    ('S10', 'error',    'M2', NULL, NULL, CAST(5 AS DOUBLE), CAST(90 AS DOUBLE), CAST(45 AS DOUBLE), '2023-01-01', '2024-01-15', 'ACTIVE')
"""
SPECIFICATIONS = (
    "SELECT specification_id, parameter_id, machine_id, product_id, operation_id, lsl, usl, target, "
    "CAST(effective_from AS TIMESTAMP) AS effective_from, CAST(effective_to AS TIMESTAMP) AS effective_to, status "
    f"FROM (VALUES {SPECIFICATION_VALUES}) AS t({SPECIFICATION_COLUMNS})"
)

CONFIGURATION_COLUMNS = (
    "spc_configuration_id, parameter_id, machine_id, product_id, operation_id, chart_type, subgroup_size, "
    "subgroup_method, maximum_time_gap_seconds, minimum_sample_size, ruleset, is_active, created_at"
)
# One method per parameter, so a run over all contexts uses every way to form subgroups.
CONFIGURATION_VALUES = """
    ('C01', 'click',    NULL, NULL, NULL, 'AUTO',   5, 'CONSECUTIVE', 14400, 20, '[]', true, '2024-01-01'),
    ('C02', 'view',     NULL, NULL, NULL, 'AUTO',   4, 'FIXED_SIZE',  3600,  20, '[]', true, '2024-01-01'),
    ('C03', 'view',     'M2', NULL, NULL, 'XBAR_R', 4, 'FIXED_SIZE',  3600,  100000000, '[]', true, '2024-01-01'),
    ('C04', 'purchase', NULL, NULL, NULL, 'AUTO',   6, 'TIME_WINDOW', 43200, 20, '[]', true, '2024-01-01'),
    ('C05', 'error',    NULL, NULL, NULL, 'IMR',    1, 'CONSECUTIVE', 3600,  20, '[]', true, '2024-01-01'),
    ('C06', 'error',    'M0', NULL, NULL, 'XBAR_S', 1, 'CONSECUTIVE', 3600,  20, '[]', true, '2024-01-02'),
    ('C07', 'click',    'M0', NULL, NULL, 'AUTO',   9, 'FIXED_SIZE',  3600,  20, '[{"rule_name":"TREND_INCREASING","enabled":true,"severity":"CRITICAL","parameters":{"consecutive_points":3}},{"rule_name":"RUN_SAME_SIDE","enabled":false},{"rule_name":"POINT_OUTSIDE_LIMITS"}]', true, '2024-01-01'),
    ('C08', 'click',    'M0', NULL, NULL, 'AUTO',   7, 'FIXED_SIZE',  3600,  20, '[]', false, '2024-01-05')
"""


def configurations(spark):
    return spark.sql(
        f"SELECT * EXCEPT (created_at), CAST(created_at AS TIMESTAMP_NTZ) AS created_at "
        f"FROM VALUES {CONFIGURATION_VALUES} AS t({CONFIGURATION_COLUMNS})"
    )


CONFIGURATIONS = (
    "SELECT * REPLACE (CAST(created_at AS TIMESTAMP) AS created_at) "
    f"FROM (VALUES {CONFIGURATION_VALUES}) AS t({CONFIGURATION_COLUMNS})"
)

# Raw text rows with every kind of defect, as a client file would hold them.
RAW = """
    SELECT event_id AS source_row_number, 'U' || (event_id % 4) AS upload_id,
           CASE WHEN event_id % 97 = 0 OR event_id % 73 = 0 OR event_id % 83 = 0 OR event_id % 89 = 0
                     OR event_id % 79 = 0 THEN NULL ELSE value END AS value,
           CASE WHEN event_id % 97 = 0 OR event_id % 73 = 0 OR event_id % 83 = 0 THEN 'MISSING_VALUE'
                WHEN event_id % 89 = 0 OR event_id % 79 = 0 THEN 'INVALID_NUMERIC_VALUE' ELSE 'VALID' END AS value_status,
           CASE WHEN event_id % 71 = 0 OR event_id % 67 = 0 THEN NULL
                WHEN event_id % 61 = 0 THEN TIMESTAMP '2024-01-15 10:11:12' ELSE ts END AS event_timestamp,
           CASE WHEN event_id % 71 = 0 OR event_id % 67 = 0 THEN 'INVALID_TIMESTAMP' ELSE 'VALID' END AS time_status,
           CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 41 = 0 THEN 'zzz' ELSE event_type END AS parameter_name,
           CASE WHEN event_id % 59 = 0 THEN 'MX' ELSE 'M' || (user_id % 3) END AS machine_code,
           CASE WHEN user_id % 3 = 0 THEN NULL WHEN event_id % 53 = 0 THEN 'PX' ELSE 'P1' END AS product_code,
           CASE WHEN event_id % 47 = 0 THEN 'OX' ELSE 'O' || (user_id % 2) END AS operation_code,
           CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 37 = 0 THEN 'inch'
                WHEN event_id % 2 = 0 THEN ' MM ' ELSE 'mm' END AS unit
    FROM (SELECT * FROM events UNION ALL
          SELECT event_id + 1000000000, ts, user_id, event_type, value, props FROM events WHERE event_id % 50 = 0)
"""


def raw_rows(spark, sf_dir):
    """The same rows as text under client column names."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    again = events.filter("event_id % 50 = 0").withColumn("event_id", F.col("event_id") + 1000000000)
    df = events.unionByName(again)

    def every(n):
        return F.col("event_id") % n == 0

    return df.select(
        F.col("event_id").alias("source_row_number"),
        text("U", F.col("event_id") % 4).alias("upload_id"),
        F.when(every(97), "").when(every(73), " ").when(every(83), "NaN").when(every(89), "abc")
        .when(every(79), "inf").otherwise(F.col("value").cast("string")).alias("READING"),
        F.when(every(71), "2026-13-45").when(every(67), "").when(every(61), "20240115T101112")
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("MEASURED_AT"),
        F.when(every(43), F.lit(None)).when(every(41), "zzz").otherwise(F.col("event_type")).alias("FEATURE"),
        F.when(every(59), "MX").otherwise(text("M", F.col("user_id") % 3)).alias("STATION"),
        F.when(F.col("user_id") % 3 == 0, F.lit(None)).when(every(53), "PX").otherwise("P1").alias("ARTICLE"),
        F.when(every(47), "OX").otherwise(text("O", F.col("user_id") % 2)).alias("STEP_CODE"),
        F.when(every(31), F.lit(None)).when(every(37), "inch").when(every(2), " MM ").otherwise("mm").alias("UNIT"),
    )


MAPPING = {
    "MEASURED_AT": "event_timestamp",
    "STATION": "machine_code",
    "ARTICLE": "product_code",
    "STEP_CODE": "operation_code",
    "FEATURE": "parameter_name",
    "READING": "value",
    "UNIT": "unit",
}

# Rows with codes and the upload's plant and organization, over lineitem.
CODED = """
    SELECT l_orderkey, l_linenumber, l_quantity,
           CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'N9' ELSE 'N' || (l_suppkey % 4) END AS plant_id,
           CASE WHEN l_linenumber = 7 THEN NULL ELSE 'R' || (l_partkey % 3) END AS organization_id,
           CASE WHEN l_linenumber = 5 THEN NULL ELSE 'M' || l_suppkey END AS machine_code,
           CASE WHEN l_linenumber = 4 THEN NULL ELSE 'P' || l_partkey END AS product_code,
           'O' || (l_suppkey % 7) AS operation_code, l_returnflag AS parameter_name,
           CASE WHEN l_linenumber % 2 = 0 THEN 'inch' ELSE NULL END AS unit
    FROM lineitem
"""
MACHINES = "SELECT 'N' || (s_suppkey % 4) AS plant_id, 'M' || s_suppkey AS code, 'MID' || s_suppkey AS machine_id FROM supplier"
PRODUCTS = "SELECT 'R' || (p_partkey % 3) AS organization_id, 'P' || p_partkey AS part_number, 'PID' || p_partkey AS product_id FROM part"
PROCESSES = "SELECT 'PR' || n_nationkey AS process_id, 'R' || (n_nationkey % 3) AS organization_id FROM nation"
OPERATIONS = "SELECT 'OP' || (100 + n_nationkey) AS operation_id, 'PR' || n_nationkey AS process_id, 'O' || (n_nationkey % 5) AS code FROM nation"
PARAMETERS = "SELECT DISTINCT l_returnflag AS name, 'PAR' || l_returnflag AS parameter_id, 'mm' AS unit FROM lineitem WHERE l_returnflag <> 'N'"


def coded_rows(spark, sf_dir):
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.when(line == 7, F.lit(None)).when(line == 6, "N9").otherwise(text("N", F.col("l_suppkey") % 4)).alias("plant_id"),
        F.when(line != 7, text("R", F.col("l_partkey") % 3)).alias("organization_id"),
        F.when(line != 5, text("M", F.col("l_suppkey"))).alias("machine_code"),
        F.when(line != 4, text("P", F.col("l_partkey"))).alias("product_code"),
        text("O", F.col("l_suppkey") % 7).alias("operation_code"),
        F.col("l_returnflag").alias("parameter_name"),
        F.when(line % 2 == 0, "inch").alias("unit"),
    )


def dimensions(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return {
        "machines": table(spark, sf_dir, "supplier").select(
            text("N", F.col("s_suppkey") % 4).alias("plant_id"), text("M", F.col("s_suppkey")).alias("code"),
            text("MID", F.col("s_suppkey")).alias("machine_id"),
        ),
        "products": table(spark, sf_dir, "part").select(
            text("R", F.col("p_partkey") % 3).alias("organization_id"), text("P", F.col("p_partkey")).alias("part_number"),
            text("PID", F.col("p_partkey")).alias("product_id"),
        ),
        "processes": nation.select(
            text("PR", F.col("n_nationkey")).alias("process_id"), text("R", F.col("n_nationkey") % 3).alias("organization_id")
        ),
        "operations": nation.select(
            text("OP", F.col("n_nationkey") + 100).alias("operation_id"), text("PR", F.col("n_nationkey")).alias("process_id"),
            text("O", F.col("n_nationkey") % 5).alias("code"),
        ),
        "parameters": table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("name")).distinct()
        .filter("name <> 'N'").select("name", text("PAR", F.col("name")).alias("parameter_id"), F.lit("mm").alias("unit")),
    }
