"""File scans, quality checks, context resolution, bronze and silver tables."""

import uuid

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import (
    CODED, MACHINES, MAPPING, MEASUREMENTS, OPERATIONS, PARAMETERS, PROCESSES, PRODUCTS, RAW, coded_rows, dimensions,
    measurements, raw_rows, table, text,
)
from gaugeline.operators.layout import scratch_root
from gaugeline.operators.quality import (
    blank_to_null, flag_duplicates, parse_number, parse_timestamp, run_validation, unit_status, validate_rows,
)
from gaugeline.operators.resolve import (
    resolve_context, resolve_machine, resolve_operation, resolve_parameter, resolve_product,
)
from gaugeline.operators.statistics import upload_counts
from gaugeline.plans.ingest import CARRIED, UploadContext, clean, process_uploads, read_ledger
from gaugeline.plans.ledger import status_history, upload_state
from gaugeline.schema import SILVER_READ
from gaugeline.sources.csv import apply_mapping, gate_reason, number_source_rows, read_csv
from gaugeline.sources.tables import (
    append, append_bronze, append_silver, bronze_rows, by_context, by_time_range, by_upload, json_text, measurements as
    read_measurements, nan_to_null, read_silver,
)


def folder(spark, name):
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_csv(df, path):
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


NOTE = (
    "CASE event_id % 7 WHEN 0 THEN 'NA' WHEN 1 THEN 'N/A' WHEN 2 THEN 'null' WHEN 3 THEN 'NULL' WHEN 4 THEN '' "
    "WHEN 5 THEN 'nan' ELSE 'ok, \"quoted\"' END"
)


@query(
    "s1_csv_scan",
    f"""
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(value AS VARCHAR) AS value, event_type,
       CASE WHEN event_id % 7 > 4 THEN {NOTE} END AS note FROM events
""",
)
def csv_scan(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(
        F.col("event_id").alias(" event_id "), F.col("value"), F.col("event_type"), F.expr(NOTE).alias("note "),
    )
    return read_csv(spark, write_csv(df, folder(spark, "csv"))).select("event_id", "value", "event_type", "note")


@query(
    "s2_landing_gate",
    """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'MISSING_NAME' WHEN doc_id % 5 = 1 THEN 'UNSUPPORTED_TYPE'
  WHEN n_chars < 300 THEN 'EMPTY_FILE' WHEN n_chars > 900 THEN 'TOO_LARGE' END AS reason FROM documents
""",
)
def landing_gate(spark, sf_dir):
    kind = F.col("doc_id") % 5
    name = (
        F.when(kind == 0, "").when(kind == 1, text("d", F.col("doc_id")))
        .when(kind == 2, F.concat(text("d", F.col("doc_id")), F.lit(".x.CSV"))).otherwise(F.concat(F.col("source"), F.lit(".csv")))
    )
    size = F.when(F.col("n_chars") < 300, 0).when(F.col("n_chars") > 900, F.lit(200 * 1024 * 1024 + 1)).otherwise(F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", gate_reason(name, size).alias("reason"))


def uploaded(spark, sf_dir):
    return raw_rows(spark, sf_dir).withColumns(
        {
            "source_file_name": F.lit("events.csv"),
            "organization_id": F.lit("R1"), "plant_id": F.lit("N1"), "production_line_id": F.lit(None).cast("string"),
        }
    )


SOURCE = [*MAPPING, ]


@query(
    "s3_bronze_rows",
    f"""
SELECT source_row_number, upload_id, parameter_name AS raw_parameter, machine_code AS raw_machine_id,
       product_code AS raw_product_id, operation_code AS raw_operation, unit AS raw_unit,
       parameter_name AS payload_parameter, unit AS payload_unit, 'INGESTED' AS record_status FROM ({RAW})
""",
)
def bronze(spark, sf_dir):
    df = bronze_rows(uploaded(spark, sf_dir), SOURCE, MAPPING)
    return df.select(
        "source_row_number", "upload_id", "raw_parameter", "raw_machine_id", "raw_product_id", "raw_operation", "raw_unit",
        F.expr("variant_get(raw_payload, '$.FEATURE', 'string')").alias("payload_parameter"),
        F.expr("variant_get(raw_payload, '$.UNIT', 'string')").alias("payload_unit"), "record_status",
    )


@query(
    "s4_bronze_append",
    f"SELECT upload_id, CAST(count(*) AS BIGINT) AS n, CAST(count(parameter_name) AS BIGINT) AS named FROM ({RAW}) GROUP BY upload_id",
)
def bronze_append(spark, sf_dir):
    path = folder(spark, "bronze")
    append_bronze(bronze_rows(uploaded(spark, sf_dir), SOURCE, MAPPING), path)
    return spark.read.parquet(path).groupBy("upload_id").agg(
        F.count("raw_record_id").alias("n"),
        F.count(F.expr("variant_get(raw_payload, '$.FEATURE', 'string')")).alias("named"),
    )


QUALITY = f"""
q AS (SELECT *, CASE WHEN value_status <> 'VALID' THEN value_status WHEN time_status <> 'VALID' THEN time_status
                     WHEN parameter_name IS NULL THEN 'INVALID_CONTEXT' ELSE 'VALID' END AS first_status FROM ({RAW})),
d AS (SELECT *, CASE WHEN first_status = 'VALID' AND row_number() OVER (PARTITION BY upload_id, parameter_name, machine_code,
        product_code, operation_code, event_timestamp, value ORDER BY source_row_number) > 1 THEN 'DUPLICATE' ELSE first_status END AS status FROM q)
"""


def mapped(spark, sf_dir):
    return apply_mapping(uploaded(spark, sf_dir), MAPPING, keep=CARRIED)


@query(
    "p1_column_mapping",
    f"""
SELECT source_row_number, parameter_name, machine_code, product_code, operation_code, unit, NULL AS shift, NULL AS operator_id
FROM ({RAW})
""",
)
def mapping(spark, sf_dir):
    return mapped(spark, sf_dir).select(
        "source_row_number", "parameter_name", "machine_code", "product_code", "operation_code", "unit", "shift", "operator_id"
    )


@query("p2_numeric_quality", f"SELECT source_row_number, value, value_status FROM ({RAW})")
def numeric(spark, sf_dir):
    value, status = parse_number(F.col("READING"))
    return raw_rows(spark, sf_dir).select("source_row_number", value.alias("value"), status.alias("value_status"))


@query("p3_timestamp_quality", f"SELECT source_row_number, event_timestamp, time_status FROM ({RAW})")
def timestamps(spark, sf_dir):
    time, status = parse_timestamp(F.col("MEASURED_AT"))
    return raw_rows(spark, sf_dir).select("source_row_number", time.alias("event_timestamp"), status.alias("time_status"))


@query(
    "p4_unit_quality",
    f"SELECT source_row_number, CASE WHEN unit = 'inch' THEN 'INVALID_UNIT' ELSE 'VALID' END AS unit_status FROM ({RAW})",
)
def units(spark, sf_dir):
    return raw_rows(spark, sf_dir).select("source_row_number", unit_status(F.col("UNIT"), F.lit("Mm")).alias("unit_status"))


@query("p5_first_failing_status", f"WITH {QUALITY} SELECT source_row_number, first_status AS quality_status FROM q")
def first_failing(spark, sf_dir):
    return validate_rows(mapped(spark, sf_dir)).select("source_row_number", "quality_status")


@query("p6_duplicate_flag", f"WITH {QUALITY} SELECT source_row_number, status AS quality_status FROM d")
def duplicates(spark, sf_dir):
    return flag_duplicates(validate_rows(mapped(spark, sf_dir))).select("source_row_number", "quality_status")


@query(
    "p9_blank_to_null",
    "SELECT event_id, CASE WHEN event_id % 3 > 1 THEN event_type END AS code FROM events",
)
def blanks(spark, sf_dir):
    kind = F.col("event_id") % 3
    code = F.when(kind == 0, "").when(kind == 1, "   ").otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")))
    return table(spark, sf_dir, "events").select("event_id", blank_to_null(code).alias("code"))


RESOLVED = f"""
r AS ({CODED}), mc AS ({MACHINES}), pr AS ({PRODUCTS}), ps AS ({PROCESSES}), op AS ({OPERATIONS}), pa AS ({PARAMETERS}),
oo AS (SELECT organization_id, code, min(operation_id) AS operation_id, arg_min(process_id, operation_id) AS process_id
       FROM op JOIN ps USING (process_id) GROUP BY 1, 2),
x AS (SELECT r.*, machine_id, product_id, oo.operation_id, oo.process_id, parameter_id, pa.unit AS pu,
             CASE WHEN l_quantity > 45 THEN 'MISSING_VALUE' ELSE 'VALID' END AS s0
      FROM r LEFT JOIN mc ON mc.plant_id = r.plant_id AND mc.code = r.machine_code
      LEFT JOIN pr ON pr.organization_id = r.organization_id AND pr.part_number = r.product_code
      LEFT JOIN oo ON oo.organization_id = r.organization_id AND oo.code = r.operation_code
      LEFT JOIN pa ON pa.name = r.parameter_name),
y AS (SELECT *, CASE WHEN s0 <> 'VALID' THEN s0
   WHEN parameter_id IS NULL OR (machine_code IS NOT NULL AND machine_id IS NULL) OR (product_code IS NOT NULL AND product_id IS NULL)
        OR (operation_code IS NOT NULL AND operation_id IS NULL) THEN 'INVALID_CONTEXT' ELSE 'VALID' END AS status FROM x)
"""
KEYS = "l_orderkey, l_linenumber"


@query("j1_machine_resolution", f"WITH {RESOLVED} SELECT {KEYS}, machine_id FROM x")
def machine(spark, sf_dir):
    df = resolve_machine(coded_rows(spark, sf_dir), dimensions(spark, sf_dir)["machines"])
    return df.select("l_orderkey", "l_linenumber", "machine_id")


@query("j2_product_resolution", f"WITH {RESOLVED} SELECT {KEYS}, product_id FROM x")
def product(spark, sf_dir):
    df = resolve_product(coded_rows(spark, sf_dir), dimensions(spark, sf_dir)["products"])
    return df.select("l_orderkey", "l_linenumber", "product_id")


@query("j3_operation_resolution", f"WITH {RESOLVED} SELECT {KEYS}, operation_id, process_id FROM x")
def operation(spark, sf_dir):
    d = dimensions(spark, sf_dir)
    df = resolve_operation(coded_rows(spark, sf_dir), d["operations"], d["processes"])
    return df.select("l_orderkey", "l_linenumber", "operation_id", "process_id")


@query("j4_parameter_resolution", f"WITH {RESOLVED} SELECT {KEYS}, parameter_id, pu AS parameter_unit FROM x")
def parameter(spark, sf_dir):
    df = resolve_parameter(coded_rows(spark, sf_dir), dimensions(spark, sf_dir)["parameters"])
    return df.select("l_orderkey", "l_linenumber", "parameter_id", "parameter_unit")


def coded_upload(spark, sf_dir):
    absent = {c: F.lit(None).cast("string") for c in
              ("production_line_id", "batch_id", "subgroup_id", "shift", "operator_id")}
    return coded_rows(spark, sf_dir).withColumns(
        {
            **absent,
            "source_row_number": F.col("l_orderkey") * 10 + F.col("l_linenumber"),
            "upload_id": F.lit("UL"), "source_file_name": F.lit("lineitem.csv"),
            "event_timestamp": F.lit(None).cast("timestamp_ntz"), "value": F.col("l_quantity"),
            "quality_status": F.when(F.col("l_quantity") > 45, "MISSING_VALUE").otherwise("VALID"),
            "validation_notes": F.when(F.col("l_quantity") > 45, "MISSING_VALUE").otherwise(""),
        }
    )


@query(
    "j5_context_resolution",
    f"""
WITH {RESOLVED}
SELECT l_orderkey * 10 + l_linenumber AS source_row_number, machine_id, product_id, process_id, operation_id, parameter_id,
       status AS quality_status FROM y
""",
)
def full_resolution(spark, sf_dir):
    return resolve_context(coded_upload(spark, sf_dir), dimensions(spark, sf_dir)).select(
        "source_row_number", "machine_id", "product_id", "process_id", "operation_id", "parameter_id", "quality_status"
    )


@query(
    "p7_context_invalidation",
    f"""
WITH {RESOLVED}
SELECT status AS quality_status, CASE WHEN status = 'MISSING_VALUE' THEN status WHEN status = 'VALID' THEN ''
  WHEN parameter_id IS NULL THEN 'Unknown parameter ''' || parameter_name || '''; no matching parameter is configured.'
  WHEN machine_code IS NOT NULL AND machine_id IS NULL THEN 'Unknown machine code ''' || machine_code || ''' for the configured plant.'
  WHEN product_code IS NOT NULL AND product_id IS NULL THEN 'Unknown product/part number ''' || product_code || '''.'
  ELSE 'Unknown operation code ''' || operation_code || '''.' END AS validation_notes, CAST(count(*) AS BIGINT) AS n
FROM y GROUP BY 1, 2
""",
)
def invalidation(spark, sf_dir):
    df = resolve_context(coded_upload(spark, sf_dir), dimensions(spark, sf_dir))
    return df.groupBy("quality_status", "validation_notes").agg(F.count("*").alias("n"))


@query(
    "p8_silver_shape",
    f"""
WITH {RESOLVED}
SELECT l_orderkey * 10 + l_linenumber AS source_row_number, 'UL' AS upload_id, organization_id, plant_id,
       l_quantity AS measurement_value, coalesce(unit, pu) AS unit, NULL AS batch_id FROM y
""",
)
def silver_shape(spark, sf_dir):
    return resolve_context(coded_upload(spark, sf_dir), dimensions(spark, sf_dir)).select(
        "source_row_number", "upload_id", "organization_id", "plant_id", "measurement_value", "unit", "batch_id"
    )


EVENT_DIMENSIONS = f"""
{QUALITY},
e AS (SELECT *, CASE WHEN status <> 'VALID' THEN status WHEN parameter_name = 'zzz' OR machine_code = 'MX' OR product_code = 'PX'
                       OR operation_code = 'OX' THEN 'INVALID_CONTEXT' ELSE 'VALID' END AS final_status FROM d)
"""


def event_dimensions(spark, sf_dir):
    """Dimensions of the codes that occur in the event stream."""
    user = F.col("user_id")
    events = table(spark, sf_dir, "events")
    return {
        "machines": events.select(F.lit("N1").alias("plant_id"), text("M", user % 3).alias("code"),
                                  text("ID-M", user % 3).alias("machine_id")).distinct(),
        "products": events.select(F.lit("R1").alias("organization_id"), F.lit("P1").alias("part_number"),
                                  F.lit("ID-P1").alias("product_id")).distinct(),
        "processes": events.select(text("PR", user % 2).alias("process_id"), F.lit("R1").alias("organization_id")).distinct(),
        "operations": events.select(text("ID-O", user % 2).alias("operation_id"), text("PR", user % 2).alias("process_id"),
                                    text("O", user % 2).alias("code")).distinct(),
        "parameters": events.select(F.col("event_type").alias("name"), text("ID-", F.col("event_type")).alias("parameter_id"),
                                    F.lit("mm").alias("unit")).distinct(),
    }


@query(
    "s5_silver_append",
    f"""
WITH {EVENT_DIMENSIONS}
SELECT CASE WHEN parameter_name IS NULL OR parameter_name = 'zzz' THEN NULL ELSE 'ID-' || parameter_name END AS parameter_id,
       upload_id, final_status AS quality_status, CAST(count(*) AS BIGINT) AS n, round(sum(value), 3) AS total FROM e GROUP BY 1, 2, 3
""",
)
def silver_append(spark, sf_dir):
    path = folder(spark, "silver")
    append_silver(clean(uploaded(spark, sf_dir), MAPPING, event_dimensions(spark, sf_dir)), path)
    return read_silver(spark, path).groupBy("parameter_id", "upload_id", "quality_status").agg(
        F.count("measurement_id").alias("n"), F.round(F.sum("measurement_value"), 3).alias("total")
    )


@query("s6_source_row_numbers", "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(0 AS BIGINT) AS off_by FROM events")
def row_numbers(spark, sf_dir):
    # Files hold consecutive ids in order, so the number in the file follows from its first id.
    df = table(spark, sf_dir, "events").select("event_id", "value")
    path = write_csv(df.repartitionByRange(4, "event_id").sortWithinPartitions("event_id"), folder(spark, "csv"))
    numbered = number_source_rows(read_csv(spark, path)).withColumn("id", F.col("event_id").cast("long"))
    first = numbered.groupBy("source_file_path").agg(F.min("id").alias("first_id"))
    return numbered.join(first, "source_file_path").select(
        "event_id", (F.col("source_row_number") - (F.col("id") - F.col("first_id") + 1)).alias("off_by")
    )


def silver(spark, sf_dir):
    """The measurement stream in silver shape, every tenth row not valid."""
    absent = ("organization_id", "plant_id", "production_line_id", "batch_id", "shift", "operator_id")
    return measurements(spark, sf_dir).withColumnRenamed("value", "measurement_value").withColumns(
        {
            **{c: F.lit(None).cast("string") for c in absent},
            "unit": F.lit("mm"),
            "quality_status": F.when(F.col("source_row_number") % 10 == 0, "DUPLICATE").otherwise("VALID"),
        }
    )


def read_sql(where):
    return f"SELECT measurement_id, event_timestamp, machine_id, product_id, value FROM ({MEASUREMENTS}) WHERE {where}"


READ = ("measurement_id", "event_timestamp", "machine_id", "product_id", "value")


@query("s7_read_by_upload", read_sql("upload_id = 'U1' AND source_row_number % 10 <> 0"))
def by_upload_read(spark, sf_dir):
    return by_upload(silver(spark, sf_dir), "U1").select(*READ)


@query("s8_read_by_context", read_sql("parameter_id = 'click' AND machine_id = 'M1'"))
def by_context_read(spark, sf_dir):
    return by_context(silver(spark, sf_dir), "click", valid_only=False, machine_id="M1").select(*READ)


@query(
    "s9_read_by_time_range",
    read_sql("parameter_id = 'view' AND source_row_number % 10 <> 0 AND event_timestamp BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'"),
)
def by_time_read(spark, sf_dir):
    at = [F.lit(t).cast("timestamp_ntz") for t in ("2024-01-10", "2024-01-20")]
    return by_time_range(silver(spark, sf_dir), "view", *at).select(*READ)


@query(
    "s10_silver_projection",
    f"""
SELECT measurement_id, upload_id, event_timestamp, NULL AS organization_id, NULL AS plant_id, NULL AS production_line_id,
       machine_id, product_id, process_id, operation_id, parameter_id, value, 'mm' AS unit, NULL AS batch_id, subgroup_id,
       NULL AS shift, NULL AS operator_id, CASE WHEN source_row_number % 10 = 0 THEN 'DUPLICATE' ELSE 'VALID' END AS quality_status
FROM ({MEASUREMENTS})
""",
)
def projection(spark, sf_dir):
    return read_measurements(silver(spark, sf_dir), valid_only=False, extra=()).select(*SILVER_READ)


@query(
    "s15_json_payload",
    """
SELECT event_id, '{"event_id":' || event_id || ',"event_type":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"' || event_type || '"' END
       || ',"value":' || CASE WHEN event_id % 7 = 0 THEN 'null' ELSE CAST(value AS VARCHAR) END || '}' AS payload FROM events
""",
)
def json_payload(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
    )
    return df.select("event_id", json_text(*nan_to_null(df, df.columns)).alias("payload"))


@query(
    "u2_measurement_append",
    f"SELECT upload_id, CAST(count(*) AS BIGINT) AS n FROM ({MEASUREMENTS}) GROUP BY upload_id",
)
def appended(spark, sf_dir):
    path = folder(spark, "store")
    for upload in ("U0", "U1", "U2", "U3"):
        append(measurements(spark, sf_dir).filter(F.col("upload_id") == upload), path)
    return spark.read.parquet(path).groupBy("upload_id").agg(F.count("*").alias("n"))


@query(
    "f1_ingest",
    f"""
WITH {EVENT_DIMENSIONS}
SELECT upload_id, CAST(count(*) AS BIGINT) AS total_rows, CAST(count(*) FILTER (final_status = 'VALID') AS BIGINT) AS valid_rows,
       CAST(count(*) FILTER (final_status <> 'VALID') AS BIGINT) AS invalid_rows, NULL AS failure, 'SILVER_COMPLETED' AS status,
       CASE WHEN upload_id = 'U3' THEN 'CURRENT' ELSE 'HISTORICAL' END AS upload_type, CAST(7 AS BIGINT) AS transitions,
       CAST(9 AS BIGINT) AS events, CAST(count(*) AS BIGINT) AS stored_rows, 0 AS line_ids FROM e GROUP BY upload_id
UNION ALL SELECT 'UX', 0, 0, 0, 'UNSUPPORTED_TYPE', 'NONE', 'NONE', 0, 0, 0, 0
""",
)
def ingest(spark, sf_dir):
    # Client files of four uploads, their rows in file order, and a file of another kind.
    landing = folder(spark, "landing")
    rows = raw_rows(spark, sf_dir).withColumn("_at", F.col("source_row_number")).drop("source_row_number")
    rows = rows.repartitionByRange("_at").sortWithinPartitions("upload_id", "_at").select("upload_id", *SOURCE)
    rows.write.option("header", True).option("escape", '"').partitionBy("upload_id").csv(landing)
    text_file = f"{landing}/other"
    table(spark, sf_dir, "region").select(F.col("r_name").alias("value")).write.text(text_file)
    uploads = [
        (f"{landing}/upload_id=U{i}", UploadContext(f"U{i}", "CURRENT" if i == 3 else "HISTORICAL", "R1", "N1", " " if i % 2 else ""))
        for i in range(4)
    ]
    uploads.append((text_file, UploadContext("UX", "CURRENT", "R1", "N1")))
    bronze_path, silver_path, ledger_path = (folder(spark, n) for n in ("bronze", "silver", "ledger"))
    loaded = process_uploads(spark, uploads, MAPPING, event_dimensions(spark, sf_dir), bronze_path, silver_path, ledger_path)
    events = read_ledger(spark, ledger_path)
    state = upload_state(events).select("upload_id", "status", "upload_type", "transitions")
    held = events.groupBy("upload_id").agg(F.count("*").alias("events"))
    stored = read_silver(spark, silver_path).groupBy("upload_id").agg(
        F.count("*").alias("stored_rows"), F.count("production_line_id").cast("int").alias("line_ids")
    )
    refusal = F.regexp_extract("failure", r"(\w+)$", 1)
    return (
        loaded.withColumn("failure", F.when(F.col("failure").isNotNull(), refusal))
        .join(state, "upload_id", "left").join(held, "upload_id", "left").join(stored, "upload_id", "left")
        .fillna(0).fillna("NONE", ["status", "upload_type"])
    )


LEDGER = """
l AS (SELECT 'U' || user_id AS upload_id, event_id AS event_seq, ts AS created_at,
        CASE event_type WHEN 'click' THEN 'UPLOADED' WHEN 'view' THEN 'BRONZE_COMPLETED' WHEN 'purchase' THEN 'SILVER_COMPLETED'
             WHEN 'error' THEN 'FAILED' END AS status,
        CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error_message,
        CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN event_id END AS total_rows FROM events)
"""


def ledger_events(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        text("U", F.col("user_id")).alias("upload_id"), F.col("event_id").alias("event_seq"), F.col("ts").alias("created_at"),
        F.when(kind == "click", "UPLOADED").when(kind == "view", "BRONZE_COMPLETED").when(kind == "purchase", "SILVER_COMPLETED")
        .when(kind == "error", "FAILED").alias("status"),
        F.when(kind == "error", text("error ", F.col("event_id"))).alias("error_message"),
        F.when((kind == "signup") & (F.col("event_id") % 2 == 0), F.col("event_id")).alias("total_rows"),
    )


@query(
    "f9_upload_ledger",
    f"""
WITH {LEDGER}
SELECT upload_id, arg_max(status, event_seq) FILTER (status IS NOT NULL) AS status,
       (list(error_message ORDER BY event_seq DESC) FILTER (status IS NOT NULL))[1] AS error_message,
       arg_max(created_at, event_seq) FILTER (status IN ('SILVER_COMPLETED', 'FAILED')) AS completed_at,
       max(created_at) AS updated_at, coalesce(arg_max(total_rows, event_seq) FILTER (total_rows IS NOT NULL), 0) AS total_rows,
       CAST(count(status) AS BIGINT) AS transitions FROM l GROUP BY upload_id
""",
)
def upload_ledger(spark, sf_dir):
    return upload_state(ledger_events(spark, sf_dir)).fillna(0, ["total_rows"])


@query(
    "t6_upload_status_history",
    f"WITH {LEDGER} SELECT upload_id, event_seq, created_at, status FROM l WHERE upload_id = 'U3' AND status IS NOT NULL",
)
def upload_history(spark, sf_dir):
    return status_history(ledger_events(spark, sf_dir), "U3").select("upload_id", "event_seq", "created_at", "status")
