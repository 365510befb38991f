"""Column names, value domains and table schemas shared by all modules."""

from pyspark.sql import types as T

CANONICAL_FIELDS = (
    "event_timestamp",
    "machine_code",
    "product_code",
    "operation_code",
    "parameter_name",
    "value",
    "unit",
    "batch_id",
    "subgroup_id",
    "shift",
    "operator_id",
)
REQUIRED_FIELDS = ("parameter_name", "value")
NA_TOKENS = ("", "NA", "N/A", "null", "NULL")

CONTEXT = ("parameter_id", "machine_id", "product_id", "operation_id")
ENGINE_CONTEXT = ("machine_id", "product_id", "process_id", "operation_id", "parameter_id")
SCOPE = ("machine_id", "product_id", "operation_id")

XBAR_R, XBAR_S, IMR, AUTO = "XBAR_R", "XBAR_S", "IMR", "AUTO"
CHART_TYPES = (XBAR_R, XBAR_S, IMR)
SUBGROUP_METHODS = ("EXISTING_ID", "FIXED_SIZE", "CONSECUTIVE", "TIME_WINDOW")

POINT_OUTSIDE = "POINT_OUTSIDE_LIMITS"
TREND_UP = "TREND_INCREASING"
TREND_DOWN = "TREND_DECREASING"
SAME_SIDE = "RUN_SAME_SIDE"

UPLOAD_STATUSES = (
    "UPLOADED",
    "BRONZE_LOADING",
    "BRONZE_COMPLETED",
    "VALIDATING",
    "VALIDATION_COMPLETED",
    "SILVER_LOADING",
    "SILVER_COMPLETED",
    "FAILED",
)

RULESET = T.ArrayType(
    T.StructType(
        [
            T.StructField("rule_name", T.StringType()),
            T.StructField("enabled", T.BooleanType()),
            T.StructField("severity", T.StringType()),
            T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
        ]
    )
)

# Projection of a silver read; measurement_value is read back as value.
SILVER_READ = (
    "measurement_id",
    "upload_id",
    "event_timestamp",
    "organization_id",
    "plant_id",
    "production_line_id",
    "machine_id",
    "product_id",
    "process_id",
    "operation_id",
    "parameter_id",
    "value",
    "unit",
    "batch_id",
    "subgroup_id",
    "shift",
    "operator_id",
    "quality_status",
)
