"""Codes of raw rows to the ids of the manufacturing hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.operators.layout import small
from gaugeline.operators.quality import VALID


def _lookup(rows: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(small(dimension), keys, "left")


def one_per_key(dimension: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return dimension.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def resolve_machine(rows: DataFrame, machines: DataFrame) -> DataFrame:
    """By plant and machine code."""
    side = machines.select("plant_id", F.col("code").alias("machine_code"), "machine_id")
    return _lookup(rows, side, ["plant_id", "machine_code"])


def resolve_product(rows: DataFrame, products: DataFrame) -> DataFrame:
    """By organization and part number."""
    side = products.select("organization_id", F.col("part_number").alias("product_code"), "product_id")
    return _lookup(rows, side, ["organization_id", "product_code"])


def resolve_operation(rows: DataFrame, operations: DataFrame, processes: DataFrame) -> DataFrame:
    """By organization and operation code over all its processes; also gives the process."""
    side = operations.join(processes.select("process_id", "organization_id"), "process_id").select(
        "organization_id", F.col("code").alias("operation_code"), "operation_id", "process_id"
    )
    side = one_per_key(side, ["organization_id", "operation_code"], "operation_id")
    return _lookup(rows, side, ["organization_id", "operation_code"])


def resolve_parameter(rows: DataFrame, parameters: DataFrame) -> DataFrame:
    """By name; also gives the unit of the parameter."""
    side = parameters.select(F.col("name").alias("parameter_name"), "parameter_id", F.col("unit").alias("parameter_unit"))
    return _lookup(rows, side, ["parameter_name"])


def classify_context(rows: DataFrame) -> DataFrame:
    """Downgrade valid rows whose codes are unknown; the first unknown code is named."""

    def given(code):
        return F.coalesce(F.col(code), F.lit("")) != ""

    note = (
        F.when(
            F.col("parameter_id").isNull(),
            F.concat(
                F.lit("Unknown parameter '"), F.coalesce("parameter_name", F.lit("None")),
                F.lit("'; no matching parameter is configured."),
            ),
        )
        .when(
            given("machine_code") & F.col("machine_id").isNull(),
            F.concat(F.lit("Unknown machine code '"), F.col("machine_code"), F.lit("' for the configured plant.")),
        )
        .when(
            given("product_code") & F.col("product_id").isNull(),
            F.concat(F.lit("Unknown product/part number '"), F.col("product_code"), F.lit("'.")),
        )
        .when(
            given("operation_code") & F.col("operation_id").isNull(),
            F.concat(F.lit("Unknown operation code '"), F.col("operation_code"), F.lit("'.")),
        )
    )
    note = F.when(F.col("quality_status") == VALID, note)
    return rows.withColumns(
        {
            "validation_notes": F.coalesce(note, F.col("validation_notes")),
            "quality_status": F.when(note.isNotNull(), "INVALID_CONTEXT").otherwise(F.col("quality_status")),
        }
    )


def silver_rows(rows: DataFrame) -> DataFrame:
    """Shape of the silver table; a missing unit falls back to that of the parameter."""
    return rows.select(
        "upload_id", "source_file_name", "source_row_number", "event_timestamp",
        "organization_id", "plant_id", "production_line_id", "machine_id", "product_id", "process_id",
        "operation_id", "parameter_id", F.col("value").alias("measurement_value"),
        F.coalesce(F.nullif(F.col("unit"), F.lit("")), F.col("parameter_unit")).alias("unit"),
        "batch_id", "subgroup_id", "shift", "operator_id", "quality_status", "validation_notes",
    )


def resolve_context(rows: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """All four lookups, classification and silver shape in one plan.

    ``rows`` carry ``organization_id`` and ``plant_id`` of their upload. A NULL
    there never matches, so a code without its plant or organization is unknown.
    """
    rows = resolve_machine(rows, dimensions["machines"])
    rows = resolve_product(rows, dimensions["products"])
    rows = resolve_operation(rows, dimensions["operations"], dimensions["processes"])
    rows = resolve_parameter(rows, dimensions["parameters"])
    return silver_rows(classify_context(rows))
