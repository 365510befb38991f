"""Bronze and silver tables, result tables, and reads of stored measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gaugeline.schema import CANONICAL_FIELDS, SCOPE, SILVER_READ

BRONZE_NAMES = {
    "event_timestamp": "raw_timestamp",
    "machine_code": "raw_machine_id",
    "product_code": "raw_product_id",
    "operation_code": "raw_operation",
    "parameter_name": "raw_parameter",
    "value": "raw_value",
    "unit": "raw_unit",
}


def json_text(*columns) -> Column:
    """JSON object with explicit nulls; NaN becomes null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def nan_to_null(df: DataFrame, columns) -> list[Column]:
    kinds = dict(df.dtypes)
    return [F.nanvl(c, F.lit(None).cast("double")).alias(c) if kinds[c] == "double" else F.col(c) for c in columns]


def bronze_rows(raw: DataFrame, source_columns, mapping: dict[str, str]) -> DataFrame:
    """Seven semantic columns plus the whole original row as a variant payload."""
    source_of = {target: source for source, target in mapping.items()}
    semantic = [
        (F.col(f"`{source_of[c]}`") if c in source_of else F.lit(None).cast("string")).alias(name)
        for c, name in BRONZE_NAMES.items()
    ]
    # Columns that an upload replaced are only in the row kept before that.
    payload = F.col("_original") if "_original" in raw.columns else json_text(*[F.col(f"`{c}`") for c in source_columns])
    return raw.select(
        F.expr("uuid()").alias("raw_record_id"),
        "upload_id",
        "source_file_name",
        "source_row_number",
        *semantic,
        F.parse_json(payload).alias("raw_payload"),
        F.current_timestamp().alias("ingestion_timestamp"),
        F.lit("INGESTED").alias("record_status"),
    )


def append(df: DataFrame, path: str, partition_by=()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_bronze(df: DataFrame, path: str) -> None:
    append(df, path, ["upload_id"])


def stored(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def own_folder(spark: SparkSession, path: str, column: str, value: str) -> str:
    """Folder of one partition value. Writers of different values may work at the same time,
    which a shared output folder does not allow."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return f"{path.rstrip('/')}/{column}={escape(value)}"


def replace_bronze(df: DataFrame, path: str, upload_id: str) -> None:
    """Write the rows of one upload in place of what is stored of it; other uploads stay."""
    df.drop("upload_id").write.mode("overwrite").parquet(own_folder(df.sparkSession, path, "upload_id", upload_id))


def canonical_rows(bronze: DataFrame, mapping: dict[str, str], keep=()) -> DataFrame:
    """Stored bronze rows in canonical fields, as ``apply_mapping`` gives them for the file.

    Fields without a bronze column are read from the stored original row.
    """
    source_of = {target: source for source, target in mapping.items()}
    original = bronze.withColumn("_row", F.expr("variant_get(raw_payload, '$', 'map<string,string>')"))

    def field(name):
        if name in source_of and name in BRONZE_NAMES:
            return F.col(BRONZE_NAMES[name])
        source = source_of.get(name, None if name in mapping else name)
        return F.lit(None).cast("string") if source is None else F.col("_row")[source]

    return original.select(*keep, *[field(c).alias(c) for c in CANONICAL_FIELDS])


def drop_upload_files(spark: SparkSession, path: str, upload_id: str) -> None:
    """Delete the files that a broken append of one upload left in a table.

    An append writes files of its own; a file that holds rows of others refuses.
    """
    if not stored(spark, path):
        return
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = read_silver(spark, path).select("upload_id", F.col("_metadata.file_path").alias("file"))
    own = rows.filter(F.col("upload_id") == upload_id).select("file").distinct()
    shared = rows.filter(~F.col("upload_id").eqNullSafe(F.lit(upload_id))).join(own, "file", "left_semi").first()
    if shared:
        raise ValueError(f"{shared['file']} holds rows of several uploads")
    for row in own.collect():
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(row["file"]), False)


def append_silver(df: DataFrame, path: str) -> None:
    """Rows of one context lie together and in time order inside each file.

    The rebalance gathers each parameter in few files of even size and splits a hot one.
    """
    out = df.withColumns({"measurement_id": F.expr("uuid()"), "ingestion_timestamp": F.current_timestamp()})
    append(
        out.hint("rebalance", "parameter_id")
        .sortWithinPartitions("parameter_id", "machine_id", "product_id", "operation_id", "event_timestamp"),
        path,
        ["parameter_id"],
    )


def read_partitioned(spark: SparkSession, path: str, column: str) -> DataFrame:
    """A table whose partition column is text, also where its values look like numbers."""
    schema = spark.read.parquet(path).schema
    schema[column].dataType = StringType()
    return spark.read.schema(schema).parquet(path)


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    return read_partitioned(spark, path, "upload_id")


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    return read_partitioned(spark, path, "parameter_id")


def measurements(silver: DataFrame, valid_only: bool = True, extra=("source_row_number",)) -> DataFrame:
    """Projection every read shares; the stored value is called ``value``."""
    if valid_only:
        silver = silver.filter(F.col("quality_status") == "VALID")
    named = silver.withColumnRenamed("measurement_value", "value")
    return named.select(*SILVER_READ, *[c for c in extra if c not in SILVER_READ])


def by_upload(silver: DataFrame, upload_id: str, valid_only: bool = True) -> DataFrame:
    rows = measurements(silver.filter(F.col("upload_id") == upload_id), valid_only)
    return rows.orderBy(F.col("event_timestamp").asc_nulls_last(), "source_row_number")


def by_context(silver: DataFrame, parameter_id: str, valid_only: bool = True, **scope) -> DataFrame:
    """An absent machine, product or operation does not filter."""
    rows = silver.filter(F.col("parameter_id") == parameter_id)
    for column in SCOPE:
        if scope.get(column):
            rows = rows.filter(F.col(column) == scope[column])
    return measurements(rows, valid_only).orderBy(F.col("event_timestamp").asc_nulls_last(), "source_row_number")


def by_time_range(silver: DataFrame, parameter_id: str, start, end, valid_only: bool = True) -> DataFrame:
    rows = silver.filter((F.col("parameter_id") == parameter_id) & F.col("event_timestamp").between(start, end))
    return measurements(rows, valid_only).orderBy("event_timestamp")
