"""Raw measurement files: landing gate, all-string scan, row numbers, column mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from gaugeline.operators.layout import small
from gaugeline.schema import CANONICAL_FIELDS, NA_TOKENS, REQUIRED_FIELDS

ALLOWED_EXTENSIONS = (".csv",)
MAX_FILE_MB = 200
# Holds the text of a row whose cells do not match the header.
BROKEN_ROW = "_broken_row"


class FileError(ValueError):
    """The file itself cannot be used."""


class MappingError(ValueError):
    """A column mapping does not fit the file."""


def gate_reason(
    name: Column, size: Column, extensions=ALLOWED_EXTENSIONS, max_mb: int = MAX_FILE_MB
) -> Column:
    """Why a landed file is refused, NULL when it is accepted."""
    extension = F.when(
        F.instr(name, ".") > 0, F.concat(F.lit("."), F.lower(F.element_at(F.split(name, r"\."), -1)))
    ).otherwise("")
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "MISSING_NAME")
        .when(~extension.isin(*extensions), "UNSUPPORTED_TYPE")
        .when(size <= 0, "EMPTY_FILE")
        .when(size > max_mb * 1024 * 1024, "TOO_LARGE")
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Name, path and size of landed files, without reading their content.

    Spark's file index leaves out files of 0 bytes; the gate meets those when names
    and sizes come from an upload table.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", F.col("length").alias("file_size"))
        .withColumn("reason", gate_reason(F.col("file_name"), F.col("file_size")))
    )


def na_to_null(column: Column) -> Column:
    return F.when(~column.isin(*NA_TOKENS), column)


def read_csv(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    """Every cell as text, header trimmed, the five NA tokens as NULL.

    The file name and block start come along for row numbers. ``multi_line`` is
    for files with quoted line breaks and makes each file one task. A row with too
    few cells is filled with NULL; one with too many refuses its file, and so does a
    header that differs from that of the other files.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    columns = reader.option("inferSchema", False).csv(path).columns
    if not columns:
        raise FileError("The uploaded CSV file is empty.")
    texts = StructType([StructField(c, StringType()) for c in [*columns, BROKEN_ROW]])
    df = reader.option("enforceSchema", False).option("columnNameOfCorruptRecord", BROKEN_ROW).schema(texts).csv(path)
    refuse_surplus(df, columns)
    df = df.select(
        *[na_to_null(F.col(f"`{c}`")).alias(c.strip()) for c in columns],
        F.col("_metadata.file_path").alias("source_file_path"),
        F.col("_metadata.file_name").alias("source_file_name"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    if df.isEmpty():
        raise FileError("The uploaded CSV file contains a header but no data rows.")
    return df


def refuse_surplus(df: DataFrame, columns: list[str]) -> None:
    """Raise when a row has more cells than the header; only broken rows are parsed again."""
    wide = ", ".join(f"c{i} string" for i in range(len(columns) + 1))
    again = F.from_csv(F.col(BROKEN_ROW), F.lit(wide), {"escape": '"'})[f"c{len(columns)}"]
    # All columns are asked for: a scan of the broken rows alone would not parse the others.
    every = F.concat_ws("", *[F.col(f"`{c}`") for c in columns])
    try:
        found = df.filter(F.col(BROKEN_ROW).isNotNull() & again.isNotNull() & (F.length(every) >= 0))
        wrong = found.select(F.col("_metadata.file_name").alias("name"), BROKEN_ROW, every.alias("_all")).first()
    except Exception as error:
        if "header" in str(error).lower():
            raise FileError("The files of the upload have different headers.") from error
        raise
    if wrong:
        raise FileError(f"A row of {wrong['name']} has more cells than its header.")


def number_source_rows(df: DataFrame) -> DataFrame:
    """Number rows 1..n per file in file order.

    A split of a file is read by one task in order. Splits are counted first, and
    each row is numbered inside its split, so a large file is never one group.
    """
    df = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_row", 33))
    key = ["source_file_path", "_block", "_task"]
    splits = df.groupBy(*key).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("source_file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        df.join(small(splits), key)
        .withColumn("source_row_number", F.col("_row") - F.col("_first") + F.col("_before") + 1)
        .drop("_row", "_task", "_block", "_first", "_before")
    )


def apply_mapping(df: DataFrame, mapping: dict[str, str] | None = None, keep=()) -> DataFrame:
    """Rename source columns to the canonical fields, in fixed order, absent ones NULL."""
    mapping = mapping or {f: f for f in CANONICAL_FIELDS}
    unknown = sorted(set(mapping.values()) - set(CANONICAL_FIELDS))
    if unknown:
        raise MappingError(f"Column mapping targets unknown canonical field(s): {unknown}")
    missing = [source for source in mapping if source not in df.columns]
    if missing:
        raise MappingError(f"Column mapping references source column(s) not in the file: {missing}")
    targets = list(mapping.values())
    repeated = sorted({t for t in targets if targets.count(t) > 1})
    if repeated:
        raise MappingError(f"Several source columns map to: {repeated}")
    source_of = {target: source for source, target in mapping.items()}
    # An unmapped source column that already has a canonical name is kept.
    for field in CANONICAL_FIELDS:
        if field not in source_of and field in df.columns and field not in mapping:
            source_of[field] = field
    absent = [f for f in REQUIRED_FIELDS if f not in source_of]
    if absent:
        raise MappingError(f"Column mapping does not produce required field(s): {absent}")
    return df.select(
        *keep,
        *[
            (F.col(f"`{source_of[f]}`") if f in source_of else F.lit(None).cast("string")).alias(f)
            for f in CANONICAL_FIELDS
        ],
    )
