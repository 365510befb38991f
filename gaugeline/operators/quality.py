"""Row-level data quality of mapped raw measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.layout import BROADCAST_ROWS, materialize, small

VALID = "VALID"

# Number text accepted besides inf and nan: no type suffix, no underscores.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Extended and basic ISO 8601 dates with an optional time and offset.
ISO_EXTENDED = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
HOUR_ONLY = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2})(Z|[+-]\d{2}(:?\d{2})?)?$"
ISO_BASIC = r"^\d{8}(T\d{2}(\d{2}(\d{2})?)?)?$"


def blank_to_null(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def _stripped(column: Column) -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def parse_number(raw: Column) -> tuple[Column, Column]:
    """Finite value or NULL, and the quality status of the text."""
    text = _stripped(raw)
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    is_nan = F.lower(text).rlike(r"^[+-]?nan$")
    status = (
        F.when(raw.isNull() | (text == "") | is_nan, "MISSING_VALUE")
        .when(number.isNull() | (F.abs(number) == float("inf")), "INVALID_NUMERIC_VALUE")
        .otherwise(VALID)
    )
    return F.when(status == VALID, number), status


def parse_timestamp(raw: Column) -> tuple[Column, Column]:
    """Timestamp without zone from ISO 8601 text, and its status.

    An offset is dropped after the wall-clock time is read, as stored times have no zone.
    """
    text = _stripped(raw)
    # The cast ignores an offset; it wants minutes and a point before fractions.
    shaped = F.translate(F.regexp_replace(text, HOUR_ONLY, "$1:00"), ",", ".")
    extended = F.when(text.rlike(ISO_EXTENDED), shaped.try_cast("timestamp_ntz"))
    digits = F.rpad(F.regexp_replace(text, "T", ""), 14, "0")
    basic = F.when(
        text.rlike(ISO_BASIC),
        F.concat(
            F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 2), F.lit("-"), F.substring(digits, 7, 2),
            F.lit(" "), F.substring(digits, 9, 2), F.lit(":"), F.substring(digits, 11, 2), F.lit(":"),
            F.substring(digits, 13, 2),
        ).try_cast("timestamp_ntz"),
    )
    parsed = F.coalesce(extended, basic)
    return parsed, F.when(parsed.isNull(), "INVALID_TIMESTAMP").otherwise(VALID)


def unit_status(unit: Column, expected: Column) -> Column:
    """A missing unit passes; a present one must match, ignoring case and blanks."""
    clash = (F.trim(unit) != "") & (F.lower(F.trim(unit)) != F.lower(F.trim(expected)))
    return F.when(clash, "INVALID_UNIT").otherwise(VALID)


def validate_rows(mapped: DataFrame, expected_unit: Column | None = None) -> DataFrame:
    """Parse value and time; status is the first check that fails, in fixed order."""
    value, value_status = parse_number(F.col("value"))
    time, time_status = parse_timestamp(F.col("event_timestamp"))
    unit = unit_status(F.col("unit"), expected_unit if expected_unit is not None else F.lit(None).cast("string"))
    named = F.when(F.coalesce("parameter_name", F.lit("")) == "", "INVALID_CONTEXT").otherwise(VALID)
    failing = [F.when(s != VALID, s) for s in (value_status, time_status, unit, named)]
    return mapped.withColumns(
        {"value": value, "event_timestamp": time, "quality_status": F.coalesce(*failing, F.lit(VALID))}
    )


DUPLICATE_KEYS = ("parameter_name", "machine_code", "product_code", "operation_code", "event_timestamp", "value")


# A repeated key with more than this share of the repeated rows is hot; there are fewer such keys than its inverse.
HOT_SHARE = 1e-4


def flag_duplicates(rows: DataFrame, scope=("upload_id",), order=("source_file_name", "source_row_number")) -> DataFrame:
    """Mark a valid row that repeats an earlier row of its upload in all key columns.

    Earlier means an earlier file of the upload, or an earlier row of the same file; rows of
    one file have different numbers. Only hashes of keys are counted over all rows, then the
    first row of each repeated key is looked up; the parsed rows are written once for that.
    Few repeated keys are broadcast, and no row is moved. Else rows meet their key by hash,
    apart from those of hot keys, which are few, so their first rows are broadcast and the
    rows themselves are dealt at random.
    """
    keys = [*[c for c in scope if c in rows.columns], *DUPLICATE_KEYS]
    order = [c for c in order if c in rows.columns]
    # Parsing costs more than reading back, and the rows are read three times, mostly in few columns.
    rows = materialize(rows.withColumn("_key", F.xxhash64(*keys)), "parsed")
    narrow = rows.select("_key", *dict.fromkeys([*keys, *order]))
    repeated = materialize(narrow.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1"), "repeated")
    hashes, copies = repeated.agg(F.count("*"), F.sum("_n")).first()
    if not hashes:
        return rows.drop("_key")
    few = hashes <= BROADCAST_ROWS
    if few:
        narrow = narrow.join(F.broadcast(repeated), "_key", "left_semi")
    firsts = narrow.groupBy("_key", *keys).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("_copies"))
    firsts = materialize(firsts.filter("_copies > 1").withColumn("_hot", F.col("_copies") > HOT_SHARE * copies), "firsts")

    def looked_up(left: DataFrame, right: DataFrame, spot: str, out: str) -> DataFrame:
        found = right.select(F.col("_key").alias("_spot"), *[F.col(c).alias(f"_k_{c}") for c in keys], F.col("_first").alias(out))
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
        return left.join(found, [F.col(spot) == F.col("_spot"), *same], "left").drop("_spot", *[f"_k_{c}" for c in keys])

    if few:
        rows = looked_up(rows, small(firsts), "_key", "_first")
    else:
        rows = looked_up(rows, F.broadcast(firsts.filter("_hot")), "_key", "_hot_first")
        rows = rows.withColumn("_at", F.when(F.col("_hot_first").isNull(), F.col("_key")).otherwise(F.xxhash64(*order)))
        rows = looked_up(rows, firsts.filter("NOT _hot"), "_at", "_first")
        rows = rows.withColumn("_first", F.coalesce("_hot_first", "_first")).drop("_at", "_hot_first")
    later = F.coalesce(F.struct(*order) > F.col("_first"), F.lit(False))
    status = F.when(later & (F.col("quality_status") == VALID), "DUPLICATE").otherwise(F.col("quality_status"))
    return rows.withColumn("quality_status", status).drop("_key", "_first")


def with_notes(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "validation_notes", F.when(F.col("quality_status") == VALID, "").otherwise(F.col("quality_status"))
    )


def run_validation(mapped: DataFrame, expected_unit: Column | None = None, **keys) -> DataFrame:
    """Validation, duplicate flags and notes for a batch of uploads."""
    return with_notes(flag_duplicates(validate_rows(mapped, expected_unit), **keys))
