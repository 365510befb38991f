"""Uploads from file to silver: gate, scan, map, bronze, validate, resolve, silver, counts.

Every step of an upload leaves its event in the ledger when it happens, and a rerun goes on
after the last step that was finished: bronze is read back as the input of cleaning, and
files that a broken silver load left are taken out before it is repeated. Row counts come
from the writes themselves.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators.layout import materialize
from gaugeline.operators.quality import VALID, blank_to_null, run_validation
from gaugeline.operators.resolve import resolve_context
from gaugeline.sources.csv import FileError, apply_mapping, list_files, number_source_rows, read_csv
from gaugeline.sources.tables import (
    append_silver, bronze_rows, canonical_rows, drop_upload_files, json_text, own_folder,
    read_bronze, replace_bronze, stored,
)

UPLOAD_TYPES = ("HISTORICAL", "CURRENT")
CARRIED = ("upload_id", "source_file_name", "source_row_number", "organization_id", "plant_id", "production_line_id")
EVENTS = (
    "upload_id string, event_seq long, upload_type string, status string, error_message string, total_rows long, "
    "valid_rows long, invalid_rows long, bronze_loaded boolean, silver_loaded boolean"
)
COUNTS = "upload_id string, total_rows long, valid_rows long, invalid_rows long"
# Uploads of a batch that are loaded side by side.
SIDE_BY_SIDE = 4
# Appends to one folder by one driver take turns.
SILVER = Lock()


@dataclass(frozen=True)
class UploadContext:
    upload_id: str
    upload_type: str
    organization_id: str | None = None
    plant_id: str | None = None
    production_line_id: str | None = None


class UploadLedger:
    """Appends events of one upload; their sequence goes on from what the ledger holds."""

    def __init__(self, spark: SparkSession, path: str, upload: UploadContext):
        self.spark, self.upload = spark, upload
        self.path = own_folder(spark, path, "upload_id", upload.upload_id)
        self.reached, self.next, self.counts = set(), 1, None
        if not stored(spark, self.path):
            return
        at = F.col("event_seq")
        row = spark.read.schema(EVENTS.split(", ", 1)[1] + ", created_at timestamp").parquet(self.path).agg(
            F.collect_set("status").alias("reached"), F.max(at).alias("last"),
            *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in ("total_rows", "valid_rows", "invalid_rows")],
        ).first()
        self.reached, self.next = set(row["reached"]), (row["last"] or 0) + 1
        self.counts = (row["total_rows"], row["valid_rows"], row["invalid_rows"])

    def append(self, *events: dict) -> None:
        """One write for events that happen together."""
        schema = EVENTS.split(", ", 1)[1]
        names = [x.split()[0] for x in schema.split(", ")]
        rows = []
        for event in events:
            event = {"event_seq": self.next, "upload_type": self.upload.upload_type, **event}
            rows.append(tuple(event.get(c) for c in names))
            self.next += 1
            if event.get("status"):
                self.reached.add(event["status"])
        df = self.spark.createDataFrame(rows, schema).withColumn("created_at", F.current_timestamp())
        df.coalesce(1).write.mode("append").parquet(self.path)


def with_upload(df: DataFrame, upload: UploadContext) -> DataFrame:
    def text(value):
        return blank_to_null(F.lit(value).cast("string"))

    return df.withColumns(
        {
            "upload_id": F.lit(upload.upload_id).cast("string"),
            "organization_id": text(upload.organization_id),
            "plant_id": text(upload.plant_id),
            "production_line_id": text(upload.production_line_id),
        }
    )


def clean(raw: DataFrame, mapping: dict[str, str], dimensions: dict[str, DataFrame]) -> DataFrame:
    """Raw numbered rows of any number of uploads to silver rows."""
    mapped = apply_mapping(raw, mapping, keep=CARRIED)
    return resolve_context(run_validation(mapped), dimensions)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS + ", created_at timestamp").parquet(path)


def gate_files(spark: SparkSession, path: str) -> None:
    """Raise when a landed file is refused, before anything of its upload is stored."""
    refused = list_files(spark, path).filter(F.col("reason").isNotNull()).orderBy("path").first()
    if refused:
        raise FileError(f"{refused['file_name']}: {refused['reason']}")


def load_bronze(spark: SparkSession, path: str, upload: UploadContext, mapping: dict[str, str], bronze_path: str, multi_line: bool) -> int:
    """Write the bronze rows of an upload, in place of what an earlier attempt left, and count them."""
    scanned = read_csv(spark, path, multi_line)
    source_columns = [c for c in scanned.columns if c not in ("source_file_path", "source_file_name", "_block")]
    numbered = number_source_rows(scanned)
    apply_mapping(numbered, mapping)
    # The stored original row keeps client columns that are named like upload fields.
    original = numbered.withColumn("_original", json_text(*[F.col(f"`{c}`") for c in source_columns]))
    written = Observation()
    rows = bronze_rows(with_upload(original, upload), source_columns, mapping)
    replace_bronze(rows.observe(written, F.count(F.lit(1)).alias("n")), bronze_path, upload.upload_id)
    return written.get["n"]


def process_upload(
    spark: SparkSession,
    path,
    upload: UploadContext,
    mapping: dict[str, str],
    dimensions: dict[str, DataFrame],
    bronze_path: str,
    silver_path: str,
    ledger_path: str,
    multi_line: bool = False,
) -> DataFrame:
    """Load one upload, or a folder of files of one layout, and return its row counts.

    A refused file raises before the upload has an event. A later failure leaves a FAILED
    event with the message and is raised again. A rerun of an upload goes on where it stopped:
    after bronze the files are not read again, after silver the stored counts are returned.
    Blank ids of the upload count as absent.
    """
    if upload.upload_type not in UPLOAD_TYPES:
        raise ValueError(f"Invalid upload_type: {upload.upload_type}")
    ledger = UploadLedger(spark, ledger_path, upload)
    if "SILVER_COMPLETED" in ledger.reached:
        return spark.createDataFrame([(upload.upload_id, *ledger.counts)], COUNTS)
    if "BRONZE_COMPLETED" not in ledger.reached:
        gate_files(spark, path)
    try:
        if "BRONZE_COMPLETED" not in ledger.reached:
            ledger.append(*([] if "UPLOADED" in ledger.reached else [{"status": "UPLOADED"}]), {"status": "BRONZE_LOADING"})
            total = load_bronze(spark, path, upload, mapping, bronze_path, multi_line)
            ledger.append({"status": "BRONZE_COMPLETED"}, {"total_rows": total, "bronze_loaded": True})
        broken = "SILVER_LOADING" in ledger.reached
        ledger.append({"status": "VALIDATING"})
        bronze = read_bronze(spark, bronze_path).filter(F.col("upload_id") == upload.upload_id)
        judged = Observation()
        rows = resolve_context(run_validation(canonical_rows(with_upload(bronze, upload), mapping, CARRIED)), dimensions)
        valid = F.count_if(F.col("quality_status") == VALID)
        cleaned = materialize(rows.observe(judged, valid.alias("valid"), F.count(F.lit(1)).alias("total")), "cleaned")
        total, fine = judged.get["total"], judged.get["valid"]
        ledger.append({"status": "VALIDATION_COMPLETED"}, {"status": "SILVER_LOADING"})
        if broken:
            drop_upload_files(spark, silver_path, upload.upload_id)
        with SILVER:
            append_silver(cleaned, silver_path)
        ledger.append(
            {"status": "SILVER_COMPLETED"},
            {"total_rows": total, "valid_rows": fine, "invalid_rows": total - fine, "silver_loaded": True},
        )
    except Exception as error:
        ledger.append({"status": "FAILED", "error_message": str(error)})
        raise
    return spark.createDataFrame([(upload.upload_id, total, fine, total - fine)], COUNTS)


def process_uploads(
    spark: SparkSession,
    uploads: list[tuple[str, UploadContext]],
    mapping: dict[str, str],
    dimensions: dict[str, DataFrame],
    bronze_path: str,
    silver_path: str,
    ledger_path: str,
) -> DataFrame:
    """Load several uploads side by side: their row counts, or why one was refused or failed."""

    def load(item):
        path, upload = item
        try:
            row = process_upload(spark, path, upload, mapping, dimensions, bronze_path, silver_path, ledger_path).first()
            return (*row, None)
        except Exception as error:
            return (upload.upload_id, None, None, None, str(error))

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return spark.createDataFrame(list(pool.map(load, uploads)), COUNTS + ", failure string")
