"""CSV scan, gate, mapping, quality, resolution and the whole load."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import quality
from gaugeline.operators.quality import flag_duplicates, parse_number, parse_timestamp, unit_status
from gaugeline.operators.resolve import resolve_operation
from gaugeline.plans import ingest
from gaugeline.plans.ingest import UploadContext, process_upload, process_uploads, read_ledger
from gaugeline.plans.ledger import check_statuses, upload_state
from gaugeline.sources.csv import (
    FileError, MappingError, apply_mapping, gate_reason, list_files, number_source_rows, read_csv,
)
from gaugeline.sources.tables import by_context, by_time_range, by_upload, read_bronze, read_silver

HEADER = "MEASURED_AT, STATION ,ARTICLE,STEP_CODE,FEATURE,READING"
MAPPING = {
    "MEASURED_AT": "event_timestamp", "STATION": "machine_code", "ARTICLE": "product_code",
    "STEP_CODE": "operation_code", "FEATURE": "parameter_name", "READING": "value",
}
GOOD = "2026-01-01T00:0{}:00+00:00,CNC_01,PART_A,OP_10,SHAFT,20.0{}"


def write(folder, name, lines):
    path = folder / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_numbers(spark):
    texts = {"12.5": (12.5, "VALID"), " 5 ": (5.0, "VALID"), "1e5": (1e5, "VALID"), "-.5": (-0.5, "VALID"), "5.": (5.0, "VALID"),
             "": (None, "MISSING_VALUE"), "  ": (None, "MISSING_VALUE"), "NaN": (None, "MISSING_VALUE"), None: (None, "MISSING_VALUE"),
             "abc": (None, "INVALID_NUMERIC_VALUE"), "inf": (None, "INVALID_NUMERIC_VALUE"), "-Infinity": (None, "INVALID_NUMERIC_VALUE"),
             "5d": (None, "INVALID_NUMERIC_VALUE"), "1e999": (None, "INVALID_NUMERIC_VALUE"), "1,5": (None, "INVALID_NUMERIC_VALUE")}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    value, status = parse_number(F.col("t"))
    assert {r.t: (r.v, r.s) for r in df.select("t", value.alias("v"), status.alias("s")).collect()} == texts


def test_timestamps(spark):
    noon = datetime(2026, 1, 2, 12, 0)
    texts = {"2026-01-02T12:00:00": noon, "2026-01-02 12:00": noon, "2026-01-02T12": noon, "2026-01-02T12:00:00Z": noon,
             "2026-01-02T12:00:00+02:00": noon, "2026-01-02T12:00:00.250000": noon.replace(microsecond=250000),
             "2026-01-02T12:00:00,250": noon.replace(microsecond=250000), " 2026-01-02 ": datetime(2026, 1, 2), "20260102": datetime(2026, 1, 2),
             "20260102T1200": noon, "2026": None, "2026-1-2": None, "2026-13-45": None, "02/01/2026": None, "": None, None: None,
             "12:00:00": None, "2026-02-30T00:00:00": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    value, status = parse_timestamp(F.col("t"))
    rows = df.select("t", value.alias("v"), status.alias("s")).collect()
    assert {r.t: r.v for r in rows} == texts
    assert all((r.s == "VALID") == (r.v is not None) for r in rows)


def test_units(spark):
    df = spark.createDataFrame([(" MM ", "mm"), ("inch", "mm"), (None, "mm"), (" ", "mm"), ("inch", None)], "u string, e string")
    assert [r[0] for r in df.select(unit_status(F.col("u"), F.col("e"))).collect()] == [
        "VALID", "INVALID_UNIT", "VALID", "VALID", "VALID"]


def test_duplicates_keep_the_first_and_compare_nulls_equal(spark):
    rows = [(i, "U", "p", None, "x", "o", datetime(2026, 1, 1), 1.0, "VALID") for i in range(600)]
    rows += [(600, "U", "p", None, "x", "o", datetime(2026, 1, 1), 2.0, "VALID"), (601, "V", "p", None, "x", "o", datetime(2026, 1, 1), 1.0, "VALID"),
             (602, "U", None, None, None, None, None, None, "MISSING_VALUE"), (603, "U", None, None, None, None, None, None, "MISSING_VALUE")]
    schema = ("source_row_number long, upload_id string, parameter_name string, machine_code string, product_code string, operation_code string, "
              "event_timestamp timestamp_ntz, value double, quality_status string")
    got = {r.source_row_number: r.quality_status for r in flag_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert got[0] == "VALID" and all(got[i] == "DUPLICATE" for i in range(1, 600))
    assert got[600] == got[601] == "VALID" and got[602] == got[603] == "MISSING_VALUE"


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_duplicates_by_broadcast_and_by_hash(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(quality, "HOT_SHARE", 0.1)
    rng = random.Random(3)
    rows = []
    for i in range(900):
        # A third of all rows are copies of one key, others repeat a few times or not at all.
        name = "hot" if i % 3 == 0 else rng.choice([f"k{rng.randrange(150)}", None])
        value = 1.0 if name == "hot" else rng.choice([0.0, -0.0, float("nan"), None, 2.0])
        rows.append((rng.choice(["a.csv", "b.csv"]), i, rng.choice(["U1", "U2"]), name, None, "P", None, None, value, rng.choice(["VALID", "VALID", "INVALID_UNIT"])))
    schema = ("source_file_name string, source_row_number long, upload_id string, parameter_name string, machine_code string, product_code string, "
              "operation_code string, event_timestamp timestamp_ntz, value double, quality_status string")
    frame = spark.createDataFrame(rows, schema).withColumn("_copies", F.lit("kept"))
    seen, want = set(), {}
    for row in sorted(rows, key=lambda r: r[:2]):
        value = "nan" if row[8] != row[8] else row[8]
        key = (*row[2:8], value)
        want[row[1]] = "DUPLICATE" if key in seen and row[9] == "VALID" else row[9]
        seen.add(key)
    got = flag_duplicates(frame)
    assert {r.source_row_number: r.quality_status for r in got.collect()} == want
    assert got.columns == frame.columns and got.filter("_copies = 'kept'").count() == 900
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert flag_duplicates(frame.filter("false")).count() == 0


def test_gate(spark, tmp_path):
    write(tmp_path, "a.csv", ["x"])
    write(tmp_path, "b.txt", ["x"])
    (tmp_path / "c.CSV").write_text("")
    got = {r.file_name: r.reason for r in list_files(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": None, "b.txt": "UNSUPPORTED_TYPE"}
    uploads = [("a.csv", 201 * 1024 * 1024, "TOO_LARGE"), ("c.CSV", 0, "EMPTY_FILE"), ("csv", 5, "UNSUPPORTED_TYPE"), (None, 5, "MISSING_NAME"),
               ("x.y.CSV", 200 * 1024 * 1024, None)]
    df = spark.createDataFrame(uploads, "name string, size long, want string").withColumn("got", gate_reason(F.col("name"), F.col("size")))
    assert all(r.got == r.want for r in df.collect())


def test_scan(spark, tmp_path):
    path = write(tmp_path, "a.csv", [' a ,b,"c d"', '1,NA,"x, ""y"""', "2,null,", '3,nan,"N/A"', "4"])
    got = [tuple(r) for r in read_csv(spark, path).select("a", "b", "c d").orderBy("a").collect()]
    assert got == [("1", None, 'x, "y"'), ("2", None, None), ("3", "nan", None), ("4", None, None)]
    with pytest.raises(FileError, match="empty"):
        read_csv(spark, str(_empty(tmp_path)))
    with pytest.raises(FileError, match="no data rows"):
        read_csv(spark, write(tmp_path, "d.csv", ["a,b"]))


def _empty(folder):
    path = folder / "empty.csv"
    path.write_bytes(b"")
    return path


def test_row_numbers_run_through_splits_of_a_file(spark, tmp_path):
    for name, n in (("a.csv", 500), ("b.csv", 30)):
        write(tmp_path, name, ["id,pad", *[f"{i},{'x' * 40}" for i in range(1, n + 1)]])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = number_source_rows(read_csv(spark, str(tmp_path)))
        assert df.rdd.getNumPartitions() > 1
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 530 and all(int(r.id) == r.source_row_number for r in rows)


def test_mapping_errors(spark):
    df = spark.createDataFrame([("1", "2")], "a string, value string")
    for mapping, text in (({"a": "nope"}, "unknown canonical"), ({"z": "value"}, "not in the file"),
                          ({"a": "value"}, "required"), ({"a": "value", "value": "value"}, "Several source")):
        with pytest.raises(MappingError, match=text):
            apply_mapping(df, mapping)
    with pytest.raises(MappingError):
        apply_mapping(df)
    ok = apply_mapping(df, {"a": "parameter_name", "value": "value"})
    assert len(ok.columns) == 11 and ok.first().shift is None


def test_operation_takes_one_match_of_an_organization(spark):
    rows = spark.createDataFrame([("R1", "OP"), ("R2", "OP"), (None, "OP")], "organization_id string, operation_code string")
    operations = spark.createDataFrame([("o2", "p1", "OP"), ("o1", "p2", "OP"), ("o3", "p3", "OP")], "operation_id string, process_id string, code string")
    processes = spark.createDataFrame([("p1", "R1"), ("p2", "R1"), ("p3", "R9")], "process_id string, organization_id string")
    got = {r.organization_id: (r.operation_id, r.process_id) for r in resolve_operation(rows, operations, processes).collect()}
    assert got == {"R1": ("o1", "p2"), "R2": (None, None), None: (None, None)}


def dimensions(spark):
    return {
        "machines": spark.createDataFrame([("N1", "CNC_01", "m1")], "plant_id string, code string, machine_id string"),
        "products": spark.createDataFrame([("R1", "PART_A", "pr1")], "organization_id string, part_number string, product_id string"),
        "processes": spark.createDataFrame([("ps1", "R1")], "process_id string, organization_id string"),
        "operations": spark.createDataFrame([("op1", "ps1", "OP_10")], "operation_id string, process_id string, code string"),
        "parameters": spark.createDataFrame([("SHAFT", "pa1", "mm")], "name string, parameter_id string, unit string"),
    }


def test_load(spark, tmp_path):
    lines = [HEADER, *[GOOD.format(i, i) for i in range(5)], GOOD.format(4, 4), GOOD.format(5, 5).replace("20.05", "abc"),
             GOOD.format(6, 6).replace("CNC_01", "CNC_99"), GOOD.format(7, 7).replace("SHAFT", "N/A"), GOOD.format(8, 8).replace("OP_10", "")]
    path = write(tmp_path, "up.csv", lines)
    stores = [str(tmp_path / n) for n in ("bronze", "silver", "ledger")]
    upload = UploadContext("U1", "HISTORICAL", "R1", "N1")
    counts = process_upload(spark, path, upload, MAPPING, dimensions(spark), *stores).first()
    assert (counts.total_rows, counts.valid_rows, counts.invalid_rows) == (10, 6, 4)
    silver = read_silver(spark, stores[1])
    by_row = {r.source_row_number: r for r in silver.collect()}
    assert by_row[6].quality_status == "DUPLICATE" and by_row[7].quality_status == "INVALID_NUMERIC_VALUE"
    assert by_row[8].quality_status == "INVALID_CONTEXT" and "CNC_99" in by_row[8].validation_notes
    assert by_row[9].quality_status == "INVALID_CONTEXT" and by_row[9].parameter_id is None
    assert by_row[10].quality_status == "VALID" and by_row[10].operation_id is None and by_row[10].unit == "mm"
    bronze = spark.read.parquet(stores[0])
    payload = bronze.filter("source_row_number = 7").select(F.expr("variant_get(raw_payload, '$.READING', 'string')").alias("v"))
    assert bronze.count() == 10 and payload.first().v == "abc"
    state = upload_state(spark.read.parquet(stores[2])).first()
    assert (state.status, state.total_rows, state.transitions) == ("SILVER_COMPLETED", 10, 7)
    assert by_upload(silver, "U1").count() == 6
    assert by_context(silver, "pa1", operation_id="op1").count() == 5
    assert by_time_range(silver, "pa1", datetime(2026, 1, 1), datetime(2026, 1, 1, 0, 1)).count() == 2
    with pytest.raises(MappingError):
        process_upload(spark, path, UploadContext("U2", "CURRENT"), {"NOPE": "value"}, dimensions(spark), *stores)
    failed = upload_state(spark.read.parquet(stores[2])).filter("upload_id = 'U2'").first()
    assert failed.status == "FAILED" and "NOPE" in failed.error_message and failed.completed_at is not None


class Killed(BaseException):
    """Ends a flow as a lost driver would: nothing is written any more."""


def stopped_before(monkeypatch, step):
    """Let the ledger die when it should write ``step``."""
    append = ingest.UploadLedger.append

    def dies(self, *events):
        if any(e.get("status") == step for e in events):
            raise Killed(step)
        append(self, *events)

    monkeypatch.setattr(ingest.UploadLedger, "append", dies)


LINES = [HEADER, *[GOOD.format(i, i) for i in range(5)], GOOD.format(4, 4), GOOD.format(5, 5).replace("20.05", "abc")]


@pytest.mark.parametrize("step", ["BRONZE_COMPLETED", "VALIDATING", "VALIDATION_COMPLETED", "SILVER_COMPLETED"])
def test_a_killed_load_goes_on_where_it_stopped(spark, tmp_path, monkeypatch, step):
    path = write(tmp_path, "up.csv", LINES)
    stores = [str(tmp_path / n) for n in ("bronze", "silver", "ledger")]
    other, upload = UploadContext("U/0", "CURRENT", "R1", "N1"), UploadContext("U1", "HISTORICAL", " R1"[1:], "N1", "  ")
    process_upload(spark, path, other, MAPPING, dimensions(spark), *stores)
    with monkeypatch.context() as patch:
        stopped_before(patch, step)
        with pytest.raises(Killed):
            process_upload(spark, path, upload, MAPPING, dimensions(spark), *stores)
    before = read_ledger(spark, stores[2]).filter("upload_id = 'U1'").orderBy("event_seq").collect()
    assert step not in [r.status for r in before] and before[0].status == "UPLOADED"
    bronze = read_bronze(spark, stores[0]).filter("upload_id = 'U1'").collect()
    if step != "BRONZE_COMPLETED":
        # The file is not needed any more.
        path = str(tmp_path / "gone.csv")
    counts = process_upload(spark, path, upload, MAPPING, dimensions(spark), *stores).first()
    assert tuple(counts) == ("U1", 7, 5, 2)
    after = read_ledger(spark, stores[2]).filter("upload_id = 'U1'").orderBy("event_seq").collect()
    assert after[: len(before)] == before and [r.event_seq for r in after] == list(range(1, len(after) + 1))
    state = upload_state(read_ledger(spark, stores[2])).filter("upload_id = 'U1'").first()
    assert (state.status, state.total_rows, state.valid_rows, state.upload_type, state.bronze_loaded) == ("SILVER_COMPLETED", 7, 5, "HISTORICAL", True)
    silver = read_silver(spark, stores[1])
    assert {r.upload_id: r["count"] for r in silver.groupBy("upload_id").count().collect()} == {"U/0": 7, "U1": 7}
    assert silver.filter("production_line_id IS NOT NULL").isEmpty()
    if step != "BRONZE_COMPLETED":
        assert sorted(map(str, read_bronze(spark, stores[0]).filter("upload_id = 'U1'").collect())) == sorted(map(str, bronze))
    # A finished upload is not loaded again.
    assert tuple(process_upload(spark, "nowhere.csv", upload, MAPPING, dimensions(spark), *stores).first()) == tuple(counts)
    assert read_ledger(spark, stores[2]).filter("upload_id = 'U1'").count() == len(after)


def test_counts_of_a_load_come_without_reading_silver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("gaugeline.sources.tables.read_silver", lambda *a: pytest.fail("silver was read"))
    path = write(tmp_path, "up.csv", LINES)
    stores = [str(tmp_path / n) for n in ("bronze", "silver", "ledger")]
    counts = process_upload(spark, path, UploadContext("U1", "HISTORICAL", "R1", "N1"), MAPPING, dimensions(spark), *stores)
    assert tuple(counts.first()) == ("U1", 7, 5, 2)


def test_a_batch_of_uploads_with_refused_and_broken_files(spark, tmp_path):
    stores = [str(tmp_path / n) for n in ("bronze", "silver", "ledger")]
    uploads = [(write(tmp_path, f"u{i}.csv", LINES[: 2 + i]), UploadContext(f"U{i}", "CURRENT", "R1", "N1")) for i in range(3)]
    uploads += [(write(tmp_path, "x.txt", LINES), UploadContext("UX", "CURRENT")), (write(tmp_path, "h.csv", [HEADER]), UploadContext("UH", "CURRENT"))]
    got = {r.upload_id: (r.total_rows, r.failure) for r in process_uploads(spark, uploads, MAPPING, dimensions(spark), *stores).collect()}
    assert {k: got[k] for k in ("U0", "U1", "U2")} == {f"U{i}": (1 + i, None) for i in range(3)}
    assert "UNSUPPORTED_TYPE" in got["UX"][1] and "no data rows" in got["UH"][1]
    states = {r.upload_id: r.status for r in upload_state(read_ledger(spark, stores[2])).collect()}
    assert states == {"U0": "SILVER_COMPLETED", "U1": "SILVER_COMPLETED", "U2": "SILVER_COMPLETED", "UH": "FAILED"}


def test_fields_without_a_bronze_column_come_from_the_stored_row(spark, tmp_path):
    mapping = {**MAPPING, "LOT no. 'x'": "batch_id"}
    path = write(tmp_path, "up.csv", [HEADER + ",LOT no. 'x',shift,operator_id", GOOD.format(1, 1) + ",L7,night,", GOOD.format(2, 2) + ",NA,,op3"])
    stores = [str(tmp_path / n) for n in ("bronze", "silver", "ledger")]
    process_upload(spark, path, UploadContext("U1", "CURRENT", "R1", "N1"), mapping, dimensions(spark), *stores)
    rows = read_silver(spark, stores[1]).orderBy("source_row_number").collect()
    assert [(r.batch_id, r["shift"], r.operator_id) for r in rows] == [("L7", "night", None), (None, None, "op3")]


def test_unknown_statuses_are_not_accepted(spark):
    df = check_statuses(spark.createDataFrame([("UPLOADED",), ("DONE",)], "status string"))
    assert [r.accepted for r in df.collect()] == [True, False]
