"""Rational subgroups: sequence order, the four forming methods, subgroup statistics.

Input rows carry ``ctx``, ``seq``, ``value``, ``event_timestamp``, ``subgroup_id``
and the settings ``subgroup_method``, ``subgroup_size``, ``maximum_time_gap_seconds``.
A subgroup is identified by the sequence number of its first member.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gaugeline.functions.time import longer_than
from gaugeline.operators.layout import (
    Layout,
    dense_index,
    last_marks,
    materialize,
    number_rows,
    with_previous,
    without_chunks,
)
from gaugeline.schema import SUBGROUP_METHODS

# The functions of the time window travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_order(row_columns: list[str]) -> list[Column]:
    """Order of stored measurements: time with missing times last, then row columns."""
    return [F.col("event_timestamp").asc_nulls_last(), *[F.col(c) for c in row_columns]]


def sequence_rows(rows: DataFrame, layout: Layout, row_columns: list[str], stored_order: bool = True) -> DataFrame:
    """Number valid rows per context.

    Stored measurements are read by time with missing times last, and engine rows
    are numbered in that order. A frame handed over directly keeps its own row
    order unless every row of the context has a time.
    """
    if stored_order:
        return number_rows(rows, layout, read_order(row_columns))
    timed = rows.groupBy("ctx").agg((F.count("*") == F.count("event_timestamp")).alias("_timed"))
    if layout.contexts and layout.contexts <= 50_000:
        timed = F.broadcast(timed)
    rows = rows.join(timed, "ctx").withColumn("_at", F.when(F.col("_timed"), F.col("event_timestamp")))
    order = [F.col("_at").asc_nulls_last(), *[F.col(c) for c in row_columns]]
    return number_rows(rows, layout, order).drop("_timed", "_at")


def _one_by_one() -> Column:
    return F.col("subgroup_size") == 1


def _method(name: str) -> Column:
    return (F.col("subgroup_method") == name) & (F.col("subgroup_size") > 1)


def chunk_starts(rows: DataFrame, layout: Layout, consecutive: bool = True) -> DataFrame:
    """First sequence number of the subgroup for single, fixed-size and consecutive rows."""
    size = F.col("subgroup_size").cast("long")
    fixed = F.expr("seq - pmod(seq - 1, subgroup_size)")
    if not consecutive:
        return rows.withColumn("first_seq", F.when(_one_by_one(), F.col("seq")).otherwise(fixed))
    rows = with_previous(without_chunks(rows), layout, "seq", {"_prev": "event_timestamp"})
    cut = longer_than(F.col("_prev"), F.col("event_timestamp"), F.col("maximum_time_gap_seconds"))
    rows = last_marks(rows, layout, "seq", {"_island": (F.col("seq") == 1) | cut})
    in_island = F.col("seq") - (F.col("seq") - F.col("_island")) % F.greatest(size, F.lit(1))
    return rows.withColumn(
        "first_seq",
        F.when(_one_by_one(), F.col("seq")).when(_method("CONSECUTIVE"), in_island).otherwise(fixed),
    ).drop("_prev", "_island")


def _next_start(ts: np.ndarray, size: int, window_us: int) -> np.ndarray:
    """Index of the row that opens the next window, if a window opens at each row."""
    n = len(ts)
    at = np.arange(n) + size
    if n < 2 or np.all(ts[1:] >= ts[:-1]):
        return np.minimum(at, np.searchsorted(ts, ts + window_us, side="right"))
    for step in range(size - 1, 0, -1):
        i = np.arange(max(n - step, 0))
        late = ts[i + step] - ts[i] > window_us
        at[i[late]] = i[late] + step
    return at


def _last_start(at: np.ndarray, stop: int) -> np.ndarray:
    """Last window opened before ``stop`` when the first one opens at each row."""
    jump = np.where(at[:stop] < stop, at[:stop], np.arange(stop))
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further


def _walk(at: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Rows where windows open when the first one opens at ``start``."""
    opened = []
    while start < stop:
        opened.append(start)
        start = int(at[start])
    return np.asarray(opened, dtype=np.int64)


def _micros(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.timestamp("us", tz=column.type.tz)).cast(pa.int64()).to_numpy()


def window_starts(rows: DataFrame, layout: Layout) -> DataFrame:
    """First sequence number of the greedy time window each row falls in.

    Where a window opens depends on where the one before it opened, so a long
    context is not cut at random. A window spans at most ``subgroup_size`` rows,
    hence the first window of a chunk opens at one of its first ``subgroup_size``
    rows: each chunk reports where it would hand over for every such entry, the
    reports are chained per context, and each chunk then marks its own windows.
    """
    rows = without_chunks(dense_index(rows.filter(F.col("event_timestamp").isNotNull()), layout, "seq", "_pos"))
    out_schema = T.StructType(rows.schema.fields + [T.StructField("first_seq", T.LongType())])

    def mark(table: pa.Table, entry: int, head: int) -> pa.Table:
        table = table.sort_by("_pos")
        size = int(table["subgroup_size"][0].as_py())
        gap = int(table["maximum_time_gap_seconds"][0].as_py()) * 1_000_000
        seq = table["seq"].to_numpy()
        opened = _walk(_next_start(_micros(table["event_timestamp"]), size, gap), entry, len(seq))
        group = np.searchsorted(opened, np.arange(len(seq)), side="right") - 1
        # Rows before the entry belong to the window the previous chunk left open.
        first = np.where(group >= 0, seq[opened[np.maximum(group, 0)]] if len(opened) else head, head)
        return table.append_column("first_seq", pa.array(first, pa.int64()))

    if not layout.chunked:
        return rows.groupBy("ctx").applyInArrow(lambda t: mark(t, 0, 0), out_schema).drop("_pos")

    size_of = layout.chunk_rows
    own = layout.chunk("_pos")
    offset = F.expr(f"pmod(_pos - 1, {size_of})")
    halo = F.when((offset < F.col("subgroup_size")) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    spread = rows.withColumn("_chunk", F.explode(halo)).select(
        "ctx", "_chunk", "_pos", "seq", "event_timestamp", "subgroup_size", "maximum_time_gap_seconds"
    )
    ctx_type = rows.schema["ctx"].dataType
    report_schema = T.StructType(
        [
            T.StructField("ctx", ctx_type),
            T.StructField("_chunk", T.LongType()),
            T.StructField("_exit", T.ArrayType(T.LongType())),
            T.StructField("_last", T.ArrayType(T.LongType())),
        ]
    )

    def report(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        chunk = int(table["_chunk"][0].as_py())
        size = int(table["subgroup_size"][0].as_py())
        gap = int(table["maximum_time_gap_seconds"][0].as_py()) * 1_000_000
        pos = table["_pos"].to_numpy()
        seq = table["seq"].to_numpy()
        rows_here = int(np.count_nonzero((pos - 1) // size_of == chunk))
        at = _next_start(_micros(table["event_timestamp"]), size, gap)
        last = _last_start(at, rows_here)
        inside = min(size, rows_here)
        exits = [int(at[last[entry]]) - rows_here for entry in range(inside)]
        exits += [entry - rows_here for entry in range(inside, size)]
        lasts = [int(seq[last[entry]]) for entry in range(inside)] + [None] * (size - inside)
        return pa.table(
            {
                "ctx": table["ctx"].slice(0, 1).combine_chunks(),
                "_chunk": pa.array([chunk], pa.int64()),
                "_exit": pa.array([exits], pa.list_(pa.int64())),
                "_last": pa.array([lasts], pa.list_(pa.int64())),
            }
        )

    reports = spread.groupBy("ctx", "_chunk").applyInArrow(report, report_schema)
    entry_schema = T.StructType(
        [
            T.StructField("ctx", ctx_type),
            T.StructField("_chunk", T.LongType()),
            T.StructField("_entry", T.LongType()),
            T.StructField("_open", T.LongType()),
        ]
    )

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("_chunk")
        entry, head, entries, heads = 0, None, [], []
        for exits, lasts in zip(table["_exit"].to_pylist(), table["_last"].to_pylist()):
            entries.append(entry)
            heads.append(head)
            head = lasts[entry] if lasts[entry] is not None else head
            entry = exits[entry]
        return pa.table(
            {
                "ctx": table["ctx"].combine_chunks(),
                "_chunk": table["_chunk"].combine_chunks(),
                "_entry": pa.array(entries, pa.int64()),
                "_open": pa.array(heads, pa.int64()),
            }
        )

    entries = reports.groupBy("ctx").applyInArrow(chain, entry_schema)
    marked = rows.withColumn("_chunk", own).join(entries, ["ctx", "_chunk"])
    chunk_schema = T.StructType(marked.schema.fields + [T.StructField("first_seq", T.LongType())])
    return (
        marked.groupBy("ctx", "_chunk")
        .applyInArrow(
            lambda t: mark(t, int(t["_entry"][0].as_py()), t["_open"][0].as_py() or 0),
            chunk_schema,
        )
        .drop("_chunk", "_entry", "_open", "_pos")
    )


def subgroup_statistics(members: DataFrame, keys: list[str], with_members: bool = False) -> DataFrame:
    """Mean, range, sample deviation, count and time span of each subgroup.

    ``with_members`` adds the member row numbers and values in sequence order. It
    suits the methods whose subgroups hold at most ``subgroup_size`` rows.
    """
    aggregates = [
        F.avg("value").alias("mean"),
        (F.max("value") - F.min("value")).alias("range"),
        F.stddev_samp("value").alias("std_dev"),
        F.count("*").alias("count"),
        F.min("event_timestamp").alias("start_timestamp"),
        F.max("event_timestamp").alias("end_timestamp"),
        F.max("subgroup_size").alias("_size"),
    ]
    if "first_seq" not in keys:
        aggregates.append(F.min("seq").alias("first_seq"))
    if with_members:
        aggregates.append(F.sort_array(F.collect_list(F.struct("seq", "value"))).alias("_members"))
    stats = members.groupBy("ctx", *keys).agg(*aggregates)
    if with_members:
        stats = stats.withColumns({"indices": F.col("_members.seq"), "values": F.col("_members.value")}).drop("_members")
    return stats


def form_subgroups(
    rows: DataFrame,
    layout: Layout,
    methods=SUBGROUP_METHODS,
    with_members: bool = False,
) -> DataFrame:
    """All subgroups of all contexts, numbered in order and labelled.

    ``methods`` names the forming methods that occur, so plans for the others are
    not built. Size 1 makes single-row subgroups whatever the method says.
    """
    methods = set(methods)
    if with_members and "EXISTING_ID" in methods:
        raise ValueError("Subgroups named by the data have no size bound; read their members from the rows.")
    parts = []
    plain = rows.filter(_one_by_one() | _method("FIXED_SIZE") | _method("CONSECUTIVE"))
    marked = chunk_starts(plain, layout, "CONSECUTIVE" in methods)
    stats = subgroup_statistics(marked, ["first_seq", "subgroup_method"], with_members)
    # A fixed-size tail shorter than the size is dropped.
    parts.append(
        stats.filter((F.col("subgroup_method") != "FIXED_SIZE") | (F.col("count") == F.col("_size")))
        .drop("subgroup_method")
        .withColumn("subgroup_id", F.lit(None).cast("string"))
    )
    if "TIME_WINDOW" in methods:
        marked = window_starts(rows.filter(_method("TIME_WINDOW")), layout)
        parts.append(
            subgroup_statistics(marked, ["first_seq"], with_members).withColumn(
                "subgroup_id", F.lit(None).cast("string")
            )
        )
    if "EXISTING_ID" in methods:
        named = rows.filter(_method("EXISTING_ID") & F.col("subgroup_id").isNotNull())
        parts.append(subgroup_statistics(named, ["subgroup_id"], with_members))
    subgroups = parts[0]
    for part in parts[1:]:
        subgroups = subgroups.unionByName(part)
    subgroups = subgroups.drop("_size")
    if layout.chunked:
        # Numbering and size selection read the subgroups again; the rows are not formed again for it.
        subgroups = materialize(subgroups, "subgroups")
    subgroups = without_chunks(dense_index(subgroups, layout, "first_seq", "subgroup_index"))
    label = F.format_string("SG-%05d", F.col("subgroup_index"))
    return subgroups.withColumn("subgroup_id", F.coalesce("subgroup_id", label))
