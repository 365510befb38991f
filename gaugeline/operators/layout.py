"""Ordered work inside a context that never puts a whole large context in one task.

Every frame here carries its grouping key in one struct column ``ctx``. A struct
groups and joins with NULL fields equal to each other, which is what a context
with an absent machine or product needs.

A ``Layout`` is measured once per job. While the largest context stays under
``chunk_rows`` a window may hold it whole, and one exchange on ``ctx`` serves all
stages. Beyond that, positions are cut in chunks of ``chunk_rows``; windows and
joins run per ``(ctx, chunk)`` and only one summary row per chunk is carried over.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Largest context one window task may hold; the session setting overrides it.
CHUNK_ROWS = 1_000_000
CHUNK_SETTING = "spark.gaugeline.chunkRows"
# Chunks that one range partition of the numbering sort may span.
RANGE_CHUNKS = 8
BROADCAST_ROWS = 50_000


@dataclass(frozen=True)
class Layout:
    chunk_rows: int | None = None
    total_rows: int = 0
    contexts: int = 0

    @property
    def chunked(self) -> bool:
        return self.chunk_rows is not None

    @property
    def summary_rows(self) -> int:
        """Most rows a table with one row per context and chunk can have."""
        return self.contexts + self.total_rows // self.chunk_rows

    def chunk(self, position: str) -> Column:
        return F.expr(f"({position} - 1) div {self.chunk_rows}")

    def with_chunk(self, df: DataFrame, position: str) -> tuple[DataFrame, str]:
        """Add the chunk of a position. A chunk column of an earlier step is kept, so
        rows that already lie together by it are not moved again."""
        name = f"_chunk_{position}"
        return (df if name in df.columns else df.withColumn(name, self.chunk(position))), name

    def per_chunk(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.contexts and self.summary_rows <= BROADCAST_ROWS else df


def without_chunks(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_chunk_")])


def context(df: DataFrame, columns) -> DataFrame:
    """Pack the context columns in ``ctx``."""
    return df.withColumn("ctx", F.struct(*[F.col(c) for c in columns]))


def unpack(df: DataFrame) -> DataFrame:
    """Replace ``ctx`` by its fields."""
    if "ctx" not in df.columns:
        return df
    fields = df.schema["ctx"].dataType.fieldNames()
    rest = [c for c in df.columns if c != "ctx" and c not in fields]
    return df.select(*[F.col("ctx")[f].alias(f) for f in fields], *rest)


def measure(df: DataFrame, chunk_rows: int | None = None, count: str | None = None, at_least: int = 1) -> Layout:
    """Decide from the rows per context whether contexts have to be cut in chunks.

    ``count`` names the row count when ``df`` already has one row per context. A chunk
    holds ``at_least`` so many rows.
    """
    chunk_rows = max(at_least, chunk_rows or int(df.sparkSession.conf.get(CHUNK_SETTING, str(CHUNK_ROWS))))
    counts = df.select(F.col(count).alias("count")) if count else df.groupBy("ctx").count()
    row = counts.agg(
        F.max("count").alias("largest"), F.sum("count").alias("total"), F.count("*").alias("n")
    ).first()
    largest, total, n = row["largest"] or 0, row["total"] or 0, row["n"]
    return Layout(chunk_rows if largest > chunk_rows else None, total, n)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables, as the session names it.

    A folder of one machine would lose part files on a cluster, so a session that
    names none may only be local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="gaugeline-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back, so later branches see the same rows."""
    path = f"{scratch_root(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when it has at most ``limit`` rows, else leave the join to AQE."""
    if rows is None:
        rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df


def number_rows(df: DataFrame, layout: Layout, order: list[Column], out: str = "seq") -> DataFrame:
    """Number the rows of each context 1..n in ``order``."""
    if not layout.chunked:
        return df.withColumn(out, F.row_number().over(Window.partitionBy("ctx").orderBy(*order)).cast("long"))
    parts = max(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        math.ceil(layout.total_rows / (RANGE_CHUNKS * layout.chunk_rows)),
    )
    # Range partitions split a hot context by its order key. The row ids must be
    # read twice, so they are written once: a second range sample could differ.
    ranged = materialize(
        df.repartitionByRange(parts, "ctx", *order)
        .sortWithinPartitions("ctx", *order)
        .withColumn("_id", F.monotonically_increasing_id()),
        "ordered",
    )
    ranged = ranged.withColumns(
        {"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    before = Window.partitionBy("ctx").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        ranged.groupBy("ctx", "_part")
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    # One row per range partition and per context boundary inside it.
    if layout.contexts and parts + layout.contexts <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    return (
        ranged.join(spans, ["ctx", "_part"])
        .withColumn(out, F.col("_at") - F.col("_first") + F.col("_before") + 1)
        .drop("_id", "_part", "_at", "_first", "_before")
    )


def with_previous(df: DataFrame, layout: Layout, position: str, columns: dict[str, str]) -> DataFrame:
    """Add the value each column had one position earlier, NULL at position 1.

    ``position`` is dense within a context. The last row of a chunk is also sent
    to the next chunk, so one exchange is enough.
    """
    if not layout.chunked:
        w = Window.partitionBy("ctx").orderBy(position)
        return df.withColumns({new: F.lag(old).over(w) for new, old in columns.items()})
    name = f"_chunk_{position}"
    w = Window.partitionBy("ctx", name).orderBy(position)
    own = layout.chunk(position)
    edge = F.col(position) % layout.chunk_rows == 0
    return (
        df.withColumn(name, F.explode(F.when(edge, F.array(own, own + 1)).otherwise(F.array(own))))
        .withColumns({new: F.lag(old).over(w) for new, old in columns.items()})
        .filter(F.col(name) == own)
    )


def last_marks(df: DataFrame, layout: Layout, position: str, marks: dict[str, Column]) -> DataFrame:
    """For each row, the latest position up to it where a condition held."""
    hits = {name: F.when(mark, F.col(position)) for name, mark in marks.items()}
    if not layout.chunked:
        w = Window.partitionBy("ctx").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.max(hit).over(w) for name, hit in hits.items()})
    df, chunk = layout.with_chunk(df, position)
    earlier = Window.partitionBy("ctx").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = df.groupBy("ctx", chunk).agg(*[F.max(hit).alias(f"_c_{name}") for name, hit in hits.items()])
    carry = carry.withColumns({f"_c_{name}": F.max(f"_c_{name}").over(earlier) for name in hits})
    w = Window.partitionBy("ctx", chunk).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.join(layout.per_chunk(carry), ["ctx", chunk])
        .withColumns({name: F.coalesce(F.max(hit).over(w), F.col(f"_c_{name}")) for name, hit in hits.items()})
        .drop(*[f"_c_{name}" for name in hits])
    )


def dense_index(df: DataFrame, layout: Layout, position: str, out: str) -> DataFrame:
    """Number the rows of each context 1..n by a position that is unique but has gaps."""
    if not layout.chunked:
        return df.withColumn(out, F.row_number().over(Window.partitionBy("ctx").orderBy(position)).cast("long"))
    df, chunk = layout.with_chunk(df, position)
    earlier = Window.partitionBy("ctx").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        df.groupBy("ctx", chunk)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    w = Window.partitionBy("ctx", chunk).orderBy(position)
    return (
        df.join(layout.per_chunk(counts), ["ctx", chunk])
        .withColumn(out, F.row_number().over(w) + F.col("_before"))
        .drop("_before")
    )


def attach(
    df: DataFrame,
    per_context: DataFrame,
    layout: Layout,
    position: str,
    length: str,
    how: str = "inner",
    keep_length: bool = True,
) -> DataFrame:
    """Join one row per context to the rows of that context.

    ``length`` is a column of ``per_context`` holding the highest position. In
    chunks the small side is repeated once per chunk, so no join key holds more
    than one chunk of rows.
    """
    if layout.contexts and layout.contexts <= BROADCAST_ROWS:
        joined = df.join(F.broadcast(per_context), "ctx", how)
    elif not layout.chunked:
        joined = df.join(per_context, "ctx", how)
    else:
        df, chunk = layout.with_chunk(df, position)
        spread = per_context.withColumn(
            chunk, F.explode(F.sequence(F.lit(0).cast("long"), layout.chunk(f"greatest({length}, 1)")))
        )
        joined = df.join(spread, ["ctx", chunk], how)
    return joined if keep_length else joined.drop(length)


def with_totals(df: DataFrame, layout: Layout, position: str, totals: dict[str, Column]) -> DataFrame:
    """Add aggregates of the whole context to each of its rows."""
    if not layout.chunked:
        w = Window.partitionBy("ctx")
        return df.withColumns({name: total.over(w) for name, total in totals.items()})
    per_context = df.groupBy("ctx").agg(
        *[total.alias(name) for name, total in totals.items()], F.max(position).alias("_length")
    )
    return attach(df, per_context, layout, position, "_length", keep_length=False)
