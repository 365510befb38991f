"""What the operators of this package share: shipping code, written tables, byte-bounded batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators.layout import materialize, scratch_root

__all__ = ["ARROW_BYTES", "BATCH_BYTES", "batches_by_bytes", "materialize", "numbered", "scratch_root", "ship", "shuffle_parts", "table"]

# Text bytes that a task works on at a time; one longer text makes a batch alone.
BATCH_BYTES = 8 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per session.

    Workers import it by name, so that what they keep between tasks (tokenizers and
    their caches) lives in one module per worker. Arrow batches of the session are bounded
    like those of the operators, unless its configuration says otherwise: a batch is held
    several times, in the JVM, on the way and in the worker.
    """
    context = spark.sparkContext
    if getattr(context, "_gaugeline_llm", False):
        return
    if not context.getConf().contains(ARROW_BYTES):
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    package = Path(__file__).resolve().parents[1]
    bundle = os.path.join(tempfile.mkdtemp(prefix="gaugeline-code-"), "gaugeline_llm.zip")
    with zipfile.ZipFile(bundle, "w") as out:
        for path in [package / "__init__.py", *package.rglob("*.py")]:
            name = str(path.relative_to(package.parent))
            if name not in out.namelist():
                out.write(path, name)
    context.addPyFile(bundle)
    context._gaugeline_llm = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(docs: DataFrame, text: str, keep: list[str], *more: Column) -> tuple[DataFrame, str, list[str]]:
    """The columns ``keep`` and ``text`` under numbers, each once, so that none clashes with
    those of a task; also the name of the text and the names of what is kept."""
    names = keep if text in keep else [*keep, text]
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    return docs.select(*columns, *more), f"c{names.index(text)}", [f"c{i}" for i in range(len(keep))]


def batches_by_bytes(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each; rows stay whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
        first, floor = 0, 0
        while first < batch.num_rows:
            last = max(first + 1, int(ends.searchsorted(floor + limit, "right")))
            yield batch.slice(first, last - first)
            first, floor = last, int(ends[last - 1])
        del batch, ends
    give_back()


def give_back() -> None:
    """Return what a task has freed to the system; workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
