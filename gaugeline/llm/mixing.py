"""Mixing sources to target weights by exact cuts in a hash-random order.

Targets follow from one row per source. Documents are range-sorted by source and a hash of
their id; each range partition sums its sizes as it is written, and one row per source and
partition carries the sums of the partitions before, so a source of any size spreads over
many tasks. A source's budget is a number of whole passes and a rest; the rest is cut at
its exact word in the hash order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from gaugeline.llm.bytewords import NOT_SPACE, find_words, text_bytes
from gaugeline.llm.support import batches_by_bytes, materialize, ship, shuffle_parts
from gaugeline.operators.layout import small


def word_counts(docs: DataFrame, keep: list[str], text: str = "text", out: str = "size") -> DataFrame:
    """``keep`` and the number of words of ``text``; a null text has none."""
    asked = docs.select(*keep, F.col(text).alias("_words_of"))
    schema = StructType([*asked.schema.fields[:-1], StructField(out, LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "_words_of"):
            sizes = find_words(*text_bytes(batch.column("_words_of")), NOT_SPACE).counts()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*batch.schema.names[:-1], out])

    return asked.mapInArrow(count, schema)


def sums_before(rows: DataFrame, group: str, order: list[Column], values: list[str], per_group: DataFrame | None = None) -> DataFrame:
    """Add ``<value>_before``: the sum of each value (none negative) over earlier rows of the group.

    ``group`` is a struct column, so that null fields are equal. ``per_group`` (one row per
    group) is joined on the way, by group and range partition: a large group is no hot key.
    """
    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), *[StructField(f"_run_{v}", LongType()) for v in values]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carry = TaskContext.get().partitionId(), dict.fromkeys(values, 0)
        for batch in batches:
            more = [pa.array(np.full(batch.num_rows, part, np.int32))]
            for v in values:
                own = batch.column(v).to_numpy(zero_copy_only=False)
                ends = carry[v] + np.cumsum(own)
                carry[v] = int(ends[-1]) if len(ends) else carry[v]
                more.append(pa.array(ends - own, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)

    spark = rows.sparkSession
    # The partition of a row is read twice, so it is written once.
    ranged = materialize(
        rows.repartitionByRange(shuffle_parts(spark), group, *order).sortWithinPartitions(group, *order).mapInArrow(run, schema), "ranged"
    )
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = ranged.groupBy(group, "_part").agg(
        *[F.min(f"_run_{v}").alias(f"_first_{v}") for v in values], *[F.sum(v).alias(f"_n_{v}") for v in values]
    )
    spans = spans.select(group, "_part", *[f"_first_{v}" for v in values], *[
        F.coalesce(F.sum(f"_n_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values
    ])
    if per_group is not None:
        spans = spans.join(per_group, group)
    joined = ranged.join(small(materialize(spans, "spans")), [group, "_part"])
    joined = joined.withColumns({f"{v}_before": F.col(f"_run_{v}") - F.col(f"_first_{v}") + F.col(f"_before_{v}") for v in values})
    return joined.drop("_part", *[f"{p}{v}" for v in values for p in ("_run_", "_first_", "_before_")])


def source_targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Target and exact budget of every source: ``src`` (a struct), ``source_size``, ``target``, ``budget``.

    Weights go to the sources in their order, null last, over and over. With sources in the
    order of size to weight, a source stops at its limit when the share it would get of what
    the sources before it leave, all of these stopped, is above the limit; all integers.
    """
    every = F.struct(F.lit(0).alias("all")).alias("all")
    turns = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = sums_before(
        sources.select(every, "*", F.lit(1).cast("long").alias("one")), "all", [F.col("src")["source"].isNull(), F.col("src")["source"]], ["one"]
    )
    weighed = ranked.select(
        "all", "src", "source_size", F.element_at(turns, (F.col("one_before") % len(weights) + 1).cast("int")).alias("weight"), "one_before"
    ).withColumn("limit", most * F.col("source_size"))
    common = math.lcm(*weights)
    ratio = F.col("source_size").cast("decimal(38,0)") * F.expr(f"{common} div weight")
    placed = materialize(sums_before(weighed, "all", [ratio, F.col("one_before")], ["limit", "weight"]), "targets")
    total, weight = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    wide = "decimal(38,0)"
    share = (F.lit(total) - F.col("limit_before")).cast(wide) * F.col("weight")
    placed = placed.withColumn("stops", share > F.col("limit").cast(wide) * (F.lit(weight) - F.col("weight_before")))
    taken, gone = placed.filter("stops").agg(F.coalesce(F.sum("limit"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, left = F.lit(total - taken), F.lit(max(1, weight - gone))
    return placed.select(
        "src", "source_size",
        F.when(F.col("stops"), F.col("limit").cast("double")).otherwise((F.col("weight") * rest).cast("double") / left.cast("double")).alias("target"),
        F.when(F.col("stops"), F.col("limit")).otherwise(F.floor((F.col("weight").cast(wide) * rest) / left)).cast("long").alias("budget"),
    )


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix",
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """How many words of every document a mix of all sources takes.

    Sources share as many words as there are by ``weights``, given in turn to the sources by
    code point, null last; none gets more than ``most`` times its size, what it cannot take
    goes to the others by weight. Returns ``doc_id``, ``size`` (words of the text), ``source``,
    ``source_size``, ``target`` and ``taken``: ``taken`` counts repeats, sums to the whole part
    of the target in every source, and is at most ``most`` times ``size``. The document at the
    cut gives part of its words. Order is by a hash of id and ``seed``, then by id and size, so
    reruns agree; rows equal in all three are interchangeable. A null text has no words, a null
    source is one source, a null id has the hash of an empty one. Every row is returned,
    repeated ones too; an empty table gives none. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    asked = docs.select(F.col(doc_id).alias("doc_id"), F.struct(F.col(source).alias("source")).alias("src"), F.col(text).alias("text"))
    sized = materialize(word_counts(asked, ["doc_id", "src"]), "sized")
    sources = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, tuple(weights), most)
    key = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 15)
    # The row number only keeps many rows of one id from meeting in one range.
    keyed = sized.select("*", F.conv(key, 16, 10).cast("long").alias("_key"), F.monotonically_increasing_id().alias("_row"))
    placed = sums_before(keyed, "src", [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("_row")], ["size"], targets)
    passes = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.col("budget") - passes * F.col("source_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("size_before")))
    return placed.select("doc_id", F.col("src.source").alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"))
