"""Hard negatives within score windows below the positives of each anchor, by slots.

Anchors and rows meet in the cells of a grid, both sides in groups of bounded bytes. A
first search finds the best rows of an anchor's own label. The upper limits of these
positives split the scores of all other rows into disjoint slots, the highest first, so
that a window is a run of slots cut at its lower limit. A second search keeps the best k
rows of every slot in each cell, ranks bring these to k per slot, and merging the slots
from the lowest up gives the best k of every window at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.llm.support import materialize, ship, shuffle_parts

# Bytes of the vectors of one group of anchors and of one group of rows.
ANCHOR_BYTES = 32 << 20
ROW_BYTES = 16 << 20
# Scores that a cell holds at a time.
STRIP = 2 << 20


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    flat = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(lists), -1) if len(flat) else np.zeros((len(lists), 0), np.int64)


def _exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """Doubles while every sum of products is exact in them, else longs."""
    most = [max(1, int(x.max(initial=0)), -int(x.min(initial=0))) for x in (a, b)]
    return np.float64 if most[0] * most[1] * max(1, a.shape[1]) < 1 << 52 else np.int64


def _strips(n: int, width: int):
    step = max(1, STRIP // max(1, width))
    return [(at, min(n, at + step)) for at in range(0, n, step)]


def _best(row: np.ndarray, col: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int):
    """The first k of each ``row`` by falling score, then by id."""
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    opens = np.flatnonzero(np.diff(row, prepend=-1))
    rank = np.arange(len(row)) - np.repeat(opens, np.diff(np.append(opens, len(row))))
    return row[rank < k], col[rank < k], score[rank < k].astype(np.int64)


def same_label_best(anchor_ids, anchor_labels, anchors, ids, labels, rows, k: int):
    """The k best rows of each anchor's own label: (anchor, row, score) positions."""
    kind = _exact_kind(anchors, rows)
    found = []
    for label in np.unique(anchor_labels):
        mine, own = np.flatnonzero(anchor_labels == label), np.flatnonzero(labels == label)
        columns = np.ascontiguousarray(rows[own].T.astype(kind))
        for first, last in _strips(len(mine) if len(own) else 0, len(own)):
            part = mine[first:last]
            score = anchors[part].astype(kind) @ columns
            allowed = ids[own][None, :] != anchor_ids[part][:, None]
            if len(own) > k + 1:
                # Beyond the k + 1 best, one of which may be the anchor, nothing is taken.
                allowed &= score >= np.partition(score, len(own) - k - 1, axis=1)[:, -k - 1 : -k]
            r, c = np.nonzero(allowed)
            r, c, s = _best(r, c, score[r, c], ids[own], k)
            found.append((part[r], own[c], s))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def slot_best(anchor_labels, anchors, uppers, lowers, ids, labels, rows, k: int):
    """The k best rows of another label in each slot: (anchor, slot, row, score) positions.

    ``uppers`` holds an anchor's distinct upper limits from high to low, padded with the
    last; ``lowers`` the least lower limit of the windows that begin at or above each slot.
    """
    kind = _exact_kind(anchors, rows)
    columns = np.ascontiguousarray(rows.T.astype(kind))
    found, slots = [], uppers.shape[1]
    for first, last in _strips(len(anchors) if len(ids) else 0, len(ids)):
        score = anchors[first:last].astype(kind) @ columns
        fits = (score <= uppers[first:last, :1]) & (score >= lowers[first:last].min(axis=1, keepdims=True))
        r, c = np.nonzero(fits & (labels[None, :] != anchor_labels[first:last, None]))
        s = score[r, c]
        slot = (uppers[first + r] >= s[:, None]).sum(axis=1) - 1
        # A padded limit repeats the last: count distinct limits only.
        slot = np.minimum(slot, (np.diff(uppers[first + r], axis=1) < 0).sum(axis=1))
        keep = s >= lowers[first + r, slot]
        at, c, s = _best((r * slots + slot)[keep], c[keep], s[keep], ids, k)
        found.append((first + at // slots, at % slots, c, s))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


def _usable(vectors: DataFrame, vec_id: str, embedding: str, label: Column, scale: float) -> DataFrame:
    cell = F.col(embedding)
    finite = F.forall(cell, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("id"), label.alias("label"),
        F.when(finite, F.transform(cell, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))).alias("v"),
    ).filter("id is not null and label is not null and v is not null")
    # Repeated rows of one id are one row before they are dealt out.
    one = rows.groupBy("id", F.size("v").alias("dims")).agg(F.min(F.struct("label", "v")).alias("row"))
    return one.select("id", "dims", "row.label", "row.v")


def hard_negatives(
    vectors: DataFrame, label: Column | None = None, every: int = 100, positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0,
) -> DataFrame:
    """For each anchor and positive, the best rows of other labels in the positive's window.

    Anchors are rows whose id is divisible by ``every``; positives the best ``positives``
    other rows of the same label (column ``label`` unless an expression is given); a
    negative's score lies from ``low`` to ``high`` percent of the positive's. Scores are
    inner products of ``floor(scale * x)``; ties go to the smaller id. Returns
    ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``,
    ``negative_score``; an empty window gives no row. Rows with a null id, label or vector,
    or a null or non-finite component, take no part. Rows of one id and length are one row,
    that with the smallest label, then vector; vectors meet those of their own length. One
    hundred times a score must fit a long. An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = materialize(_usable(vectors, vec_id, embedding, F.col("label") if label is None else label, scale), "vectors")
    total, asked, dims = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.max("dims")).first()
    width = 8 * max(1, dims or 1)
    anchor_groups = max(1, math.ceil(asked * width / ANCHOR_BYTES))
    row_groups = max(shuffle_parts(spark), math.ceil(total * width / ROW_BYTES))

    def spread(n: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    cell = ("ag", "rg", "dims")
    anchors = rows.filter(F.col("id") % every == 0)
    others = rows.select("*", spread(row_groups, 2).alias("rg"), all_of(anchor_groups).alias("ag"))
    kind = rows.schema["label"].dataType.simpleString()

    def dealt(asking: DataFrame) -> DataFrame:
        out = asking.select("*", spread(anchor_groups, 1).alias("ag"), all_of(row_groups).alias("rg"))
        return out.toDF(*out.columns)  # columns of its own, apart from those of the rows

    def sides(a: pa.Table, b: pa.Table):
        codes = np.unique(np.array(a.column("label").to_pylist() + b.column("label").to_pylist(), dtype=object), return_inverse=True)[1]
        return (a.column("id").to_numpy(), codes[: len(a)], _matrix(a.column("v")),
                b.column("id").to_numpy(), codes[len(a) :], _matrix(b.column("v")))

    def find_positives(a: pa.Table, b: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        out = {"anchor_id": none, "positive_id": none, "positive_score": none}
        if len(a) and len(b):
            anchor_ids, anchor_labels, asking, ids, labels, matrix = sides(a, b)
            at, c, s = same_label_best(anchor_ids, anchor_labels, asking, ids, labels, matrix, positives)
            out = {"anchor_id": anchor_ids[at], "positive_id": ids[c], "positive_score": s}
        return pa.table(out)

    def find_negatives(a: pa.Table, b: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        out = {"anchor_id": none, "slot": none.astype(np.int32), "negative_id": none, "negative_score": none}
        if len(a) and len(b):
            anchor_ids, anchor_labels, asking, ids, labels, matrix = sides(a, b)
            limits = []
            for name in ("uppers", "lowers"):
                lists = a.column(name).to_pylist()
                limits.append(np.array([x + x[-1:] * (positives - len(x)) for x in lists], np.int64))
            at, slot, c, s = slot_best(anchor_labels, asking, *limits, ids, labels, matrix, negatives)
            out = {"anchor_id": anchor_ids[at], "slot": slot.astype(np.int32), "negative_id": ids[c], "negative_score": s}
        return pa.table(out)

    first = dealt(anchors).groupBy(*cell).cogroup(others.groupBy(*cell)).applyInArrow(
        find_positives, "anchor_id long, positive_id long, positive_score long"
    )
    # Dimensions separate the vectors of one id, so an anchor is told apart by both.
    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = first.withColumn("_rank", F.row_number().over(by_score)).filter(F.col("_rank") <= positives).drop("_rank")
    upper = F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100L)) div 100")
    lower = F.expr(f"-((-{low} * positive_score - pmod(-{low} * positive_score, 100L)) div 100)")
    chosen = chosen.withColumns({"upper": upper, "lower": lower}).withColumn(
        "slot", F.dense_rank().over(Window.partitionBy("anchor_id").orderBy(F.desc("upper"))) - 1
    )
    chosen = materialize(chosen, "positives")

    # One upper limit a slot, and the least lower limit of the windows that reach it.
    reach = Window.partitionBy("anchor_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = chosen.groupBy("anchor_id", "slot").agg(F.max("upper").alias("upper"), F.min("lower").alias("lower"))
    slots = slots.withColumn("lower", F.min("lower").over(reach)).groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("slot", "upper", "lower"))).alias("s")
    ).select(F.col("anchor_id").alias("id"), F.col("s.upper").alias("uppers"), F.col("s.lower").alias("lowers"))
    second = dealt(anchors.join(slots, "id")).groupBy(*cell).cogroup(others.groupBy(*cell)).applyInArrow(
        find_negatives, "anchor_id long, slot int, negative_id long, negative_score long"
    )
    in_slot = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("negative_score"), "negative_id")
    kept = second.withColumn("_rank", F.row_number().over(in_slot)).filter(F.col("_rank") <= negatives)
    best = "array<struct<down:bigint,id:bigint>>"
    merged = (
        kept.groupBy("anchor_id", "slot")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("negative_score")).alias("down"), F.col("negative_id").alias("id")))).alias("best"))
        .groupBy("anchor_id")
        .agg(F.sort_array(F.collect_list(F.struct("slot", "best")), asc=False).alias("slots"))
        # From the lowest slot up: a slot's rows come before those of all slots below it.
        .select("anchor_id", F.expr(f"""
            aggregate(slots, cast(array() as array<struct<slot:int,best:{best}>>), (done, s) -> concat(
              array(named_struct('slot', s.slot, 'best',
                slice(concat(s.best, coalesce(get(done, 0).best, cast(array() as {best}))), 1, {negatives}))), done))
        """).alias("merged"))
    )
    answer = F.expr("filter(get(filter(merged, m -> m.slot >= slot), 0).best, n -> -n.down >= lower)")
    return (
        chosen.join(merged, "anchor_id")
        .select("anchor_id", "positive_id", "positive_score", F.posexplode(answer).alias("at", "n"))
        .select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"),
                "positive_score", (-F.col("n.down")).alias("negative_score"))
    )
