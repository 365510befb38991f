"""Best-fit packing of documents into token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so the plan needs only the histogram of
lengths, which stays small whatever the corpus. The plan says for the n-th piece of each
length where it goes; Spark numbers the pieces of each length and looks their place up.

1. Pieces longer than ``small`` of the capacity are sorted and cut into groups of equal
   cardinality; every length is rounded up to the largest of its group.
2. Which combinations of the few rounded sizes to use is a linear programme, solved by
   column generation: duals of the current combinations, then a knapsack for a better one.
   The part of the solution below whole numbers is filled by best fit.
3. Actual pieces take the places of the rounded sizes; the space they leave remains open.
4. Small pieces, longest first, go where the least space is left (best fit).
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.llm.bytewords import text_bytes
from gaugeline.llm.support import batches_by_bytes, materialize, ship

CAPACITY = 4096
SMALL_SHARE = 1 / 4
GROUPS = 128
LP_STEPS = 400
_RANK_BITS = 44


class Plan:
    """Rows (length, first rank, bins, first bin, offset, copies): the pieces of a length from
    the first rank on go one to each of the bins, ``copies`` times over."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        # Open bins by free space: (first bin, number of bins).
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.free: list[int] = []

    def new_bins(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def keep_open(self, free: int, first: int, n: int) -> None:
        if free and n:
            if not self.open[free]:
                bisect.insort(self.free, free)
            self.open[free].append((first, n))

    def take_tightest(self, size: int) -> tuple[int, int, int] | None:
        at = bisect.bisect_left(self.free, size)
        if at == len(self.free):
            return None
        free = self.free[at]
        first, n = self.open[free].pop()
        if not self.open[free]:
            self.free.pop(at)
        return free, first, n

    def arrays(self) -> dict[str, np.ndarray]:
        rows = np.array(self.rows, np.int64).reshape(-1, 6)
        key = (rows[:, 0] << _RANK_BITS) | rows[:, 1]
        order = np.argsort(key)
        return {"key": key[order], "row": rows[order]}


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The most valuable combination that fits, and its value; one round per piece of a combination."""
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        value, pick = best.copy(), np.full(capacity + 1, -1)
        for i, (size, gain) in enumerate(zip(sizes.tolist(), worth.tolist())):
            with_it = best[: capacity + 1 - size] + gain
            better = with_it > value[size:] + 1e-12
            value[size:][better] = with_it[better]
            pick[size:][better] = i
        if (pick < 0).all():
            break
        best = value
        picks.append(pick)
    column, space = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[space] >= 0:
            column[pick[space]] += 1
            space -= int(sizes[pick[space]])
    return column, float(best[capacity])


def _combinations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Combinations of sizes and how often each is used; together they meet the demand exactly."""
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(LP_STEPS):
        duals = np.linalg.solve(basis.T, np.ones(m))
        column, value = _knapsack(sizes, duals, capacity)
        if value <= 1 + 1e-7:
            break
        x, change = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(change > 1e-9, np.maximum(x, 0) / change, np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, int(ratio.argmin())] = column
    used = np.floor(np.maximum(np.linalg.solve(basis, demand), 0) + 1e-9).astype(np.int64)
    out, left = [], demand.astype(np.int64).copy()
    for column, times in zip(basis.T.round().astype(np.int64), used):
        times = min([int(times), *(int(left[i] // column[i]) for i in np.flatnonzero(column))])
        if times > 0:
            out.append((column, times))
            left -= column * times
    rest = [[capacity, np.zeros(m, np.int64)]][:0]
    for i in np.argsort(-sizes):
        for _ in range(int(left[i])):
            fits = [b for b in rest if b[0] >= sizes[i]]
            box = min(fits, key=lambda b: b[0]) if fits else [capacity, np.zeros(m, np.int64)]
            if not fits:
                rest.append(box)
            box[0] -= sizes[i]
            box[1][i] += 1
    return out + [(column, 1) for _, column in rest]


def make_plan(counts: np.ndarray, capacity: int = CAPACITY, small: float = SMALL_SHARE, groups: int = GROUPS) -> Plan:
    """Plan for ``counts[length]`` pieces of each length from 1 to ``capacity``."""
    plan = Plan(capacity)
    if counts[capacity]:
        plan.rows.append((capacity, 0, int(counts[capacity]), plan.new_bins(int(counts[capacity])), 0, 1))
    limit = int(capacity * small)
    large = [(size, int(counts[size])) for size in range(capacity - 1, limit, -1) if counts[size]]
    total = sum(n for _, n in large)
    # Groups of equal cardinality, longest first; equal rounded sizes are one group.
    queues: dict[int, list[list[int]]] = {}
    rank, group_size, group_end = 0, 0, 0
    for size, n in large:
        done = 0
        while done < n:
            if rank == group_end:
                group_size = size
                group_end = max(rank + 1, (total * (rank * groups // total + 1) + groups - 1) // groups)
            part = min(n - done, group_end - rank)
            queues.setdefault(group_size, []).append([size, done, part])
            rank, done = rank + part, done + part
    if queues:
        sizes = np.array(list(queues))
        demand = np.array([sum(n for _, _, n in queues[s]) for s in queues], float)
        for column, times in _combinations(sizes, demand, capacity):
            slots = []
            for s in np.repeat(sizes, column).tolist():
                taken, need = [], times
                while need:
                    head = queues[s][0]
                    part = min(need, head[2])
                    taken.append((head[0], head[1], part))
                    head[1], head[2], need = head[1] + part, head[2] - part, need - part
                    if not head[2]:
                        queues[s].pop(0)
                slots.append(taken)
            # Bins with the same actual lengths stay together.
            at = [[0, 0] for _ in slots]
            left = times
            while left:
                n = min([left, *(slots[k][i][2] - d for k, (i, d) in enumerate(at))])
                first, offset = plan.new_bins(n), 0
                for k, (i, d) in enumerate(at):
                    size, start, length = slots[k][i]
                    plan.rows.append((size, start + d, n, first, offset, 1))
                    offset += size
                    at[k] = [i + 1, 0] if d + n == length else [i, d + n]
                plan.keep_open(capacity - offset, first, n)
                left -= n
    for size in range(limit, 0, -1):
        left, rank = int(counts[size]), 0

        def put(free, first, n, copies, size=size):
            nonlocal left, rank
            plan.rows.append((size, rank, n, first, capacity - free, copies))
            plan.keep_open(free - copies * size, first, n)
            left, rank = left - n * copies, rank + n * copies

        while left:
            free, first, n = plan.take_tightest(size) or (capacity, None, 0)
            copies = free // size
            if first is None:
                n = -(-left // copies)
                first = plan.new_bins(n)
            whole = min(n, left // copies)
            rest = left - whole * copies if whole < n else 0
            if whole:
                put(free, first, whole, copies)
            if rest:
                put(free, first + whole, 1, rest)
            used = whole + (1 if rest else 0)
            plan.keep_open(free, first + used, n - used)
    return plan


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its checksum, and its number among its task's pieces of that length."""
    ship(docs.sparkSession)

    def encode(batches):
        from gaugeline.llm.unit_tokens import file_encoder

        encoder, task, seen = file_encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches_by_bytes(batches, "text"):
            ids, at = encoder(*text_bytes(batch.column("text")))
            ids = np.insert(ids, at[1:], end_id).astype("<u4")
            at = at + np.arange(len(at))
            size = np.diff(at)
            parts = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            crc = [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip((at[row] + start).tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            by_length = length[order]
            opens = np.flatnonzero(np.diff(by_length, prepend=-1))
            within = np.empty(len(row), np.int64)
            within[order] = np.arange(len(row)) - np.repeat(opens, np.diff(np.append(opens, len(row))))
            slot = seen[length] + within
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(slot, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "slot"],
            )

    return docs.mapInArrow(
        encode, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, slot long"
    )


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to written pieces.

    Pieces of a length are numbered by task and slot: only counts per task and length
    meet, so a length that a third of all pieces share is no hot group.
    """
    spark = pieces.sparkSession
    counts = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row per length
        histogram[row["length"]] = row["n"]
    plan = spark.sparkContext.broadcast(make_plan(histogram, capacity).arrays())
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def place(batches):
        key, row = plan.value["key"], plan.value["row"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, (length << _RANK_BITS) | rank, "right") - 1
            _, first_rank, bins, first_bin, offset, _ = row[at].T
            step = rank - first_rank
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(first_bin + step % bins), pa.array(offset + step // bins * length)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = pieces.join(base, ["task", "length"]).select(*columns, (F.col("base") + F.col("slot")).alias("rank"))
    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pack every document, cut at ``capacity`` tokens where longer, into sequences.

    Returns one row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id`` and ``offset``; a sequence is filled from 0 without gaps. A null text is
    empty and becomes one piece holding the end id. Repeated rows and null ids are packed
    like any row. An empty table gives no rows. Other columns are ignored.
    """
    only = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return place_pieces(materialize(pieces_of(only, tokenizer, end_id, capacity), "pieces"), capacity)
