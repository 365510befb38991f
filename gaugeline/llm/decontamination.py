"""Benchmark decontamination with a distributed positional inverted index.

The index is a written table with one row per shard, a run of documents of one task of
bounded size: its documents, and for each term the ascending positions of the term in the
shard. Positions of different documents lie apart by more than any match can span. Test
windows are a written table and go to every shard in blocks cut by their number; there the lists of a window's terms
are shifted by the terms' offsets and intersected, the shortest list first. No posting is
moved between tasks, so a frequent term is no hot key.

Terms are 64-bit hashes of words. An index made for known tests keeps only their terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.llm.bytewords import ALNUM, FOLD, find_words, hash_spans, ranges, text_bytes
from gaugeline.llm.support import batches_by_bytes, materialize, ship

WINDOW = 13
SHARD_BYTES = 16 << 20
# Windows that one pass takes to the tasks, in bytes; a larger benchmark goes in several passes.
BLOCK_BYTES = 32 << 20
PACK_WINDOWS = 4096
_WINDOWS = "part int, k int, n int, items array<string>, starts binary, lengths binary, hashes binary"
_GAP = 64
_INDEX = "shard string, doc_ids binary, null_ids binary, n_words binary, firsts binary, terms binary, sizes binary, positions binary"


@dataclass(frozen=True)
class Tests:
    """Windows of a block of test items: rows of term numbers, -1 behind a short window's end."""

    terms: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    starts: np.ndarray


def words_of(column: pa.Array):
    data, at = text_bytes(column)
    data = FOLD[data]
    words = find_words(data, at, ALNUM)
    return words, hash_spans(data, words.starts, words.ends)


def item_windows(benchmark: DataFrame, size: int, most: int, item_id: str, text: str) -> DataFrame:
    """Written rows of at most ``most`` windows of the distinct items.

    An item of fewer words is one window, an empty one none. Hashes fill ``size`` places,
    zero behind a short window's end.
    """

    def cut(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches_by_bytes(batches, "text"):
            words, hashes = words_of(batch.column("text"))
            counts = words.counts()
            length = np.minimum(counts, size)
            many = np.where(counts > 0, counts - length + 1, 0)
            owner = np.repeat(np.arange(len(counts)), many)
            start = ranges(np.zeros(len(counts), np.int64), many)
            ids = batch.column("item_id")
            for first in range(0, len(owner), most):
                rows = slice(first, first + most)
                n = length[owner[rows]]
                place = (words.first[:-1][owner[rows]] + start[rows])[:, None] + np.arange(size)
                inside = np.arange(size) < n[:, None]
                packed = np.where(inside, hashes[np.minimum(place, len(hashes) - 1)], np.uint64(0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([len(n)], pa.int32()),
                        pa.array([ids.take(pa.array(owner[rows])).to_pylist()], pa.list_(pa.string())),
                        *(pa.array([x.tobytes()], pa.binary()) for x in (start[rows].astype(np.int64), n.astype(np.int64), packed)),
                    ],
                    names=[x.split()[0] for x in _WINDOWS.split(", ")],
                )
                k += 1

    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).dropna().distinct()
    return materialize(items.mapInArrow(cut, _WINDOWS), "item-windows")


def tests_of(rows: list, size: int) -> Tests:
    """The windows of written rows, their terms numbered."""

    def joined(name, kind):
        return np.frombuffer(b"".join(bytes(r[name]) for r in rows), kind)

    lengths, hashes = joined("lengths", np.int64), joined("hashes", np.uint64).reshape(-1, size)
    inside = np.arange(size) < lengths[:, None]
    terms, numbers = np.unique(hashes[inside], return_inverse=True)
    windows = np.full(hashes.shape, -1, np.int64)
    windows[inside] = numbers
    return Tests(terms, windows, lengths, np.array([i for r in rows for i in r["items"]], object), joined("starts", np.int64))


def build_index(docs: DataFrame, terms: np.ndarray | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the positional index; with ``terms`` (sorted hashes) only their postings are kept."""
    spark = docs.sparkSession
    ship(spark)
    wanted = None if terms is None else spark.sparkContext.broadcast(terms)

    def index(batches):
        import uuid

        for batch in batches_by_bytes(batches, "text", SHARD_BYTES):
            words, hashes = words_of(batch.column("text"))
            counts = words.counts()
            firsts = np.cumsum(counts + _GAP) - counts - _GAP
            positions = ranges(firsts, counts)
            if wanted is not None:
                place = np.minimum(np.searchsorted(wanted.value, hashes), max(len(wanted.value) - 1, 0))
                kept = np.flatnonzero(wanted.value[place] == hashes) if len(wanted.value) else np.zeros(0, np.int64)
                hashes, positions = hashes[kept], positions[kept]
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            opens = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
            ids = batch.column("doc_id")
            arrays = (
                ids.fill_null(0).to_numpy().astype(np.int64), np.array(ids.is_null().to_numpy(zero_copy_only=False), np.uint8), counts.astype(np.int32),
                firsts.astype(np.int64), hashes[opens], np.diff(np.append(opens, len(hashes))).astype(np.int32), positions[order].astype(np.int32),
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)],
                names=[x.split()[0] for x in _INDEX.split(", ")],
            )

    only = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return materialize(only.mapInArrow(index, _INDEX), "position-index")


class Shard:
    def __init__(self, row: dict):
        def of(name, kind):
            return np.frombuffer(row[name], kind)

        self.doc_ids, self.null_ids = of("doc_ids", np.int64), of("null_ids", np.uint8)
        self.n_words, self.firsts = of("n_words", np.int32), of("firsts", np.int64)
        self.terms, sizes = of("terms", np.uint64), of("sizes", np.int32).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.positions = of("positions", np.int32)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, position, "right") - 1

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the list of each term begins, and its length (0 if the term is absent)."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        place = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        found = self.terms[place] == terms
        return self.at[place], np.where(found, self.at[place + 1] - self.at[place], 0)


def _phrase(lists: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Positions where the terms stand one behind the other."""
    starts = lists[order[0]] - order[0]
    for k in order[1:]:
        if not len(starts):
            break
        want = starts + k
        place = np.minimum(np.searchsorted(lists[k], want), len(lists[k]) - 1)
        starts = starts[lists[k][place] == want]
    return starts


def _near(lists: list[np.ndarray], anchor: int, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of the tightest ordered match around each anchor, if within ``slop``."""
    low = high = lists[anchor].astype(np.int64)
    ok = np.ones(len(low), bool)
    for k in range(anchor + 1, len(lists)):
        place = np.searchsorted(lists[k], high, "right")
        ok &= place < len(lists[k])
        high = lists[k][np.minimum(place, len(lists[k]) - 1)].astype(np.int64)
    for k in range(anchor - 1, -1, -1):
        place = np.searchsorted(lists[k], low, "left") - 1
        ok &= place >= 0
        low = lists[k][np.maximum(place, 0)].astype(np.int64)
    ok &= (high - low + 1 <= len(lists) + slop) & (high >= low)
    return low[ok], high[ok]


def matches_in(shard: Shard, tests: Tests, slop: int | None = None):
    """(window, first positions, last positions, exact) for every window that occurs."""
    begin, size = shard.lists(tests.terms)
    if not len(tests.windows):
        return
    padded = np.where(tests.windows >= 0, tests.windows, tests.windows[:, :1])
    for w in np.flatnonzero(size[padded].min(axis=1) > 0).tolist():
        terms = tests.windows[w, : tests.lengths[w]]
        lists = [shard.positions[begin[t] : begin[t] + size[t]] for t in terms]
        order = np.argsort(size[terms], kind="stable")
        starts = _phrase(lists, order)
        if len(starts):
            yield w, starts, starts + len(terms) - 1, True
        if slop is not None:
            low, high = _near(lists, int(order[0]), slop)
            loose = high - low + 1 > len(terms)
            if loose.any():
                yield w, low[loose], high[loose], False


def _blocks(benchmark: DataFrame, window: int, item_id: str, text: str) -> Iterator[tuple[int, Tests]]:
    """The number of blocks and each block's windows, of about ``BLOCK_BYTES`` in all."""
    limit = max(1, BLOCK_BYTES // (8 * window + 24))
    packed = item_windows(benchmark, window, min(PACK_WINDOWS, limit), item_id, text)
    # One small row for each row of packed windows.
    before = F.sum("n").over(Window.orderBy("part", "k")) - F.col("n")
    block = packed.select("part", "k", F.floor(before.cast("long") / F.lit(limit)).cast("int").alias("block"))
    dealt = materialize(packed.join(block, ["part", "k"]), "item-blocks")
    n = 1 + (dealt.agg(F.max("block")).first()[0] or 0)
    for k in range(n):
        yield n, tests_of(dealt.filter(F.col("block") == k).collect(), window)


def _scan(index: DataFrame, tests: Tests, rows_of, schema: str) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(tests)

    def scan(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                yield rows_of(row["shard"], Shard(row), sent.value)

    return index.mapInArrow(scan, schema)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Exact hits of benchmark windows per document.

    Words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z.
    A document word inside an occurrence of a window is hit. Returns ``doc_id``, ``n_words``,
    ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` (n_hit > 0 and 20 * n_hit >=
    n_words), one row per row of ``docs``. A null or empty text has no words and is clean. A
    null item id takes no part; repeated items count once. An empty benchmark leaves all
    documents clean, empty ``docs`` give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = "shard string, row int, doc_id long, n_words long, hit array<int>, items array<string>"

    def rows_of(name, shard, tests):
        hit_d, hit_p, item_d, item_w = [], [], [], []
        for w, low, high, _ in matches_in(shard, tests):
            document = shard.document(low)
            n = high - low + 1
            hit_d.append(np.repeat(document, n))
            hit_p.append(ranges(low.astype(np.int64), n))
            found = np.unique(document)
            item_d.append(found)
            item_w.append(np.full(len(found), w))
        docs_n = len(shard.doc_ids)
        spots = np.unique(np.concatenate(hit_p)) if hit_p else np.zeros(0, np.int64)
        owner = shard.document(spots)
        edges = np.searchsorted(owner, np.arange(docs_n + 1))
        items: list[list[str]] = [[] for _ in range(docs_n)]
        if item_d:
            for d, i in {(d, tests.items[w]) for d, w in zip(np.concatenate(item_d).tolist(), np.concatenate(item_w).tolist())}:
                items[d].append(i)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name] * docs_n), pa.array(np.arange(docs_n), pa.int32()),
                pa.array(shard.doc_ids, mask=shard.null_ids.astype(bool)), pa.array(shard.n_words, pa.int64()),
                pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array((spots - shard.firsts[owner]) if len(spots) else spots, pa.int32())),
                pa.array(items, pa.list_(pa.string())),
            ],
            names=["shard", "row", "doc_id", "n_words", "hit", "items"],
        )

    blocks = _blocks(benchmark, window, item_id, item_text)
    n, tests = next(blocks)
    index = build_index(docs, tests.terms if n == 1 else None, doc_id, text)
    found = _scan(index, tests, rows_of, schema)
    if n > 1:
        for _, tests in blocks:
            found = found.unionAll(_scan(index, tests, rows_of, schema).filter(F.size("hit") > 0))
        found = found.groupBy("shard", "row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    n_hit = F.size("hit").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def phrase_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Where windows occur: ``doc_id``, ``item_id`` (text), ``item_start``, ``first_word``, ``last_word``, ``exact``.

    With ``slop`` above 0 also ordered matches with up to so many words between the terms,
    the tightest around each place of the rarest term. Nulls and empty tables as above: they
    give no rows. A repeated document gives its rows again, a repeated item does not; items
    that share a window each give a row.
    """
    if slop > _GAP - 1:
        raise ValueError(f"slop must be below {_GAP}")
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id long, item_id string, item_start long, first_word long, last_word long, exact boolean"

    def rows_of(_, shard, tests):
        out = []
        for w, low, high, exact in matches_in(shard, tests, slop or None):
            document = shard.document(low)
            first = shard.firsts[document]
            ids = pa.array(shard.doc_ids[document], mask=shard.null_ids[document].astype(bool))
            n = len(low)
            out.append(pa.table([ids, pa.array([tests.items[w]] * n), pa.array(np.full(n, tests.starts[w])), pa.array((low - first).astype(np.int64)), pa.array((high - first).astype(np.int64)), pa.array(np.full(n, exact))], names=[x.split()[0] for x in schema.split(", ")]))
        whole = pa.concat_tables(out).combine_chunks() if out else None
        return whole.to_batches()[0] if out else pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())], names=[x.split()[0] for x in schema.split(", ")])

    index, found = None, None
    for n, tests in _blocks(benchmark, window, item_id, item_text):
        index = build_index(docs, tests.terms if n == 1 else None, doc_id, text) if index is None else index
        part = _scan(index, tests, rows_of, schema)
        found = part if found is None else found.unionAll(part)
    return found
