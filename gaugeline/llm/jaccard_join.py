"""Exact Jaccard links between documents' shingle sets, with set relations to skip work.

* Equal sets are one: a representative stands for all its copies.
* Leaders: sets that share a smallest hash are compared with one of them. Members of a
  group that its leader confirms are one component at once, and no pair inside a known
  component is looked at again.
* Index: every representative's rarest shingles (the prefix that any linked pair must
  share) go to lists. A list is ordered by set size and position and falls into blocks between which
  no sizes can link; a block whose entries are of one component is skipped. The position of
  an entry limits the sizes it can still link with, so entries meet only within the size
  bands their positions allow, and a large cell of such entries is dealt over many tasks.
* Pairs whose bitmaps differ in more places than a link allows are out.
* Between components one pair is compared first, which mostly joins them. For the pairs
  that remain, a member's overlap with another set is derived from its leader's: it can
  differ by no more than the two sets differ from each other. Only pairs that these bounds
  leave open are compared.

Every link is decided on the two sets themselves. Rare first is judged by a table of
counters of fixed size over all shingles; its precision changes cost only, not results.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeline.llm.bytewords import FOLD, NOT_SPACE, chain, find_words, hash_spans, mix, ranges, text_bytes
from gaugeline.llm.components import connected_components
from gaugeline.llm.support import batches_by_bytes, materialize, ship, shuffle_parts

SHINGLE = 5
# Similarity as a fraction; links are decided in whole numbers.
NUMERATOR, DENOMINATOR = 75, 100
LEADERS = 5
COUNTERS = 1 << 20
FILTER_BITS = 1 << 24
BITMAP_BITS, MOST_BITMAP_BITS = 2048, 1 << 18
TEXT_BYTES = 2 << 20
PART_TOKENS = 2_000_000
# Entries that one shingle may bring to a Python group; those of a more frequent one are spread.
HOT_POSTINGS = 250_000
# Size bands between a size and the largest one it can link with.
BANDS = 4
# Entries of either side that meet in one cell.
CELL_ROWS = 1024


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and where each text's begin."""
    data, at = text_bytes(column)
    data = FOLD[data]
    words = find_words(data, at, NOT_SPACE)
    hashes = hash_spans(data, words.starts, words.ends)
    n = words.counts()
    many = np.maximum(n - size + 1, 0)
    rows = chain(hashes, size)[ranges(words.first[:-1], many)] if len(hashes) >= size else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(n)), many)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = []
        for d in short:
            own = hashes[words.first[d] : words.first[d + 1]]
            whole.append(mix(chain(own, len(own)) + np.uint64(len(own)))[0])
        rows, owner = np.concatenate([rows, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    edges = np.concatenate([[0], np.cumsum(np.maximum(many, (n > 0).astype(np.int64)))])
    if len(short):
        rows = rows[np.argsort(owner, kind="stable")]
    return _distinct(rows, edges)


def _distinct(rows: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each stretch of ``rows`` sorted and without repeats, and the new edges."""
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > 1:
            rows[a:b].sort()
    fresh = np.ones(len(rows), bool)
    fresh[1:] = rows[1:] != rows[:-1]
    fresh[edges[:-1][np.diff(edges) > 0]] = True
    return rows[fresh], np.concatenate([[0], np.cumsum(fresh)])[edges]


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")).filter("id IS NOT NULL")


def _bitmaps(hashes: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Per set the parity of its shingles in each of a power of two of places, at least four a shingle.

    Half the places of a bitmap laid on the other half give the bitmap of half the size.
    """
    n = np.diff(at)
    few = n <= BITMAP_BITS // 4
    inside = np.repeat(few, n)
    spot = np.repeat(np.arange(len(n)), n)[inside] * BITMAP_BITS + (hashes[inside] % np.uint64(BITMAP_BITS)).astype(np.int64)
    odd = np.packbits(np.bincount(spot, minlength=len(n) * BITMAP_BITS) % 2 == 1).reshape(len(n), -1)
    out = [x.tobytes() for x in odd]
    for d in np.flatnonzero(~few).tolist():
        bits = 1 << min(int(4 * n[d] - 1).bit_length(), MOST_BITMAP_BITS.bit_length() - 1)
        spot = (hashes[at[d] : at[d + 1]] % np.uint64(bits)).astype(np.int64)
        out[d] = np.packbits(np.bincount(spot, minlength=bits) % 2 == 1).tobytes()
    return out


def _differences(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many places two bitmaps differ, the larger one folded to the size of the other."""
    out = np.zeros(len(x), np.int64)
    same = np.array([len(a) == len(b) == BITMAP_BITS // 8 for a, b in zip(x, y)], bool)
    rows = np.flatnonzero(same)
    if len(rows):
        left, right = (np.frombuffer(b"".join(side[i] for i in rows), np.uint64).reshape(len(rows), -1) for side in (x, y))
        out[rows] = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
    for i in np.flatnonzero(~same).tolist():
        a, b = sorted((np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64)), key=len)
        while len(b) > len(a):
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
        out[i] = int(np.bitwise_count(a ^ b).sum())
    return out


def _signatures(texts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """One written row per document, and the counters of all shingles."""
    seeds = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1)) for k in range(LEADERS)]
    names = ["id", "n", "signature", "bitmap", *(f"low{k}" for k in range(LEADERS)), "counters"]
    schema = "id long, n int, signature binary, bitmap binary, " + ", ".join(f"low{k} long" for k in range(LEADERS)) + ", counters binary"

    def sign(batches):
        counters = np.zeros(COUNTERS, np.int64)
        for batch in batches_by_bytes(batches, "text", TEXT_BYTES):
            sets, at = shingle_sets(batch.column("text"))
            counters += np.bincount((sets % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            n = np.diff(at)
            some = np.flatnonzero(n)
            lows = []
            for seed in seeds:
                low = np.zeros(len(n), np.int64)
                if len(some):
                    low[some] = np.minimum.reduceat(mix(sets ^ seed), at[some]).view(np.int64)
                lows.append(low)
            digest = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            bitmaps = _bitmaps(mix(sets), at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(bitmaps, pa.binary()), *(pa.array(x) for x in lows), pa.nulls(len(n), pa.binary())], names=names
            )
        used = np.flatnonzero(counters)
        packed = np.rec.fromarrays([used.astype(np.int32), counters[used]]).tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *(pa.nulls(1, pa.int64()) for _ in seeds), pa.array([packed], pa.binary())], names=names
        )

    written = materialize(texts.mapInArrow(sign, schema), "signatures")
    total = np.zeros(COUNTERS, np.int64)
    for row in _added(written.filter("counters IS NOT NULL").select("counters")).toLocalIterator():
        got = np.frombuffer(row["counters"], np.dtype([("at", "<i4"), ("n", "<i8")]))
        total[got["at"]] += got["n"]
    return written.filter("counters IS NULL").drop("counters"), total


def _added(counters: DataFrame) -> DataFrame:
    """Counters of all tasks (a bounded table each) added up in a few tasks."""

    def add(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column("counters"):
                got = np.frombuffer(x.as_py(), np.dtype([("at", "<i4"), ("n", "<i8")]))
                total[got["at"]] += got["n"]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([np.rec.fromarrays([used.astype(np.int32), total[used]]).tobytes()], pa.binary())], names=["counters"])

    return counters.repartition(4).mapInArrow(add, "counters binary")


def _ids_filter(ids: DataFrame) -> np.ndarray:
    """Bits of hashed ids: a filter of fixed size that lets every listed id pass."""

    def mark(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            _set_bits(bits, batch.column("id").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in ids.coalesce(4).mapInArrow(mark, "bits binary").toLocalIterator():
        total |= np.frombuffer(row["bits"], np.uint8)
    return total


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _set_bits(bits: np.ndarray, ids: np.ndarray) -> None:
    at = _bit(ids)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _sets_of(ids: pa.Array, texts: pa.Array) -> list[np.ndarray]:
    """The set of each row; the text of an id that repeats with equal text is read once."""
    keys = ids.to_numpy()
    order = np.argsort(keys, kind="stable")
    heads = np.flatnonzero(np.diff(keys[order], prepend=keys[order][:1] - 1))
    rows = np.empty(len(keys), np.int64)
    rows[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    chosen = order[heads]
    whole = texts.take(pa.array(chosen))
    if not texts.equals(whole.take(pa.array(rows))):
        whole, rows = texts, np.arange(len(keys))
    sets, at = shingle_sets(whole)
    return [sets[at[r] : at[r + 1]] for r in rows]


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def plausible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs whose bitmaps leave a link possible.

    Shingles flip bits of a bitmap, so two bitmaps differ in no more bits than the sets
    differ in shingles; ``marks`` has ``id``, ``n`` and ``bitmap``.
    """
    sides = [marks.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bitmap").alias(f"bitmap_{c}")) for c in ("a", "b")]

    def pick(batches):
        for batch in batches:
            differ = _differences(batch.column("bitmap_a").to_pylist(), batch.column("bitmap_b").to_pylist())
            total = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            kept = (DENOMINATOR + NUMERATOR) * differ <= (DENOMINATOR - NUMERATOR) * total
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(kept))

    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b").mapInArrow(pick, "a long, b long")


def compare(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Written ``a``, ``b``, ``overlap``, ``n_a``, ``n_b`` for each of the ``pairs`` (``a``, ``b``).

    Only texts that occur in a pair are moved; the filter is of fixed size and lets some
    others pass, which the joins then leave out.
    """
    spark = texts.sparkSession
    pairs = materialize(pairs.select("a", "b"), "pairs")
    bits = spark.sparkContext.broadcast(_ids_filter(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id")))))

    def asked(batches):
        for batch in batches:
            at = _bit(batch.column("id").to_numpy())
            yield batch.filter(pa.array((bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

    some = texts.mapInArrow(asked, "id long, text string")
    left, right = some.select(F.col("id").alias("a"), F.col("text").alias("text_a")), some.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def overlap(batches):
        for batch in batches_by_bytes(batches, "text_a", TEXT_BYTES):
            sides = [_sets_of(batch.column(c), batch.column(f"text_{c}")) for c in ("a", "b")]
            common = [_common(x, y) for x, y in zip(*sides)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(common, pa.int32()), *(pa.array([len(x) for x in side], pa.int32()) for side in sides)],
                names=["a", "b", "overlap", "n_a", "n_b"],
            )

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    written = materialize(joined.mapInArrow(overlap, "a long, b long, overlap int, n_a int, n_b int"), "overlaps")
    bits.destroy()
    return written


def _may_link(n_a: Column, n_b: Column) -> Column:
    return DENOMINATOR * F.least(n_a, n_b) >= NUMERATOR * F.greatest(n_a, n_b)


def _is_link() -> Column:
    return DENOMINATOR * F.col("overlap") >= NUMERATOR * (F.col("n_a") + F.col("n_b") - F.col("overlap"))


def _leader_pairs(reps: DataFrame) -> DataFrame:
    """Each representative with the leader of every smallest hash it shares."""
    keys = reps.select("id", "n", F.posexplode(F.array(*[f"low{k}" for k in range(LEADERS)])).alias("k", "low"))
    # Leaders differ between the hashes, so that one odd leader does not decide.
    leaders = keys.groupBy("k", "low").agg(F.min(F.struct(F.xxhash64("id", "k"), "id", "n")).alias("leader"), F.count("*").alias("members"))
    leaders = leaders.filter("members > 1").select("k", "low", F.col("leader.id").alias("b"), F.col("leader.n").alias("n_b"))
    pairs = keys.join(leaders, ["k", "low"]).filter((F.col("id") != F.col("b")) & _may_link(F.col("n"), F.col("n_b")))
    return pairs.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()


_ENTRY = (("token", "<u4"), ("id_low", "<u4"), ("id_high", "<u4"), ("component_low", "<u4"), ("component_high", "<u4"), ("n", "<u4"), ("position", "<u4"))
_LISTS = "list long, id long, n int, position int, component long, hot boolean"
_HOT = np.uint32(1 << 31)


def _index_lists(texts: DataFrame, known: DataFrame, counters: np.ndarray, shingles: int) -> DataFrame:
    """Written lists with entries of more than one component, after skipping.

    ``known`` has ``id``, ``n`` and ``component`` of every representative. The list of a
    frequent shingle is spread over many groups and skipped as a whole.
    """
    spark = texts.sparkSession
    mean = max(1.0, counters.sum() / COUNTERS)
    hot = counters > mean + 8 * np.sqrt(mean) + 64
    level = np.where(hot, np.floor(np.log2(np.maximum(counters / mean, 1)) * 4) + 1, 0).astype(np.uint8)
    sent = spark.sparkContext.broadcast(level)
    # No shingle of a level has more entries than the counter of the next one.
    ways = np.maximum(1, np.ceil(mean * 2.0 ** (np.arange(256) / 4) / HOT_POSTINGS)).clip(max=1 << 30).astype(np.uint64)
    ways[0] = 1
    parts = max(shuffle_parts(spark), shingles // 4 // PART_TOKENS + 1)

    def prefixes(batches):
        for batch in batches_by_bytes(batches, "text", TEXT_BYTES):
            sets, at = shingle_sets(batch.column("text"))
            n = np.diff(at)
            # Keys in order of frequency: the level in the upper bits, then bits of the hash.
            keys = (sent.value[(sets % np.uint64(COUNTERS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (mix(sets) >> np.uint64(8))
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                keys[a:b].sort()
            # A linked pair shares one of the first n - ceil(0.75 n) + 1 shingles of each set.
            size = np.where(n > 0, n - -(-NUMERATOR * n // DENOMINATOR) + 1, 0)
            rows = keys[ranges(at[:-1], size)]
            edges = np.concatenate([[0], np.cumsum(size * 8)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(rows))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), packed], names=["id", "prefix"])

    def deal(batches):
        for batch in batches_by_bytes(batches, "prefix", TEXT_BYTES):
            data, at = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), np.uint64), batch.column("prefix")
            size = np.array([len(x) // 8 for x in at.to_pylist()])
            ids, n, component = (batch.column(c).to_numpy().astype(np.uint64) for c in ("id", "n", "component"))
            row = np.repeat(np.arange(len(size)), size)
            position = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            spread = ways[(data >> np.uint64(56)).astype(np.int64)]
            salt = np.where(spread > 1, mix(mix(ids[row]) % spread), 0)
            part = (mix(data ^ salt) % np.uint64(parts)).astype(np.int64)
            position = position.astype(np.uint32) | np.where(spread > 1, _HOT, np.uint32(0))
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            low = np.uint64(0xFFFFFFFF)
            columns = (data & low, ids[row] & low, ids[row] >> np.uint64(32), component[row] & low, component[row] >> np.uint64(32), n[row], position)
            columns = [c[order].astype(np.uint32) for c in columns]
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([b"".join(c[cuts[p] : cuts[p + 1]].tobytes() for c in columns) for p in full], pa.binary())], names=["part", "entries"]
            )

    def lists(key, table):
        packed = [np.frombuffer(x.as_py(), np.uint32).reshape(len(_ENTRY), -1) for x in table.column("entries")]
        token, id_low, id_high, c_low, c_high, n, position = np.concatenate(packed, axis=1)
        ids, component = (x.astype(np.uint64) | (y.astype(np.uint64) << np.uint64(32)) for x, y in ((id_low, id_high), (c_low, c_high)))
        hot, position = position >= _HOT, position & ~_HOT
        apart, order = np.flatnonzero(hot), np.flatnonzero(~hot)
        order = order[np.argsort(token[order])]
        sizes = np.diff(np.append(np.flatnonzero(np.diff(token[order].astype(np.int64), prepend=-1)), len(order)))
        order = order[np.repeat(sizes > 1, sizes)]
        order = order[np.lexsort((position[order], n[order], token[order]))]
        kept = _skip(token[order].astype(np.int64), component[order], n[order].astype(np.int64), position[order].astype(np.int64))
        order = order[kept]
        names = np.concatenate([_names(token[order], ids[order]), token[apart].astype(np.int64)])
        order = np.concatenate([order, apart])
        return pa.table({
            "list": names, "id": ids[order].view(np.int64), "n": n[order].astype(np.int32), "position": position[order].astype(np.int32),
            "component": component[order].view(np.int64), "hot": hot[order],
        })

    prefixed = texts.mapInArrow(prefixes, "id long, prefix binary").join(known, "id")
    dealt = prefixed.mapInArrow(deal, "part int, entries binary")
    written = materialize(dealt.groupBy("part").applyInArrow(lists, _LISTS), "lists")
    sent.destroy()
    whole = written.filter("hot").drop("hot")
    same = F.xxhash64(F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64("id", F.lit(1))), F.count("*"))
    mixed = whole.groupBy("list").agg(same.alias("name"), F.min("component").alias("l"), F.max("component").alias("h")).filter("l <> h")
    named = whole.join(mixed.select("list", "name"), "list").drop("list").withColumnRenamed("name", "list")
    return written.filter("NOT hot").drop("hot").unionByName(named)


def _names(token: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A name for each list that lists of the same ids share, whatever their shingle."""
    if not len(token):
        return np.zeros(0, np.int64)
    heads = np.flatnonzero(np.diff(token.astype(np.int64), prepend=-1))
    name = mix(np.add.reduceat(mix(ids), heads) ^ (np.add.reduceat(mix(ids ^ np.uint64(0x5851F42D4C957F2D)), heads) >> np.uint64(7)))
    return np.repeat(name, np.diff(np.append(heads, len(token)))).view(np.int64)


def _skip(token, component, n, position) -> np.ndarray:
    """Entries that may link to an entry of another component in their list.

    Entries are ordered by list, size and position. A list falls into blocks where the next
    size is too large for any link with the sizes before it; a block whose entries are all
    of one component is skipped.
    """
    if not len(token):
        return np.zeros(0, bool)
    opens = np.ones(len(token), bool)
    opens[1:] = (token[1:] != token[:-1]) | (DENOMINATOR * n[:-1] < NUMERATOR * n[1:])
    heads = np.flatnonzero(opens)
    mixed = np.minimum.reduceat(component, heads) != np.maximum.reduceat(component, heads)
    return np.repeat(mixed, np.diff(np.append(heads, len(token))))


_NEIGHBOURS = "part int, side int, list long, n int, component long, id long, component_b long, id_b long"


def _neighbour_pairs(lists: DataFrame) -> DataFrame:
    """One candidate pair for each two components that are neighbours in a list.

    Lists are range-sorted, so a long one lies in many tasks. A task names the neighbours it
    sees and its first and last entry, from which those across tasks follow.
    """
    columns = [c.split()[0] for c in _NEIGHBOURS.split(", ")]

    def pick(batches):
        part = TaskContext.get().partitionId()
        ends = {}
        last = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ends.setdefault(0, table.slice(0, 1))
            ends[1] = table.slice(table.num_rows - 1)
            table = table if last is None else pa.concat_tables([last, table])
            last = ends[1]
            name, ids, n, component = (table.column(c).to_numpy() for c in ("list", "id", "n", "component"))
            small, large = n[:-1].astype(np.int64), n[1:].astype(np.int64)
            near = np.flatnonzero((name[1:] == name[:-1]) & (component[1:] != component[:-1]) & (DENOMINATOR * small >= NUMERATOR * large))
            empty = np.zeros(len(near), np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (empty + part, empty + 2, name[near], n[near], component[near], ids[near], component[near + 1], ids[near + 1])], names=columns
            )
        for side, row in ends.items():
            values = [pa.array([part], pa.int32()), pa.array([side], pa.int32()), *(row.column(c).combine_chunks() for c in ("list", "n", "component", "id"))]
            yield pa.RecordBatch.from_arrays([*values, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=columns)

    order = ["list", "n", "position", "id"]
    parts = shuffle_parts(lists.sparkSession)
    ranged = lists.select(*order, "component").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    written = materialize(ranged.mapInArrow(pick, _NEIGHBOURS), "neighbours")
    # Two rows per range partition.
    before = Window.orderBy("part", "side")
    ends = written.filter("side < 2").withColumns({f"{c}_before": F.lag(c).over(before) for c in ("list", "n", "component", "id")})
    across = ends.filter((F.col("side") == 0) & (F.col("list") == F.col("list_before")) & (F.col("component") != F.col("component_before")) & _may_link(F.col("n"), F.col("n_before")))
    found = written.filter("side = 2").select("component", "id", "component_b", "id_b").unionAll(across.select("component", "id", "component_before", "id_before"))
    pair = F.struct(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"))
    between = found.groupBy(F.least("component", "component_b").alias("low"), F.greatest("component", "component_b").alias("high"))
    return between.agg(F.min(pair).alias("p")).select("p.a", "p.b")


def _band(n: Column) -> Column:
    return F.floor(F.log(n) * F.lit(BANDS / math.log(DENOMINATOR / NUMERATOR))).cast("int")


def _sides(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries as the smaller and as the larger set of a pair, dealt to cells of bounded size.

    From position p on a set of n shingles has n - p left, so it links with no set larger
    than that overlap allows. As the smaller set it goes to the bands from its own size to
    that one; an entry that cannot link with a set of its own size or more goes to none. As
    the larger set it goes to its own band. A cell of one list and band is left out when
    all its entries are of one component, else cut into a grid.
    """
    rest = F.col("n") - F.col("position")
    most = F.least(
        F.floor(F.lit(DENOMINATOR + NUMERATOR) * rest / F.lit(NUMERATOR)) - F.col("n"), F.floor(F.lit(DENOMINATOR) * F.col("n") / F.lit(NUMERATOR))
    )
    known = lists.select("list", "id", "n", "position", "component", most.alias("most"))
    smaller = known.filter("most >= n").withColumn("band", F.explode(F.sequence(_band(F.col("n")), _band(F.col("most")))))
    smaller = smaller.withColumn("small", F.lit(True))
    larger = known.withColumns({"band": _band(F.col("n")), "small": F.lit(False)})
    both = materialize(smaller.unionByName(larger).drop("most"), "sides")
    cells = both.groupBy("list", "band").agg(
        F.count_if("small").alias("s"), F.count_if(~F.col("small")).alias("l"), F.min("component").alias("c_low"), F.max("component").alias("c_high")
    ).filter("s > 0 AND l > 0 AND c_low <> c_high")
    grid = cells.select("list", "band", F.ceil(F.col("s") / CELL_ROWS).cast("int").alias("rows"), F.ceil(F.col("l") / CELL_ROWS).cast("int").alias("columns"))
    dealt = both.join(grid, ["list", "band"])

    def own(ways: str, name: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(ways)).cast("int").alias(name)

    def every(ways: str, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(ways) - 1)).alias(name)

    columns = ["list", "band", "id", "n", "position", "component"]
    return (
        dealt.filter("small").select(*columns, own("rows", "row"), every("columns", "column")),
        dealt.filter("NOT small").select(*columns, own("columns", "column"), every("rows", "row")),
    )


def _all_pairs(lists: DataFrame) -> DataFrame:
    """Every pair of different components in a list that size and position allow."""
    smaller, larger = _sides(lists)
    x, y = smaller.alias("x"), larger.alias("y")
    most = F.least(F.col("x.n") - F.col("x.position"), F.col("y.n") - F.col("y.position"))
    possible = (
        (F.struct("x.n", "x.id") < F.struct("y.n", "y.id")) & (F.col("x.component") != F.col("y.component"))
        & _may_link(F.col("x.n"), F.col("y.n")) & ((DENOMINATOR + NUMERATOR) * most >= NUMERATOR * (F.col("x.n") + F.col("y.n")))
    )
    cell = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("list", "band", "row", "column")]
    joined = x.join(y, [*cell, possible])
    return joined.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _with_components(frame: DataFrame, components: DataFrame) -> DataFrame:
    """Replace ``component`` by the one that ``components`` gives to the id."""
    return frame.drop("component").join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    A document's set holds its distinct runs of five words (ASCII white space, A-Z
    lower-cased); with fewer words, all of them as one. Documents link when the Jaccard
    similarity is at least 0.75; the component's id is the smallest document id reachable.
    Texts that are null or have no word have no shingle and stand alone, a null id stands
    alone without a component. Rows of one id are one document with the links of each of
    them. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = _texts(docs, doc_id, text)
    signed, counters = _signatures(texts)
    filled = signed.filter("n > 0")
    groups = filled.groupBy("signature").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("bitmap").alias("bitmap"), *[F.min(f"low{k}").alias(f"low{k}") for k in range(LEADERS)])
    reps = materialize(groups, "representatives")
    leader = compare(texts, plausible(_leader_pairs(reps), reps))
    links = leader.filter(_is_link()).select("a", "b")
    components = connected_components(links)
    known = _with_components(reps.select("id", "n"), components)
    # Lists of the same entries are one; the smallest position is that of their first shared shingle.
    entries = _index_lists(texts, known, counters, int(counters.sum())).groupBy("list", "id")
    lists = materialize(entries.agg(*[F.min(c).alias(c) for c in ("n", "position", "component")]), "merged")
    first = compare(texts, plausible(_neighbour_pairs(lists), reps))
    links = links.unionAll(first.filter(_is_link()).select("a", "b"))
    components = connected_components(links)
    open_lists = _with_components(lists, components)
    mixed = open_lists.groupBy("list").agg(F.min("component").alias("l"), F.max("component").alias("h")).filter("l <> h").select("list")
    left = materialize(plausible(_all_pairs(materialize(open_lists.join(mixed, "list"), "mixed")), reps), "left")
    if not left.isEmpty():
        links = links.unionAll(_derived(texts, left, leader.unionAll(first), reps).select("a", "b"))
    # Copies hang on their representative.
    same = filled.join(reps.select("signature", F.col("id").alias("b")), "signature").filter("id <> b").select(F.col("id").alias("a"), "b")
    components = connected_components(links.unionAll(same))
    sizes = signed.select("id", "n")
    return _with_components(sizes, components).select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id")
    ).unionAll(
        docs.filter(F.col(doc_id).isNull()).select(F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("long"))
    )


def _derived(texts: DataFrame, pairs: DataFrame, compared: DataFrame, reps: DataFrame) -> DataFrame:
    """Links among ``pairs``, from what is known of a close set where that decides.

    With x close to L and their overlap known, the overlap of x and y lies between that of
    L and y less what L has beyond x, and that of L and y plus what x has beyond L.
    """
    compared = compared.select("a", "b", "overlap", "n_a", "n_b").dropDuplicates(["a", "b"])
    open_pairs = pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti")
    close = compared.select(F.col("a").alias("x"), F.col("b").alias("close"), "overlap", F.col("n_a").alias("n_x"), F.col("n_b").alias("n_l")).unionAll(
        compared.select("b", "a", "overlap", "n_b", "n_a")
    )
    best = close.groupBy("x").agg(F.max(F.struct("overlap", F.negative("close").alias("order"), "close", "n_x", "n_l")).alias("best"))
    best = best.select(F.col("x").alias("a"), "best.close", F.col("best.overlap").alias("shared"), F.col("best.n_x").alias("n_x"), F.col("best.n_l").alias("n_l"))
    routed = materialize(open_pairs.join(best, "a", "left"), "routed")
    asked = routed.filter("close IS NOT NULL AND close <> b").select(F.least("close", "b").alias("a"), F.greatest("close", "b").alias("b")).distinct()
    # A set of other texts is compared once for all members that are close to it.
    by_leader = compare(texts, asked).select(F.col("a").alias("p"), F.col("b").alias("q"), F.col("overlap").alias("seen"))
    sizes = reps.select(F.col("id").alias("b"), F.col("n").alias("n_y"))
    bounded = routed.withColumns({"p": F.least("close", "b"), "q": F.greatest("close", "b")}).join(by_leader, ["p", "q"], "left").join(sizes, "b")
    total = F.col("n_x") + F.col("n_y")
    least = F.col("seen") - (F.col("n_l") - F.col("shared"))
    most = F.least(F.col("seen") + F.col("n_x") - F.col("shared"), F.col("n_x"), F.col("n_y"))
    whole = DENOMINATOR + NUMERATOR
    verdict = F.when(whole * least >= NUMERATOR * total, F.lit(True)).when(whole * most < NUMERATOR * total, F.lit(False))
    judged = materialize(bounded.select("a", "b", verdict.alias("link")), "judged")
    rest = compare(texts, judged.filter("link IS NULL"))
    return judged.filter("link").select("a", "b").unionAll(rest.filter(_is_link()).select("a", "b"))
