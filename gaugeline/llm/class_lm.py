"""Language-model scores from Brown class-based bigrams.

P(word | word before) = P(class | class before) * P(word | class). A unit is a word with at
least ``SUPPORT`` training tokens, or all rarer words that share a hash of their last bytes,
so every word has a class and all training tokens count. Bigrams of all units are counted
by Spark and laid out by unit, once with the units behind and once with the units before.
The most frequent units open the classes; then, in rounds, every unit goes to the class that
fits its own counts of neighbour classes best, its own share left out, and a round stands
only if the likelihood of the class bigrams grows. Units and classes (the square root of
the units) grow with the corpus; the driver holds some bytes for each unit, not for each
bigram. Class transitions are interpolated with class frequencies (Witten-Bell), and words
within a class are discounted to leave room for words never seen, which count as one event
per class.

Texts are split once. A shard row holds a bounded run of documents as numbers into its own
list of words; only counts of distinct words per shard travel, packed by hash range, and
come back as corpus counts in the order of the shard's list.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.bytewords import FOLD, NOT_SPACE, find_words, hash_spans, mix, text_bytes
from gaugeline.llm.support import batches_by_bytes, materialize, ship, shuffle_parts

SUPPORT = 5
ENDINGS = 512
# At least so many classes.
CLASSES = 48
# Half of the units may move in a round.
ROUNDS = 8
# Pairs that a task adds up before it sends them.
PAIRS = 2 << 20
# Cells of units by classes that a task works on at a time.
CELLS = 1 << 20
SHARD_BYTES = 8 << 20
_SHARD = "shard string, doc_ids binary, null_ids binary, trains binary, counts binary, codes binary, hashes binary, endings binary, part int, words binary, trained binary, ends long"


def _pack(numbers: np.ndarray, rising: bool = False) -> bytes:
    """Numbers (``rising``: their differences) byte plane by byte plane, compressed."""
    numbers = numbers.astype(np.int64)
    numbers = np.diff(numbers, prepend=np.int64(0)) if rising else numbers
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T)
    return len(numbers).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def _unpack(packed: bytes, rising: bool = False) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed[8:], 8 * n, asbytes=True), np.uint8)
    numbers = np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel()
    return np.cumsum(numbers) if rising else numbers


def _shards(docs: DataFrame, train: Column, doc_id: str, text: str) -> DataFrame:
    """Written shards, each with one row of documents and one row per hash range of its words."""
    only = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    names = [x.split()[0] for x in _SHARD.split(", ")]
    bits = range_bits(docs.sparkSession)

    def split(batches):
        for batch in batches_by_bytes(batches, "text", SHARD_BYTES):
            data, at = text_bytes(batch.column("text"))
            data = FOLD[data]
            words = find_words(data, at, NOT_SPACE)
            hashes = hash_spans(data, words.starts, words.ends)
            codes, distinct = pd.factorize(hashes)
            first = np.empty(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            # The list of a shard's words is in hash order, so that hash ranges are slices of it.
            order = np.argsort(distinct)
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            codes, distinct, first = number[codes], distinct[order], first[order]
            tail = np.minimum(words.ends[first] - words.starts[first], 3)
            endings = (mix(hash_spans(data, words.ends[first] - tail, words.ends[first])) % np.uint64(ENDINGS)).astype(np.uint16)
            train = batch.column("train").to_numpy(zero_copy_only=False)
            trained = np.bincount(codes[train[words.text()]], minlength=len(distinct)).astype(np.int64)
            ids, shard = batch.column("doc_id"), uuid.uuid4().hex
            whole = [
                ids.fill_null(0).to_numpy().astype(np.int64), np.array(ids.is_null().to_numpy(zero_copy_only=False), np.uint8), train.astype(np.uint8),
                words.counts().astype(np.int64),
            ]
            rows = [[shard, *(a.tobytes() for a in whole), _pack(codes), _pack(distinct, True), endings.tobytes(), None, None, None, int(train.sum())]]
            cuts = np.searchsorted(distinct >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
            for part in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[part], cuts[part + 1])
                rows.append([shard, *[None] * 7, part, np.rec.fromarrays([distinct[own], endings[own]]).tobytes(), trained[own].tobytes(), None])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _arrow(_SHARD))], names=names)

    return materialize(only.mapInArrow(split, _SHARD), "lm-shards")


def range_bits(spark) -> int:
    """Hash ranges grow with the number of shuffle partitions, which grows with the data."""
    return max(8, (4 * shuffle_parts(spark)).bit_length())


def _arrow(schema: str) -> list[pa.Field]:
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return [pa.field(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]


_WORD = np.dtype([("hash", "<u8"), ("ending", "<u2")])


def _corpus_counts(shards: DataFrame) -> DataFrame:
    """Per shard and hash range the corpus counts of the shard's words; and per range those of support.

    A range is a share of all hashes, whatever words are frequent: each shard sends a word once.
    """

    def count(key, table):
        packed = [np.frombuffer(x.as_py(), _WORD) for x in table.column("words")]
        trained = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("trained")])
        words = np.concatenate(packed)
        codes, distinct = pd.factorize(words["hash"])
        total = np.bincount(codes, trained, len(distinct)).astype(np.int64)
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        ending = words["ending"][first]
        at = np.concatenate([[0], np.cumsum([len(p) for p in packed])])
        back = total[codes]
        top = np.flatnonzero(total >= SUPPORT)
        top = top[np.argsort(distinct[top])]
        n = table.num_rows
        out = {
            "shard": table.column("shard").to_pylist() + [None], "part": [key[0].as_py()] * (n + 1),
            "counts": [back[at[i] : at[i + 1]].tobytes() for i in range(n)] + [None],
            "top": [None] * n + [distinct[top].tobytes()], "top_n": [None] * n + [total[top].tobytes()], "top_endings": [None] * n + [ending[top].tobytes()],
            "seen": [None] * n + [int((total > 0).sum())], "tokens": [None] * n + [int(total.sum())],
            "ending_counts": [None] * n + [np.stack([np.bincount(ending, w, ENDINGS) for w in (total, total > 0, total == 1, total == 2)]).astype(np.int64).tobytes()],
        }
        return pa.Table.from_arrays([pa.array(out[f.name], f.type) for f in _arrow(_COUNTS)], names=list(out))

    return materialize(shards.filter("part IS NOT NULL").select("shard", "part", "words", "trained").groupBy("part").applyInArrow(count, _COUNTS), "lm-counts")


_COUNTS = "shard string, part int, counts binary, top binary, top_n binary, top_endings binary, seen long, tokens long, ending_counts binary"


@dataclass
class ClassModel:
    """Words of support (sorted hashes) and the class of every unit; all logarithms to base 10."""

    core: np.ndarray
    core_unit: np.ndarray
    unit_class: np.ndarray
    transition: np.ndarray
    class_tokens: np.ndarray
    class_types: np.ndarray
    discount: float
    tokens: int
    types: int
    ends: int


def units_of(core: np.ndarray, core_unit: np.ndarray, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
    unit = len(core) + endings.astype(np.int64)
    if len(core):
        place = np.minimum(np.searchsorted(core, hashes), len(core) - 1)
        hit = core[place] == hashes
        unit[hit] = core_unit[place[hit]]
    return unit


def _arrays(batch: pa.RecordBatch, k: int, **kinds):
    """Arrays of a row: of a type, or packed (``False``), or packed as rising numbers (``True``)."""
    values = ((batch.column(name)[k].as_py(), kind) for name, kind in kinds.items())
    return [_unpack(value, kind) if isinstance(kind, bool) else np.frombuffer(value, kind) for value, kind in values]


def _steps(counts: np.ndarray, units: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of all texts one after the other, an end behind each; and where each text begins."""
    at = np.concatenate([[0], np.cumsum(counts)])
    return np.insert(units, at[1:], end), at + np.arange(len(at))


def _by_unit(keys: np.ndarray, n_units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of rising pair keys, how many pairs each has, and the other unit of every pair."""
    unit = keys // n_units
    starts = np.flatnonzero(np.diff(unit, prepend=-1))
    return unit[starts], np.diff(np.append(starts, len(unit))), keys - unit * n_units


_PAIRS = "part int, side int, keys binary, n binary"
_NEIGHBOURS = "part int, right binary, right_n binary, left binary, left_n binary"
_TABLE = "cells binary, n binary"
_MOVES = "units binary, best binary, right binary, left binary"


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their sums."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _dealt(by: np.ndarray, bits: int, *columns: np.ndarray):
    """Slices of the columns by hash range of ``by``, with the number of the range."""
    part = (mix(by.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange((1 << bits) + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[k] : cuts[k + 1]]
        yield k, *(c[own] for c in columns)


def _records(schema: str, rows: list[list]) -> pa.RecordBatch:
    fields = _arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], names=[f.name for f in fields])


def unit_spread(unit_tokens: np.ndarray, ranges: int) -> np.ndarray:
    """Over how many ranges the neighbours of each unit are dealt, by its share of all tokens.

    A unit with more tokens than a range has on average is split, so that no range depends
    on how frequent a word is; all units together make at most twice as many shares as there
    are ranges besides one share for each unit.
    """
    return np.maximum(1, np.ceil(unit_tokens * (ranges / max(1.0, float(unit_tokens.sum()))))).astype(np.int32)


def _unit_bigrams(documents: DataFrame, core: np.ndarray, spread: np.ndarray) -> DataFrame:
    """Written bigram counts of all units, by range of the unit whose neighbours they are.

    A task adds up the pairs of its shards, then sends each twice: to a range of the unit
    before and to one of the unit behind. A range holds all neighbours of its units, or the
    share that a hash of the neighbour gives it for units with a ``spread`` above one.
    """
    spark = documents.sparkSession
    n_units, bits = len(core) + ENDINGS + 1, range_bits(spark)
    sent = spark.sparkContext.broadcast((core, spread))

    def dealt(keys, n):
        of = sent.value[1]
        rows = []
        for side in (0, 1):
            unit, other = keys // n_units, keys % n_units
            share = mix(other.astype(np.uint64)).astype(np.int64) & 0x7FFFFFFF
            rows += [[part, side, _pack(a, True), _pack(c)] for part, a, c in _dealt(unit + n_units * (share % of[unit]), bits, keys, n)]
            keys = other * n_units + unit
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
        return _records(_PAIRS, rows)

    def pairs(batches):
        core, held, size = sent.value[0], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                trains, n, codes, hashes, endings = _arrays(batch, k, trains=np.uint8, counts=np.int64, codes=False, hashes=True, endings=np.uint16)
                unit = units_of(core, np.arange(len(core)), hashes.view(np.uint64), endings)[codes]
                use = trains.astype(bool)
                stream, _ = _steps(n[use], unit[np.repeat(use, n)], n_units - 1)
                if not len(stream):
                    continue
                held.append(np.unique(np.concatenate([[n_units - 1], stream[:-1]]) * n_units + stream, return_counts=True))
                size += len(held[-1][0])
                if size >= PAIRS:
                    yield dealt(*_sums(*(np.concatenate(x) for x in zip(*held))))
                    held, size = [], 0
        if held:
            yield dealt(*_sums(*(np.concatenate(x) for x in zip(*held))))

    def lay(key, table):
        side, row = table.column("side").to_numpy(), [key[0].as_py()]
        for s in (0, 1):
            own = table.filter(pa.array(side == s))
            keys, n = (np.concatenate([np.zeros(0, np.int64), *(_unpack(x.as_py(), c == "keys") for x in own.column(c))]) for c in ("keys", "n"))
            keys, n = _sums(keys, n)
            row += [_pack(keys, True), _pack(n)]
        return pa.Table.from_batches([_records(_NEIGHBOURS, [row])])

    sides = documents.select("trains", "counts", "codes", "hashes", "endings").mapInArrow(pairs, _PAIRS)
    # Packed rows look small; a fixed number of files lets every core read in each round.
    laid = sides.repartition(shuffle_parts(spark), "part").groupBy("part").applyInArrow(lay, _NEIGHBOURS)
    return materialize(laid, "lm-neighbours")


def _class_table(neighbours: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """Bigram counts of classes, by those units that have one."""
    sent, n_units = neighbours.sparkSession.sparkContext.broadcast(of), len(of)

    def count(batches):
        of, total = sent.value, np.zeros(classes**2, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                keys, n = _arrays(batch, k, right=True, right_n=False)
                units, sizes, other = _by_unit(keys, n_units)
                one, two = np.repeat(of[units], sizes), of[other]
                use = (one >= 0) & (two >= 0)
                # Sums of counts below 2**53 are exact in doubles.
                total += np.bincount(one[use] * classes + two[use], n[use], classes**2).astype(np.int64)
        cells = np.flatnonzero(total)
        yield _records(_TABLE, [[cells.tobytes(), total[cells].tobytes()]])

    def add(batches):
        total = np.zeros(classes**2, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                cells, n = _arrays(batch, k, cells=np.int64, n=np.int64)
                total[cells] += n
        cells = np.flatnonzero(total)
        yield _records(_TABLE, [[cells.tobytes(), total[cells].tobytes()]])

    # Tables of the tasks are added up in a few tasks, then in one; one table comes here.
    added = neighbours.select("right", "right_n").mapInArrow(count, _TABLE).repartition(8).mapInArrow(add, _TABLE)
    row = added.coalesce(1).mapInArrow(add, _TABLE).first()
    table = np.zeros(classes**2, np.int64)
    if row is not None:
        table[np.frombuffer(row["cells"], np.int64)] = np.frombuffer(row["n"], np.int64)
    sent.destroy()
    return table.reshape(classes, classes)


def _likelihood(table: np.ndarray) -> float:
    return sum(float((x * np.log(np.maximum(x, 1e-12))).sum()) * sign for x, sign in ((table, 1), (table.sum(axis=0), -1), (table.sum(axis=1), -1)))


def best_classes(right: np.ndarray, left: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Best class of units by counts (unit, class) behind and before them; the last class takes none.

    ``own`` is the present class or -1; what a unit adds to its own class is left out.
    """
    soft, classes = 0.1, len(table)
    logs, starts, ends = np.log(table + soft), table.sum(axis=1), table.sum(axis=0)
    n_right, n_left = right.sum(axis=1), left.sum(axis=1)
    behind_of, before_of = np.log(starts + soft * classes), np.log(ends + soft * classes)
    # Single precision: this product is most of the work, and a round only stands if the
    # likelihood, which is counted exactly, grows.
    single = np.float32
    score = right.astype(single) @ (logs - behind_of[:, None]).T.astype(single)
    score += left.astype(single) @ (logs - before_of[None, :]).astype(single)
    has = np.flatnonzero(own >= 0)
    if len(has):
        o, r, l = own[has], right[has], left[has]
        behind, before = table[o] - r, table[:, o].T - l
        d = np.arange(len(has))
        behind[d, o] -= l[d, o]
        before[d, o] -= r[d, o]
        alone = (r * np.log(np.maximum(behind, 0) + soft)).sum(axis=1) + (l * np.log(np.maximum(before, 0) + soft)).sum(axis=1)
        alone -= n_right[has] * np.log(np.maximum(starts[o] - n_right[has], 0) + soft * classes)
        score[has, o] = alone - n_left[has] * np.log(np.maximum(ends[o] - n_left[has], 0) + soft * classes)
    score[:, -1] = -np.inf
    return score.argmax(axis=1)


def _moves(neighbours: DataFrame, of: np.ndarray, table: np.ndarray, spread: np.ndarray, turn: int | None) -> np.ndarray:
    """Classes after every unit of a half (or each unit without a class) went to its best one.

    A task finds the best class of a unit that lies whole in its range. The shares of a split
    unit are added up here: at most twice as many rows of classes as there are ranges.
    """
    sent, n_units, classes = neighbours.sparkSession.sparkContext.broadcast((of, table.astype(float), spread > 1)), len(of), len(table)

    def move(batches):
        of, table, split = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                right, right_n, left, left_n = _arrays(batch, k, right=True, right_n=False, left=True, left_n=False)
                sides = []
                for keys, n in ((right, right_n), (left, left_n)):
                    owners, sizes, other = _by_unit(keys, n_units)
                    sides.append((owners, sizes, of[other], n))
                units = np.union1d(sides[0][0], sides[1][0])
                free = of[units] < 0 if turn is None else mix(units.astype(np.uint64) + np.uint64(turn >> 1)) % np.uint64(2) == turn % 2
                units = units[free & (units != n_units - 1)]
                step = max(1, CELLS // classes)
                for parts, own in ((False, units[~split[units]]), (True, units[split[units]])):
                    for at in range(0, len(own), step):
                        some, counts = own[at : at + step], []
                        for owners, sizes, of_other, n in sides:
                            place = np.minimum(np.searchsorted(some, owners), len(some) - 1)
                            place = np.repeat(np.where(some[place] == owners, place, -1), sizes)
                            use = (place >= 0) & (of_other >= 0)
                            counts.append(np.bincount(place[use] * classes + of_other[use], n[use], len(some) * classes).reshape(-1, classes))
                        if parts:
                            yield _records(_MOVES, [[some.tobytes(), None, *(_pack(c.ravel()) for c in counts)]])
                        else:
                            best = best_classes(*counts, of[some], table).astype(np.int64)
                            yield _records(_MOVES, [[some.tobytes(), best.tobytes(), None, None]])

    new, shares = of.copy(), {}
    for row in neighbours.drop("part").mapInArrow(move, _MOVES).collect():
        units = np.frombuffer(row["units"], np.int64)
        if row["best"] is not None:
            new[units] = np.frombuffer(row["best"], np.int64)
            continue
        both = np.stack([_unpack(row[c]).reshape(len(units), classes) for c in ("right", "left")], axis=1)
        for u, counts in zip(units.tolist(), both):
            shares[u] = shares[u] + counts if u in shares else counts
    if shares:
        units = np.array(sorted(shares))
        right, left = np.stack([shares[u] for u in units.tolist()], axis=1).astype(float)
        new[units] = best_classes(right, left, of[units], table.astype(float))
    sent.destroy()
    return new


def cluster(neighbours: DataFrame, weight: np.ndarray, spread: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit, the last unit (the end of a text) alone in the last class; and the class bigrams."""
    of = np.full(len(weight), -1, np.int64)
    seeds = np.argsort(-weight[:-1], kind="stable")[: classes - 1]
    of[seeds], of[-1] = np.arange(len(seeds)), classes - 1
    of = _moves(neighbours, of, _class_table(neighbours, of, classes), spread, None)
    table = _class_table(neighbours, of, classes)
    idle = 0
    for turn in range(ROUNDS):
        new = _moves(neighbours, of, table, spread, turn)
        changed = _class_table(neighbours, new, classes) if (new != of).any() else table
        if _likelihood(changed) > _likelihood(table):
            of, table, idle = new, changed, 0
        else:
            idle += 1
            if idle == 2:
                break
    # Units without training tokens are in no bigram.
    return np.maximum(of, 0), table


def learn(documents: DataFrame, counts: DataFrame) -> ClassModel:
    core, core_n, core_endings, tokens, types = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
    ending_counts = np.zeros((4, ENDINGS), np.int64)
    # One row for each of the hash ranges, in their order, so that all words are in hash order.
    for row in counts.filter("top IS NOT NULL").select("part", "top", "top_n", "top_endings", "seen", "tokens", "ending_counts").orderBy("part").collect():
        core.append(np.frombuffer(row["top"], np.uint64))
        core_n.append(np.frombuffer(row["top_n"], np.int64))
        core_endings.append(np.frombuffer(row["top_endings"], np.uint16).astype(np.int64))
        tokens, types = tokens + row["tokens"], types + row["seen"]
        ending_counts += np.frombuffer(row["ending_counts"], np.int64).reshape(4, ENDINGS)
    core, core_n, core_endings = np.concatenate(core), np.concatenate(core_n), np.concatenate(core_endings)
    ends = documents.agg(F.sum("ends")).first()[0] or 0
    # Per class: tokens, and the mass its seen words leave to unseen ones.
    rest_tokens, rest_types, once, twice = ending_counts.astype(float)
    rest_tokens = rest_tokens - np.bincount(core_endings, core_n, ENDINGS)
    rest_types = rest_types - np.bincount(core_endings, minlength=ENDINGS)
    unit_tokens = np.concatenate([core_n, rest_tokens, [ends]])
    unit_types = np.concatenate([np.ones(len(core_n)), rest_types, [float(ends > 0)]])
    classes = max(CLASSES, int(len(core) ** 0.5))
    spread = unit_spread(unit_tokens, 1 << range_bits(documents.sparkSession))
    of, table = cluster(_unit_bigrams(documents, core, spread), unit_tokens, spread, classes)
    class_n, kinds = table.sum(axis=0), (table > 0).sum(axis=1)
    lower = (class_n + 1) / (class_n.sum() + classes)
    before = table.sum(axis=1)
    transition = np.log10((table + kinds[:, None] * lower[None, :] + 1e-9 * lower[None, :]) / (before + kinds + 1e-9)[:, None])
    class_tokens, class_types = np.bincount(of, unit_tokens, classes), np.bincount(of, unit_types, classes)
    discount = min(0.95, max(0.05, once.sum() / max(once.sum() + 2 * twice.sum(), 1)))
    return ClassModel(core, np.arange(len(core)), of, transition, class_tokens, class_types, discount, tokens + ends, types + (1 if ends else 0), ends)


def train_and_score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every text by a model learnt from those where ``train`` holds.

    A text is its words (runs between ASCII white space, A-Z lower-cased) and one end.
    Returns ``doc_id``, ``trained``, ``n_tokens``, ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score`` (add-one unigram), ``score`` (class bigrams) and
    ``perplexity``. A null or empty text is an end only; repeated rows count and score
    each; without training rows only unseen events remain. An empty table gives no rows.
    Other columns are ignored.
    """
    ship(docs.sparkSession)
    shards = _shards(docs, train, doc_id, text)
    counts = _corpus_counts(shards)
    documents = shards.filter("part IS NULL")
    model = learn(documents, counts)
    back = counts.filter("shard IS NOT NULL").groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("part", "counts"))).alias("back"))
    rows = documents.select("shard", "doc_ids", "null_ids", "trains", F.col("counts").alias("n"), "codes", "hashes", "endings")
    joined = rows.join(back, "shard", "left").select(*rows.columns[1:], F.col("back.counts").alias("back"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return joined.mapInArrow(lambda batches: _score(batches, shared.value), _SCORES)


_SCORES = "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _score(batches, model: ClassModel):
    names = [x.split()[0] for x in _SCORES.split(", ")]
    end_class = int(model.unit_class[-1])
    for batch in batches:
        for k in range(batch.num_rows):
            ids, null_ids, trains, n, codes, hashes, endings = _arrays(
                batch, k, doc_ids=np.int64, null_ids=np.uint8, trains=np.uint8, n=np.int64, codes=False, hashes=True, endings=np.uint16
            )
            back = batch.column("back")[k].as_py()
            count = np.concatenate([np.frombuffer(b, np.int64) for b in back]) if back else np.zeros(0, np.int64)
            # Each distinct word, then the end as one more.
            count = np.append(count, model.ends)
            of = np.append(model.unit_class[units_of(model.core, model.core_unit, hashes.view(np.uint64), endings)], end_class)
            seen = count > 0
            share = np.where(seen, count - model.discount, model.discount * model.class_types[of] + 1) / (model.class_tokens[of] + 1)
            emission, base = np.log10(share), np.log10((count + 1) / (model.tokens + model.types + 1))
            stream, at = _steps(n, codes.astype(np.int64), len(count) - 1)
            classes = of[stream]
            before = np.concatenate([[end_class], classes[:-1]])
            first = at[:-1]

            def total(values, first=first):
                return np.add.reduceat(values, first) if len(first) else np.zeros(0)

            size = n + 1
            score = total(emission[stream] + model.transition[before, classes])
            columns = [
                pa.array(ids, mask=null_ids.astype(bool)), pa.array(trains.astype(bool)), pa.array(size), pa.array(total(seen[stream].astype(np.int64))),
                pa.array(np.full(len(n), model.tokens)), pa.array(total(base[stream])), pa.array(score), pa.array(10 ** np.minimum(-score / size, 300)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)
