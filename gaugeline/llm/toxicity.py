"""Toxicity scores from bags of subwords averaged into a linear softmax.

A word's vector is the mean of the embeddings of the word and its character n-grams, so
a misspelling that was never seen shares most of its vector with the word. A window of
``WINDOW`` words is averaged and a softmax gives its probability; embeddings and softmax
are trained together in numpy. Labels are of documents, so a document's score is that of
its worst window, and training alternates between finding that window and fitting it.

Training uses a bounded sample: at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled
documents in order of a hash of ``doc_id``, and ``MAX_WINDOWS`` windows of each, spread by
hash over the whole text. Scoring reads every window of every text.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.bytewords import ALNUM, FOLD, find_words, hash_spans, mix, ranges, text_bytes
from gaugeline.llm.support import batches_by_bytes, numbered, ship
from gaugeline.llm.word_cache import WordCache, cache_of

WINDOW = 16
BUCKETS = 1 << 17
MAX_TOXIC, MAX_CLEAN, MAX_WINDOWS = 1000, 2000, 64
SUPPORT, DECAY, FLOOR = 3, 1e-6, 1e-4
_NGRAMS = (3, 4, 5)
# Words of a vocabulary that are cut to subwords at a time; the driver holds their spans several times.
SUBWORDS_OF = 1 << 13


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word: itself and its character n-grams with marked ends; and how many."""
    size = ends - starts
    marked = np.full(int(size.sum()) + 2 * len(size), 0x3E, np.uint8)
    first = np.cumsum(size + 2) - size - 2
    marked[first] = 0x3C
    marked[ranges(first + 1, size)] = data[ranges(starts, size)]
    buckets, owner = [hash_spans(marked, first, first + size + 2)], [np.arange(len(size))]
    for n in _NGRAMS:
        count = np.maximum(size + 2 - n + 1, 0)
        at = ranges(first, count)
        buckets.append(mix(hash_spans(marked, at, at + n) + np.uint64(n)))
        owner.append(np.repeat(np.arange(len(size)), count))
    buckets, owner = np.concatenate(buckets), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (buckets[order] % np.uint64(BUCKETS)).astype(np.int32), np.bincount(owner, minlength=len(size))


def vocabulary_subwords(words: Collection[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``subwords`` of distinct words, a bounded number of them at a time."""
    size = np.array([len(w) for w in words])
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size)
    slices = [slice(i, i + SUBWORDS_OF) for i in range(0, len(size), SUBWORDS_OF)]
    buckets, counts = zip(*(subwords(data, (ends - size)[x], ends[x]) for x in slices))
    return np.concatenate(buckets), np.concatenate(counts)


class SubwordSoftmax:
    def __init__(self, dims: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.name = uuid.uuid4().hex
        self.embedding = rng.uniform(-0.5, 0.5, (BUCKETS, dims)).astype(np.float32) / dims
        self.weights = rng.normal(0, 0.3, (dims, 2)).astype(np.float32)
        self.bias = np.array([1.0, -1.0], np.float32)

    def word_scores(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each word's share of the difference of the two logits, before averaging."""
        gain = (self.embedding @ (self.weights[:, 1] - self.weights[:, 0]))[buckets]
        before = np.zeros(len(gain) + 1)
        np.cumsum(gain, dtype=np.float64, out=before[1:])
        ends = np.cumsum(counts)
        return (before[ends] - before[ends - counts]) / np.maximum(counts, 1)

    def margin(self) -> float:
        return float(self.bias[1] - self.bias[0])

    def fit(self, windows: list[np.ndarray], vocabulary: tuple[np.ndarray, np.ndarray], document: np.ndarray, label: np.ndarray, steps: int = 1600, batch: int = 48, rate: float = 0.3) -> None:
        """``windows`` hold word numbers; ``document`` is each one's document, ``label`` each document's.

        A step takes as many toxic as clean documents. First it draws windows at random, later
        it takes each document's worst window, and of clean ones others too. A toxic document is
        drawn by how toxic its worst window looks, since labels may be wrong. Subwords that
        fewer than ``SUPPORT`` documents hold say nothing and keep a zero vector.
        """
        rng = np.random.default_rng(17)
        buckets, counts = vocabulary
        begin = np.cumsum(counts) - counts
        flat = np.concatenate(windows)
        sizes = np.array([len(w) for w in windows])
        ends = np.cumsum(sizes)
        # Documents per bucket, a few documents at a time: each (document, bucket) once.
        support = np.zeros(BUCKETS, np.int64)
        for low in range(0, len(label), 64):
            own = slice(*np.searchsorted(document, (low, low + 64)))
            words = flat[ends[own][0] - sizes[own][0] : ends[own][-1]]
            pairs = np.unique(np.repeat(document[own], sizes[own]) * len(counts) + words)
            held, words = pairs // len(counts), pairs % len(counts)
            once = np.unique(np.repeat(held, counts[words]) * BUCKETS + buckets[ranges(begin[words], counts[words])])
            support += np.bincount(once % BUCKETS, minlength=BUCKETS)
        weak = support < SUPPORT
        self.embedding[weak] = 0
        square = np.zeros(BUCKETS, np.float32)
        square_w, square_b = np.full_like(self.weights, 1e-2), np.full_like(self.bias, 1e-2)
        first = np.searchsorted(document, np.arange(len(label)))
        number = np.bincount(document, minlength=len(label))
        toxic, clean = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        warm = steps // 5
        for step in range(steps):
            if step % 40 == 0:
                scores = self.word_scores(buckets, counts)
                before = np.concatenate([[0.0], np.cumsum(scores[flat])])
                logit = (before[ends] - before[ends - sizes]) / sizes + self.margin()
                worst = np.lexsort((-logit, document))[first]
                looks = 1 / (1 + np.exp(-np.clip(logit[worst], -30, 30)))
                drawn = np.full(len(toxic), 1.0) if step < warm else np.clip(looks[toxic], 0.02, 1) ** 2
                drawn /= drawn.sum()
            some = np.concatenate([rng.choice(toxic, batch // 2, p=drawn), rng.choice(clean, batch // 2)])
            rows = first[some] + (rng.random(len(some)) * number[some]).astype(np.int64)
            if step >= warm:
                pick = (label[some] == 1) | (rng.random(len(some)) < 0.6)
                rows[pick] = worst[some[pick]]
            word = flat[ranges(ends[rows] - sizes[rows], sizes[rows])]
            window = np.repeat(np.arange(len(rows)), sizes[rows])
            bucket = buckets[ranges(begin[word], counts[word])]
            part = np.repeat(1 / (counts[word] * sizes[rows][window]), counts[word]).astype(np.float32)
            at = np.repeat(window, counts[word])
            used, place = np.unique(bucket, return_inverse=True)
            # How much each subword counts in each window.
            share = np.bincount(at * len(used) + place, part, len(rows) * len(used)).reshape(len(rows), -1).astype(np.float32)
            mean = share @ self.embedding[used]
            logits = mean @ self.weights + self.bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), label[some]] -= 1
            p /= len(rows)
            d_w, d_b, d_mean = mean.T @ p, p.sum(axis=0), p @ self.weights.T
            square_w += d_w**2
            square_b += d_b**2
            self.weights -= 0.1 * d_w / np.sqrt(square_w)
            self.bias -= 0.05 * d_b / np.sqrt(square_b)
            grad = share.T @ d_mean
            grad[weak[used]] = 0
            grad += DECAY * self.embedding[used]
            # A window dilutes a word; the gradient is scaled back, and a floor holds back rare subwords.
            grad *= 6 * WINDOW
            square[used] += (grad**2).mean(axis=1)
            self.embedding[used] -= rate * grad / np.sqrt(square[used] + FLOOR)[:, None]


def _window_best(scores: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """The highest mean of ``width`` neighbouring words of each text (of all words, if fewer; 0 if none)."""
    n = np.diff(first)
    before = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    size = np.minimum(n, width)
    starts = np.where(n > 0, n - size + 1, 0)
    at = ranges(first[:-1], starts)
    owner = np.repeat(np.arange(len(n)), starts)
    mean = (before[at + size[owner]] - before[at]) / np.maximum(size[owner], 1)
    out = np.zeros(len(n))
    some = np.flatnonzero(starts)
    if len(some):
        out[some] = np.maximum.reduceat(mean, (np.cumsum(starts) - starts)[some])
    return out


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", use: Column | None = None
) -> SubwordSoftmax | None:
    """Fit on a bounded sample of labelled documents for which ``use`` (over ``id``) holds.

    Labels other than 0 and 1 and null ids are left out; texts without words give no windows.
    Labels come in order of a hash of the id, ties by id; repeated rows are drawn repeatedly,
    up to the bound of the sample. None without labels of both kinds.
    """
    spark = docs.sparkSession
    ship(spark)
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    marks = marks.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & (F.lit(True) if use is None else use))
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    steps = 1 << 30
    place, chosen = F.pmod(F.xxhash64("id"), F.lit(steps)), None
    for value, most in ((0, MAX_CLEAN), (1, MAX_TOXIC)):
        part = marks.filter((F.col("label") == value) & (place < int(min(1.0, 1.2 * most / counts[value]) * steps))).orderBy(place, "id").limit(most)
        chosen = part if chosen is None else chosen.unionAll(part)

    def cut(batches):
        for batch in batches_by_bytes(batches, "text"):
            data, at = text_bytes(batch.column("text"))
            data = FOLD[data]
            words = find_words(data, at, ALNUM)
            raw = data.tobytes()
            for d, value in enumerate(batch.column("label").to_pylist()):
                heads = np.arange(words.first[d], words.first[d + 1], WINDOW)
                if len(heads) > MAX_WINDOWS:
                    heads = heads[np.argsort(mix(heads.astype(np.uint64)))[:MAX_WINDOWS]]
                spans = [(h, int(min(h + WINDOW, words.first[d + 1]))) for h in heads.tolist()]
                texts = [b" ".join(raw[words.starts[i] : words.ends[i]] for i in range(a, b)) for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array([value], pa.int32()), pa.array([texts], pa.list_(pa.binary()))], names=["label", "windows"])

    # At most MAX_TOXIC + MAX_CLEAN ids, so the sample may be sent to every task.
    joined = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    # Texts are cut before they are gathered.
    cuts = joined.select("label", "text").mapInArrow(cut, "label int, windows array<binary>")
    sample = cuts.limit(2 * (MAX_TOXIC + MAX_CLEAN)).collect()
    sample = sorted(([r["label"], [bytes(w) for w in r["windows"]]] for r in sample if r["windows"]), key=lambda r: (r[0], r[1]))
    target = np.array([r[0] for r in sample])
    if len(set(target.tolist())) < 2:
        return None
    numbers: dict[bytes, int] = {}
    windows = [np.array([numbers.setdefault(x, len(numbers)) for x in w.split(b" ")]) for _, ws in sample for w in ws]
    document = np.repeat(np.arange(len(sample)), [len(ws) for _, ws in sample])
    del sample
    model = SubwordSoftmax()
    model.fit(windows, vocabulary_subwords(numbers), document, target)
    return model


def _judged(docs: DataFrame, model: SubwordSoftmax, text: str, keep: list[str], new: dict[str, Column], clean: bool) -> DataFrame:
    """Each column goes to Python once and under a name of its own; with ``clean`` toxic rows do not come back."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    asked, body, kept = numbered(docs, text, keep)
    schema = asked.select(*kept).withColumns(new).schema

    def judge(batches):
        judge_model = sent.value

        def of_words(data, starts, ends):
            return judge_model.word_scores(*subwords(data, starts, ends))[:, None]

        cache = cache_of(f"toxicity:{judge_model.name}", lambda: WordCache(1, of_words))
        for batch in batches_by_bytes(batches, body):
            data, at = text_bytes(batch.column(body))
            data = FOLD[data]
            words = find_words(data, at, ALNUM)
            scores = cache(data, words.starts, words.ends)[:, 0]
            logit = _window_best(scores, words.first, WINDOW) + judge_model.margin()
            p = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
            columns = [batch.column(c) for c in kept]
            if clean:
                yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(p < 0.5))
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return asked.mapInArrow(judge, schema).toDF(*keep, *new)


def score(docs: DataFrame, model: SubwordSoftmax | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to every row, or to the columns ``keep``.

    Words are runs of letters, digits and non-ASCII characters. A text without words, null
    or empty included, scores as a window of words that say nothing. Without labels of both
    kinds every score is 0. Repeated rows score alike; an empty table gives no rows.
    Columns named like the new ones are replaced.
    """
    ship(docs.sparkSession)
    new = {"score": F.lit(0.0), "predicted": F.lit(0)}
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    if model is None:
        return docs.select(*names).withColumns(new)
    return _judged(docs, model, text, names, new, False)


def without_toxic(docs: DataFrame, model: SubwordSoftmax | None, text: str = "text") -> DataFrame:
    """The rows that ``score`` does not predict toxic, all columns as they are."""
    ship(docs.sparkSession)
    return docs if model is None else _judged(docs, model, text, docs.columns, {}, True)
