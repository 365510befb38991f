"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time and labels every byte
position; a document's probabilities are the mean over the positions of its letters. Texts
are read whole, in windows of ``CORE`` bytes that begin at a character and are read with
``CONTEXT`` bytes more on both sides, so every position is labelled with what stands before
and behind it. Windows of all texts of a batch are read in step, longest first, without
padding.

Training uses a bounded sample: about ``PER_LANGUAGE`` documents of each language, in
order of a hash of ``doc_id``, and ``WINDOWS_PER_DOCUMENT`` windows of ``TRAIN_BYTES``
bytes of each, chosen by hash over the whole text. Every value of the language column is a
label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.bytewords import FOLD, mix, text_bytes
from gaugeline.llm.support import batches_by_bytes, numbered, ship

PER_LANGUAGE = 300
WINDOWS_PER_DOCUMENT = 12
TRAIN_BYTES = 64
# Windows that a training epoch reads, of all languages together.
TRAIN_WINDOWS = 9_000
CORE = 448
CONTEXT = 32
# Windows read in step, and cells of positions by labels held at a time.
WINDOWS = 1024
CELLS = 1 << 22
UNDETERMINED = "und"

LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def windows_of(data: np.ndarray, at: np.ndarray, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of windows, cut where a character begins, and the text each is in."""
    size = np.diff(at)
    number = -(-size // core)
    text = np.repeat(np.arange(len(size)), number)
    starts = at[:-1][text] + core * (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number))
    # At most three bytes back lies the first byte of a character.
    for _ in range(3):
        inside = (data[starts] & 0xC0) == 0x80 if len(starts) else np.zeros(0, bool)
        starts = starts - (inside & (starts > at[:-1][text]))
    ends = np.append(starts[1:], 0)
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    ends[last] = at[1:][text[last]]
    return starts, ends, text


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Direction:
    """One reading direction: gates (update, reset, candidate) side by side in each matrix."""

    def __init__(self, rng, hidden: int, embedding: int):
        self.x = rng.normal(0, 1 / np.sqrt(embedding), (embedding, 3 * hidden)).astype(np.float32)
        self.h = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        self.b = np.zeros(3 * hidden, np.float32)

    def read(self, inputs: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step for ``inputs`` (steps, words, 3 * hidden), already projected."""
        steps, words, wide = inputs.shape
        n = wide // 3
        h = np.zeros((words, n), np.float32)
        states = np.empty((steps, words, n), np.float32)
        for t in range(steps):
            u = h @ self.h
            gates = _sigmoid(inputs[t, :, : 2 * n] + u[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(inputs[t, :, 2 * n :] + r * u[:, 2 * n :])
            if keep is not None:
                keep.append((h, z, r, c, u[:, 2 * n :]))
            h = c + z * (h - c)
            states[t] = h
        return states

    def logits_ragged(self, embedding: np.ndarray, out: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """States times ``out`` (steps, windows, labels) for byte codes (steps, windows), long windows first.

        Gates lie apart, so that every array of a step is contiguous; update and reset are
        kept with the sign changed, ready for the logistic function.
        """
        n, width = len(self.h), codes.shape[1]
        table = embedding @ self.x + self.b
        signs = (-1, -1, 1)
        tables = [np.ascontiguousarray(s * table[:, i * n : (i + 1) * n], np.float32) for i, s in enumerate(signs)]
        mixes = [np.ascontiguousarray(s * self.h[:, i * n : (i + 1) * n], np.float32) for i, s in enumerate(signs)]
        h = np.zeros((width, n), np.float32)
        held = np.empty((4, width, n), np.float32)
        logits = np.zeros((len(codes), width, out.shape[1]), np.float32)
        active = np.searchsorted(-sizes, -np.arange(len(codes)), "left")
        with np.errstate(over="ignore"):
            for t, m in enumerate(active.tolist()):
                own, now = h[:m], codes[t, :m]
                z, r, c, x = held[0, :m], held[1, :m], held[2, :m], held[3, :m]
                for gate, of, mixed in ((z, tables[0], mixes[0]), (r, tables[1], mixes[1])):
                    np.take(of, now, axis=0, out=x, mode="clip")
                    np.matmul(own, mixed, gate)
                    gate += x
                    np.exp(gate, gate)
                    gate += 1
                    np.reciprocal(gate, gate)
                np.matmul(own, mixes[2], c)
                c *= r
                np.take(tables[2], now, axis=0, out=x, mode="clip")
                c += x
                np.tanh(c, c)
                own -= c
                own *= z
                own += c
                np.matmul(own, out, logits[t, :m])
        return logits

    def back(self, d_states: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the projected inputs and of the recurrent matrix."""
        steps, words, n = d_states.shape
        d_inputs, d_h = np.empty((steps, words, 3 * n), np.float32), np.zeros_like(self.h)
        carry = np.zeros((words, n), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, c, uc = kept[t]
            g = d_states[t] + carry
            d_c = g * (1 - z) * (1 - c * c)
            d_z = g * (h - c) * z * (1 - z)
            d_r = d_c * uc * r * (1 - r)
            d_inputs[t] = np.concatenate([d_z, d_r, d_c], axis=1)
            d_u = np.concatenate([d_z, d_r, d_c * r], axis=1)
            d_h += h.T @ d_u
            carry = g * z + d_u @ self.h.T
        return d_inputs, d_h


class ByteTagger:
    """Label probabilities for every byte position."""

    def __init__(self, labels: list[str], hidden: int = 12, embedding: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.embedding = rng.normal(0, 0.5, (256, embedding)).astype(np.float32)
        self.forward, self.backward = Direction(rng, hidden, embedding), Direction(rng, hidden, embedding)
        self.out = rng.normal(0, 0.1, (2 * hidden, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.out, self.bias, *(p for d in (self.forward, self.backward) for p in (d.x, d.h, d.b))]

    def _states(self, runs: np.ndarray, keep: tuple[list, list] | None = None):
        """States of both directions for ``runs`` (words, length), in reading order of the text."""
        steps = runs.T
        a = self.forward.read((self.embedding @ self.forward.x + self.forward.b)[steps], keep and keep[0])
        b = self.backward.read((self.embedding @ self.backward.x + self.backward.b)[steps[::-1]], keep and keep[1])
        return np.concatenate([a, b[::-1]], axis=2)

    def probabilities(self, runs: np.ndarray) -> np.ndarray:
        """(length, words, labels)"""
        logits = self._states(runs) @ self.out + self.bias
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        return p / p.sum(axis=2, keepdims=True)

    def label_windows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the probabilities and the labels of its letters' positions, both summed."""
        k = len(self.labels)
        starts, ends, text = windows_of(data, at, CORE)
        sums, votes = np.zeros((len(at) - 1, k)), np.zeros((len(at) - 1, k))
        first, last = np.maximum(starts - CONTEXT, at[:-1][text]), np.minimum(ends + CONTEXT, at[1:][text])
        order = np.argsort(first - last, kind="stable")
        width = min(WINDOWS, max(16, CELLS // (k * (CORE + 2 * CONTEXT))))
        for i in range(0, len(order), width):
            own = order[i : i + width]
            size, begin = last[own] - first[own], first[own]
            steps, row = np.arange(size[0])[:, None], np.arange(len(own))[None, :]
            codes = data[begin + np.minimum(steps, size - 1)]
            mirrored = np.maximum(size - 1 - steps, 0)
            logits = self.forward.logits_ragged(self.embedding, self.out[: self.hidden], codes, size)
            logits += self.backward.logits_ragged(self.embedding, self.out[self.hidden :], codes[mirrored, row], size)[mirrored, row]
            logits += self.bias
            use = LETTERS[codes] & (begin + steps >= starts[own]) & (begin + steps < ends[own])
            label = logits.argmax(axis=2)
            logits -= logits.max(axis=2, keepdims=True)
            np.exp(logits, logits)
            logits *= (use / logits.sum(axis=2))[:, :, None]
            found = logits.sum(axis=0)
            voted = np.bincount((row * k + label)[use], minlength=len(own) * k).reshape(-1, k)
            np.add.at(sums, text[own], found)
            np.add.at(votes, text[own], voted)
        return sums, votes

    def gradients(self, runs: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        keep: tuple[list, list] = ([], [])
        states = self._states(runs, keep)
        logits = states @ self.out + self.bias
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(len(labels)), labels] -= 1
        p /= p.shape[0] * p.shape[1]
        n, flat = self.hidden, p.reshape(-1, p.shape[2])
        d_out, d_bias = states.reshape(-1, 2 * n).T @ flat, flat.sum(axis=0)
        d_states = p @ self.out.T
        d_embedding, parts = np.zeros_like(self.embedding), []
        for side, d, kept, steps in ((self.forward, d_states[:, :, :n], keep[0], runs.T), (self.backward, d_states[::-1, :, n:], keep[1], runs.T[::-1])):
            d_in, d_h = side.back(d, kept)
            d_in, seen = d_in.reshape(-1, 3 * n), steps.reshape(-1)
            by_byte = np.zeros((256, 3 * n), np.float32)
            np.add.at(by_byte, seen, d_in)
            d_embedding += by_byte @ side.x.T
            parts += [self.embedding.T @ by_byte, d_h, by_byte.sum(axis=0)]
        return [d_embedding, d_out, d_bias, *parts]

    def fit(self, runs: list[bytes], labels: np.ndarray, epochs: int = 5, batch: int = 256, rate: float = 0.01, seed: int = 11) -> None:
        """Adam over batches of runs of one length."""
        rng, size = np.random.default_rng(seed), np.array([len(r) for r in runs])
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(runs))
            groups = []
            for n in np.unique(size):
                own = order[size[order] == n]
                groups += [own[i : i + batch] for i in range(0, len(own), batch)]
            for g in rng.permutation(len(groups)):
                rows = groups[g]
                step += 1
                grads = self.gradients(np.array([list(runs[i]) for i in rows], np.int64), labels[rows])
                norm = np.sqrt(sum(float((x * x).sum()) for x in grads))
                pace = rate * (1 - 0.8 * epoch / epochs) * min(1.0, 5 / max(norm, 1e-9))
                for p, x, (m, v) in zip(self.parameters(), grads, moments):
                    m += 0.1 * (x - m)
                    v += 0.01 * (x * x - v)
                    p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", use: Column | None = None) -> ByteTagger | None:
    """Fit on a bounded sample of the rows where ``use`` (over ``id``) holds and ``lang`` is known.

    Rows with a null text or language are left out, empty texts give no windows. Rows come in
    order of a hash of id and language, ties by id; repeated rows may be drawn repeatedly.
    None without any language.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter((F.lit(True) if use is None else use) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    labels = sorted(counts)
    steps = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 1.2 * PER_LANGUAGE / n) * steps))])
    place = F.pmod(F.xxhash64("id", "lang"), F.lit(steps))

    def cut(batches):
        for batch in batches_by_bytes(batches, "text"):
            data, at = text_bytes(batch.column("text"))
            data = FOLD[data]
            starts, ends, row = windows_of(data, at, TRAIN_BYTES)
            order = np.lexsort((mix(starts.astype(np.uint64) - at[:-1][row].astype(np.uint64)), row))
            rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            order = order[rank < WINDOWS_PER_DOCUMENT]
            edges = np.searchsorted(row[order], np.arange(len(at)))
            values = pa.array([data[starts[i] : ends[i]].tobytes() for i in order], pa.binary())
            kept = [batch.column(c) for c in ("lang", "place", "id")]
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)], names=["lang", "place", "id", "runs"])

    # Texts are cut before they are gathered; the limit is the bound of the sample.
    drawn = rows.withColumn("place", place).filter(F.col("place") < F.element_at(share, F.col("lang")))
    schema = drawn.select("lang", "place", "id", F.array(F.lit(b"")).alias("runs")).schema
    windows = drawn.select("lang", "place", "id", "text").mapInArrow(cut, schema)
    sample = windows.orderBy("place", "id").limit(len(labels) * 2 * PER_LANGUAGE).select("lang", "runs").collect()
    runs = [bytes(x) for r in sample for x in r["runs"]]
    target = np.array([labels.index(r["lang"]) for r in sample for _ in r["runs"]], np.int64)
    model = ByteTagger(labels)
    if runs:
        # Every language has the same share of the training steps.
        most, rng = TRAIN_WINDOWS // len(labels) + 1, np.random.default_rng(3)
        picked = np.concatenate([rng.choice(own, most, replace=len(own) < most) for own in (np.flatnonzero(target == k) for k in range(len(labels))) if len(own)])
        model.fit([runs[i] for i in picked], target[picked])
    return model


def _judged(docs: DataFrame, model: ByteTagger, text: str, keep: list[str], new: dict[str, Column], least: float | None) -> DataFrame:
    """Each column goes to Python once and under a name of its own; rows below ``least`` do not come back."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    asked, body, kept = numbered(docs, text, keep, letter)
    schema = asked.select(*kept).withColumns(new).schema

    def label(batches):
        tagger = sent.value
        k = len(tagger.labels)
        names_of = np.array([*tagger.labels, UNDETERMINED], object)
        for batch in batches_by_bytes(batches, body):
            data, at = text_bytes(batch.column(body))
            sums, votes = tagger.label_windows(FOLD[data], at)
            n, best = sums.sum(axis=1), sums.argmax(axis=1)
            known = batch.column("letters").to_numpy(zero_copy_only=False) & (n > 0)
            row = np.arange(len(best))
            score = np.where(known, np.clip(sums[row, best] / np.maximum(n, 1e-9), 0, 1), 0.0)
            share = np.where(known, votes[row, best] / np.maximum(votes.sum(axis=1), 1), 0.0)
            columns = [batch.column(c) for c in kept]
            if least is None:
                columns += [pa.array(names_of[np.where(known, best, k)], pa.string()), pa.array(score), pa.array(share)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            else:
                yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(known & (score >= least)))

    return asked.mapInArrow(label, schema).toDF(*keep, *new)


def identify(docs: DataFrame, model: ByteTagger | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``lang_share`` to every row, or to the columns ``keep``.

    ``score`` is the pooled probability of the predicted language, ``lang_share`` the part
    of all letters' positions whose own label it is. A text that is null or has no letter gets
    ``und`` and 0, as does every text when there was nothing to learn from. Ties go to the
    language first in order. Repeated rows are judged alike; an empty table gives no rows.
    Columns named like the new ones are replaced.
    """
    ship(docs.sparkSession)
    new = {"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0), "lang_share": F.lit(0.0)}
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    if model is None:
        return docs.select(*names).withColumns({**new, "lang_pred": F.lit(UNDETERMINED)})
    return _judged(docs, model, text, names, new, None)


def with_language(docs: DataFrame, model: ByteTagger | None, least: float, text: str = "text") -> DataFrame:
    """The rows whose language is told with a score of at least ``least``, all columns as they are."""
    ship(docs.sparkSession)
    return docs.limit(0) if model is None else _judged(docs, model, text, docs.columns, {}, least)
