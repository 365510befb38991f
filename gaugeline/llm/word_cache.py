"""Per-word results that a worker keeps between batches and tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from gaugeline.llm.bytewords import hash_spans

CACHE_WORDS = 2_000_000


class WordCache:
    """Rows of numbers for distinct words; ``compute(data, starts, ends)`` gives those of new words."""

    def __init__(self, width: int, compute: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]):
        self.width, self.compute = width, compute
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros((0, width), np.float32)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros((0, self.width), np.float32)
        codes, distinct = pd.factorize(hash_spans(data, starts, ends))
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        place = np.searchsorted(self.keys, distinct)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == distinct[known]
        missing = np.flatnonzero(~known)
        if len(missing):
            if len(self.keys) + len(missing) > CACHE_WORDS:
                self.keys, self.rows = self.keys[:0], self.rows[:0]
                missing = np.arange(len(distinct))
            rows = self.compute(data, starts[first[missing]], ends[first[missing]]).astype(np.float32)
            keys = np.concatenate([self.keys, distinct[missing]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.rows = keys[order], np.concatenate([self.rows, rows])[order]
            place = np.searchsorted(self.keys, distinct)
        return self.rows[place][codes]


_caches: dict[str, WordCache] = {}


def cache_of(name: str, make: Callable[[], WordCache]) -> WordCache:
    """The worker's cache of a model; that of another model gives way."""
    if name not in _caches:
        kind = name.split(":")[0]
        for other in [n for n in _caches if n.split(":")[0] == kind]:
            del _caches[other]
        _caches[name] = make()
    return _caches[name]
