"""Words of many texts at once, found and hashed in numpy over the UTF-8 bytes of an Arrow column.

All separators used in this package are ASCII, and no byte of a multi-byte UTF-8
character is ASCII, so bytes can be classed one by one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
# Digits, lower-case letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_LONG = 1024


@dataclass
class Words:
    """Spans of words; ``first[d]:first[d + 1]`` are those of text ``d``."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self) -> np.ndarray:
        """The text each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text begins; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def find_words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> Words:
    """Longest runs of bytes for which ``inside`` holds, never across two texts."""
    mask = inside[data]
    opens = mask.copy()
    opens[1:] &= ~mask[:-1]
    closes = mask.copy()
    closes[:-1] &= ~mask[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = mask[edges]
    closes[edges - 1] = mask[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(starts, ends, np.searchsorted(starts, at))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, eight bytes at a step; very long spans take a digest."""
    size = ends - starts
    out = size.astype(np.uint64) * _K1
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))

    def fold(h, at, left):
        h = (h ^ (lanes[at] & _KEEP[np.minimum(left, 8)])) * _K2
        h ^= h >> np.uint64(29)
        h *= _K3
        return h ^ (h >> np.uint64(32))

    out = fold(out, starts, size)
    live, step = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(live):
        out[live] = fold(out[live], starts[live] + step, size[live] - step)
        step += 8
        live = live[size[live] > step]
    for i in np.flatnonzero(size > _LONG):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, np.uint64)[0]
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of a hash over all bits."""
    h = (h ^ (h >> np.uint64(33))) * _K2
    h = (h ^ (h >> np.uint64(29))) * _K3
    return h ^ (h >> np.uint64(32))


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` neighbours in a row of hashes; ``len(hashes) - n + 1`` values."""
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = out * _K1 + hashes[k : len(hashes) - n + 1 + k]
        out ^= out >> np.uint64(31)
    return mix(out)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0]+1, ...`` for ``sizes[0]`` values, then those of the next, in one array."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)
