"""Exact token ids of whole texts, each distinct unit of a text being encoded once.

A unit ends where no tokenizer of this package can put one token across:

* ``FileEncoder`` (tokenizers library): its pre-tokenizers cut between a letter and a
  digit, a letter or digit and ASCII punctuation, and before white space. A unit never
  ends after an apostrophe (contractions), nor next to a character whose class the
  bytes do not show; such neighbours stay in one unit. A text that holds a special
  token's string is one unit.
* ``PieceCounter`` (sentencepiece): no piece of the model holds a space after another
  character, which is verified when the model is loaded, so a unit is spaces with the
  word behind them. Control characters that are in no piece begin a unit as well.

A worker keeps what it has encoded between batches and tasks, up to ``CACHE_UNITS``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from gaugeline.llm.bytewords import FOLD, SPACE, hash_spans, ranges

CACHE_UNITS = 2_000_000
JOIN_UNITS = 512

_SPACE, _LETTER, _DIGIT, _PUNCT, _APOSTROPHE, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _PUNCT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x27] = _APOSTROPHE
_CLASS[SPACE] = _SPACE
_CUT = np.zeros((6, 6), bool)
_CUT[[_LETTER, _DIGIT, _PUNCT, _APOSTROPHE], _SPACE] = True
for _a, _b in ((_LETTER, _DIGIT), (_LETTER, _PUNCT), (_DIGIT, _PUNCT)):
    _CUT[_a, _b] = _CUT[_b, _a] = True
_CUT[[_LETTER, _DIGIT], _APOSTROPHE] = True


def _spans(at: np.ndarray, cut: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans between the marked bytes (a mark is a start), with every text's start marked."""
    begins = at[:-1][np.diff(at) > 0]
    cut[begins] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], size), np.searchsorted(starts, at)


class _Units:
    """Encodes units it has not seen and remembers the ids."""

    def __init__(self):
        self.keys, self.at, self.size, self.ids = (np.zeros(0, d) for d in (np.uint64, np.int64, np.int64, np.int32))

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list]:
        raise NotImplementedError

    def look_up(self, data, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each unit."""
        codes, distinct = pd.factorize(hash_spans(data, starts, ends))
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        place = np.searchsorted(self.keys, distinct)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == distinct[known]
        missing = np.flatnonzero(~known)
        if len(missing):
            if len(self.keys) + len(missing) > CACHE_UNITS:
                self.__init__(*self.arguments)
                missing = np.arange(len(distinct))
            size, ids = self.encode(data, starts[first[missing]], ends[first[missing]])
            at = len(self.ids) + np.cumsum(size) - size
            keys = np.concatenate([self.keys, distinct[missing]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.at = np.concatenate([self.at, at])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.ids = np.concatenate([self.ids, ids])
            place = np.searchsorted(self.keys, distinct)
        return self.at[place][codes], self.size[place][codes]


class FileEncoder(_Units):
    """Ids of a tokenizers file, without added special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.arguments = (path,)
        self.tokenizer = Tokenizer.from_file(path)
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items()]
        self.special = [text.encode() for text, _ in special]
        self.separator, self.separator_id = special[0]
        import json

        # A normalizer that lower-cases lets units differing in ASCII case be one.
        self.folds = "Lowercase" in json.dumps(json.loads(self.tokenizer.to_str()).get("normalizer"))

    def units(self, data, at):
        kind = _CLASS[data]
        # U+00C0 to U+00FF are letters but for the two signs of multiplication and division.
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        cut = np.zeros(len(data), bool)
        cut[1:] = _CUT[kind[:-1], kind[1:]]
        if len(lead):
            cut[lead + 1] = False
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            for d in range(len(at) - 1):
                if any(s in raw[at[d] : at[d + 1]] for s in self.special):
                    cut[at[d] : at[d + 1]] = False
            return _spans(at, cut, len(data)), data
        return _spans(at, cut, len(data)), FOLD[data] if self.folds else data

    def encode(self, data, starts, ends):
        raw = data.tobytes()
        texts = [raw[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist())]
        size, ids = np.zeros(len(texts), np.int64), []
        plain = [i for i, t in enumerate(texts) if not any(s.decode() in t for s in self.special)]
        odd = sorted(set(range(len(texts))) - set(plain)) if len(plain) < len(texts) else []
        order = np.array(plain + odd, np.int64)
        for first in range(0, len(plain), JOIN_UNITS):
            part = plain[first : first + JOIN_UNITS]
            joined = self.separator.join([texts[i] for i in part])
            got = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
            edges = np.flatnonzero(got == self.separator_id)
            size[part] = np.diff(np.concatenate([[-1], edges, [len(got)]])) - 1
            ids.append(np.delete(got, edges))
        for i in odd:
            got = np.array(self.tokenizer.encode_batch_fast([texts[i]], add_special_tokens=False)[0].ids, np.int32)
            size[i] = len(got)
            ids.append(got)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        if odd:
            begins = np.empty(len(texts), np.int64)
            begins[order] = np.cumsum(size[order]) - size[order]
            flat = flat[ranges(begins, size)]
        return size, flat

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where those of each text begin."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        (starts, ends, first), data = self.units(data, at)
        place, size = self.look_up(data, starts, ends)
        before = np.concatenate([[0], np.cumsum(size)])
        return self.ids[ranges(place, size)], before[first]


class PieceCounter(_Units):
    """Numbers of pieces of a sentencepiece model, without begin and end."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.arguments = (path,)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # A unit after another may not share a piece with it, and white space must not be trimmed.
        across = any(mark in p.lstrip(mark) or " " in p for p in pieces)
        used = set("".join(pieces))
        self.hard = np.zeros(256, bool)
        self.hard[[ord(c) for c in "\t\n\v\f" if c not in used]] = True
        kept = len(self.model.encode("a  b ")) - len(self.model.encode("a b")) == 2
        self.whole = across or not kept or self.model.encode("a b", out_type=str) != [mark + "a", mark + "b"]

    def encode(self, data, starts, ends):
        """Counts of a unit standing behind other text.

        The library puts one space before every text. A unit that begins with a space
        leaves that space out; any other begins behind it, and the piece of the space counts one.
        """
        raw = data.tobytes()
        texts = [raw[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist())]
        bare = [t[1:] if t[0] == " " else t for t in texts]
        counts = np.array([len(x) for x in self.model.encode(bare, num_threads=1)], np.int64)
        spaced = np.array([t[0] == " " for t in texts])
        # An encoding of nothing is empty, but the space that was left out is a piece.
        counts[np.array([not b for b in bare])] = 1
        return np.where(spaced, counts, counts - 1), np.zeros(int(np.where(spaced, counts, counts - 1).sum()), np.int32)

    def __call__(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of pieces of each text."""
        texts = len(at) - 1
        out = np.zeros(texts, np.int64)
        if not len(data):
            return out
        if self.whole:
            raw = data.tobytes()
            return np.array([len(self.model.encode(raw[at[i] : at[i + 1]].decode())) for i in range(texts)], np.int64)
        space = data == 0x20
        cut = np.zeros(len(data), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | self.hard[data[1:]]
        starts, ends, first = _spans(at, cut, len(data))
        begins = np.zeros(len(starts), bool)
        begins[first[:-1][np.diff(at) > 0]] = True
        inner = np.flatnonzero(~begins)
        size = np.zeros(len(starts), np.int64)
        # The first unit of a text stands behind the library's own space and is encoded as it is.
        heads = np.flatnonzero(begins)
        raw = data.tobytes()
        size[heads] = [len(x) for x in self.model.encode([raw[starts[i] : ends[i]].decode() for i in heads], num_threads=1)]
        if len(inner):
            size[inner] = self.look_up(data, starts[inner], ends[inner])[1]
        before = np.concatenate([[0], np.cumsum(size)])
        return np.diff(before[first])


_loaded: dict = {}


def file_encoder(path: str) -> FileEncoder:
    if ("file", path) not in _loaded:
        _loaded["file", path] = FileEncoder(path)
    return _loaded["file", path]


def piece_counter(path: str) -> PieceCounter:
    if ("piece", path) not in _loaded:
        _loaded["piece", path] = PieceCounter(path)
    return _loaded["piece", path]
