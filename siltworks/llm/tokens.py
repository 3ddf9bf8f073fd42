"""Token ids of whole texts by a tokenizer of the ``tokenizers`` library, with each distinct word encoded once per worker.

The vocabulary in use drops white space and never joins a letter with the
ASCII punctuation after it, so a text's ids are those of its segments one after
another: segments end at ASCII white space and between an ASCII letter and
ASCII punctuation.  Texts that hold a special token's string are encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from .common import _LOWER, _SPACE, distinct_spans

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _PUNCT[_a:_b] = True

#: Lower-case letters that normalising and splitting leave alone.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff\u0101\u0103\u0105\u0107\u0119\u0142\u0144\u0153\u015b\u0161\u017a\u017c\u017e]+")
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}

_encoders: dict[tuple[str, int], SegmentEncoder] = {}


class SegmentEncoder:
    """Encodes slices of texts; keeps the ids of at most ``limit`` distinct segments."""

    def __init__(self, path: str, limit: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit = limit
        self.clear()
        probe = ["abc", "thereon", "q", "\u00e9t\u00e9", "\u00fc\u00df\u0161", "zzzz"]
        self.direct = True
        self.direct = self._encode_segments(probe) == self._encode(probe)

    @classmethod
    def of(cls, path: str, limit: int = 900_000) -> SegmentEncoder:
        if (path, limit) not in _encoders:
            _encoders[path, limit] = cls(path, limit)
        return _encoders[path, limit]

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.start, self.length, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.ids, self.n_ids = np.zeros(1 << 14, np.uint32), 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_segments(self, texts: list[str]) -> list[list[int]]:
        """Ids of lower-cased segments; those of letters alone skip normalising and splitting, which leave them as they are."""
        if not self.direct:
            return self._encode(texts)
        plain, pieces = _PLAIN.fullmatch, self.tokenizer.model.tokenize
        found = [[t.id for t in pieces(x if x.isascii() else x.encode().decode("latin-1").translate(_BYTE_LEVEL))] if plain(x) else None for x in texts]
        rest = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(rest, self._encode([texts[i] for i in rest]), strict=True):
            found[i] = x
        return found

    def _learn(self, keys: list[bytes]) -> None:
        found = self._encode_segments([k.decode("utf-8", "replace") for k in keys])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        for name, need in (("start", self.n + len(keys)), ("length", self.n + len(keys)), ("ids", self.n_ids + len(flat))):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate((old, np.zeros(max(need, len(old)), old.dtype))))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.start[self.n : self.n + len(keys)] = self.n_ids + np.cumsum(lengths) - lengths
        self.length[self.n : self.n + len(keys)] = lengths
        self.slots.update(zip(keys, range(self.n, self.n + len(keys)), strict=True))
        self.n += len(keys)
        self.n_ids += len(flat)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (uint32), and each text's number of ids."""
        whole = {i: np.array(self._encode([t.decode("utf-8", "replace")])[0], np.uint32) for i, t in enumerate(texts) if any(s in t for s in self.special)}
        if whole:
            texts = [b"" if i in whole else t for i, t in enumerate(texts)]
        ids, lengths = self._segments(texts)
        if not whole:
            return ids, lengths
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        for i, x in whole.items():
            parts[i], lengths[i] = x, len(x)
        return np.concatenate(parts), lengths

    def _segments(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        low = _LOWER[data]
        space = _SPACE[data]
        begin = ~space
        begin[1:] &= space[:-1] | (_LETTER[data[:-1]] & _PUNCT[data[1:]])
        end = ~space
        end[:-1] &= space[1:] | begin[1:]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
        first = np.searchsorted(starts, offsets)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        at, back = distinct_spans(low, starts, ends)
        if len(self.slots) + len(at) > self.limit:
            self.clear()
        raw = low.tobytes()
        keys = [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        if new := [k for k in keys if k not in self.slots]:
            self._learn(new)
        slot = np.fromiter(map(self.slots.__getitem__, keys), np.int64, len(keys))
        slot = slot[back]
        n = self.length[slot]
        stop = np.cumsum(n)
        index = np.repeat(self.start[slot] - (stop - n), n)
        index += np.arange(len(index))
        before = np.concatenate(([0], stop))
        return self.ids[index], np.diff(before[first])


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` appended to each document."""
    return np.insert(ids, np.cumsum(lengths), end_id).astype(np.uint32), lengths + 1
