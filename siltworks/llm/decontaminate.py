"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Texts are compared as lower-case letters and digits with single spaces for all
else.  An item of m characters, changed by at most k edits, keeps
``m - q + 1 - k q`` of its q-grams, on diagonals that differ by at most k.  So
shared q-grams are counted by item in overlapping bands of diagonals; bands
with fewer are dropped, the others' regions are aligned to the whole item
within a band of diagonals and kept if the edit distance is at most k.

k is ``BUDGET`` of the item's length, or less where the bound would not be
positive.  Items under ``MIN_ITEM`` characters are no evidence and match nothing.
Items are taken in blocks of bounded size, each one pass over the documents.

Cases: a null text matches nothing; a null ``doc_id`` stays; repeated documents
and items each give rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, mix, window_hash

Q, BUDGET, MIN_ITEM = 8, 0.08, 24
#: Items of a block have at most this many characters together.
BLOCK_CHARS = 4 << 20
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("distance", pa.int64())])
#: Hits of a text that are held at a time.
HITS = 1 << 20
_FILTER_BITS = 22
_table: np.ndarray | None = None


def _folded() -> np.ndarray:
    """For each code point its lower-case letter or digit, or a space."""
    global _table
    if _table is None:
        t = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(0x3000):
            ch = chr(c)
            if ch.isalnum() or unicodedata.category(ch) == "Mn":
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        for lo, hi in ((0x3000, 0xD800), (0xE000, 0x110000)):
            for c in range(lo, min(hi, 0x32000)):
                if chr(c).isalnum():
                    t[c] = c
        _table = t
    return _table


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The compared code points of a text, and the place of each in it."""
    points = _folded()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    keep = points != 32
    keep[1:] |= points[:-1] != 32
    at = np.flatnonzero(keep)
    points = points[at]
    if len(points) and points[-1] == 32:
        points, at = points[:-1], at[:-1]
    if len(points) and points[0] == 32:
        points, at = points[1:], at[1:]
    return points, at


def grams(points: np.ndarray) -> np.ndarray:
    return window_hash(mix(points.astype(np.uint64) + np.uint64(1)), Q)


def budget(m: int) -> int:
    """Edits allowed in an item of m characters; the bound on shared q-grams stays positive."""
    return max(0, min(int(BUDGET * m), (m - Q) // Q))


def least_shared(m: int) -> int:
    return m - Q + 1 - budget(m) * Q


def band_width(m: int) -> int:
    return max(budget(m) + 1, 16)


def align(item: np.ndarray, region: np.ndarray, k: int, low: int, high: int) -> tuple[int, int, int] | None:
    """Least edit distance of ``item`` to a part of ``region``, with its begin and end, or None if over k.

    Only diagonals (place in region less place in item) from ``low`` to ``high``
    count.  For 0, 1, 2, ... edits the furthest place of the item that each diagonal
    reaches follows from the neighbours' at one edit less and a run of equal characters.
    """
    m, n = len(item), len(region)
    lane = np.arange(low, high + 1)
    width, before = len(lane), max(0, -low)
    padded = np.full(before + max(n, m + high + 1) + 1, -1, np.int64)
    padded[before : before + n] = region
    table = np.lib.stride_tricks.sliding_window_view(padded, width)[before + low : before + low + m]
    # the next place of the item, from each on, that differs along the diagonal
    differs = np.full((m + 1, width), m, np.int64)
    differs[:m] = np.where(table == item[:, None].astype(np.int64), m, np.arange(m)[:, None])
    differs = np.minimum.accumulate(differs[::-1])[::-1]
    none, step = -m - 2, np.arange(width)
    reach, begin = np.where((lane >= 0) & (lane <= n), differs[0], none), lane.copy()
    for edits in range(k + 1):
        if (reach >= m).any():
            j = int(np.argmax(reach >= m))
            return edits, int(begin[j]), m + int(lane[j])
        moves = np.full((3, width), none, np.int64)
        moves[0] = reach + 1
        moves[1, 1:] = reach[:-1]
        moves[2, :-1] = reach[1:] + 1
        pick = np.argmax(moves, axis=0)
        best = np.minimum(moves[pick, step], m)
        begin = begin[np.clip(step + np.array([0, -1, 1])[pick], 0, width - 1)]
        good = (best >= 0) & (best + lane >= 0) & (best + lane <= n)
        reach = np.where(good, differs[np.where(good, best, 0), step], none)
    return None


class Items:
    """The q-grams of a block of benchmark items.

    An item's places of one gram are kept by strips of the item as wide as its
    bands of diagonals, as the first and last place in the strip.  A text's place
    then meets an item in at most two bands a strip, about 25 in all, however often
    the item repeats the gram.
    """

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        self.ids, self.points, gram, item, low, high = [], [], [], [], [], []
        for i, t in zip(ids, texts, strict=True):
            p, _ = normal(t or "")
            if len(p) < MIN_ITEM:
                continue
            g, width = grams(p), band_width(len(p))
            # sorted by gram, then place: a strip's first and last place of a gram stand at the ends of a run
            order = np.argsort(g, kind="stable")
            strip = order // width
            new = np.flatnonzero(np.concatenate(([True], (g[order][1:] != g[order][:-1]) | (strip[1:] != strip[:-1]))))
            gram.append(g[order][new])
            item.append(np.full(len(new), len(self.ids), np.int64))
            low.append(order[new])
            high.append(order[np.append(new[1:], len(g)) - 1])
            self.ids.append(i)
            self.points.append(p)
        none = np.empty(0, np.int64)
        gram, item, low, high = (np.concatenate(x) if x else none for x in (gram, item, low, high))
        #: Each item's own entries, in the order of its grams.
        self.first = np.searchsorted(item, np.arange(len(self.ids) + 1))
        self.own = gram.astype(np.uint64), low, high
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.low, self.high = gram[order].astype(np.uint64), item[order], low[order], high[order]
        self.m = np.array([len(p) for p in self.points], np.int64)
        self.k = np.array([budget(m) for m in self.m.tolist()], np.int64)
        self.least = np.array([least_shared(m) for m in self.m.tolist()], np.int64)
        self.band = np.array([band_width(m) for m in self.m.tolist()], np.int64)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[(self.gram >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def _bands(self, place: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the hit, band) of hits at places of a text with strips of items: one band, or two."""
        lower, upper = ((place - w + self.m[item]) // self.band[item] for w in (high, low))
        two = np.flatnonzero(lower != upper)
        return np.concatenate((np.arange(len(place)), two)), np.concatenate((upper, lower[two]))

    def _strips(self, g: np.ndarray) -> np.ndarray:
        """(item << 40 | strip of two bands) of those strips in which enough places of a text hit the item, most hits first.

        Hits are counted by pieces of the text, so that few are held at a time; a place
        that hits a band more than once may count more than once, which only lets
        more strips pass.
        """
        place = np.flatnonzero(self.seen[(g >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        lo = np.searchsorted(self.gram, g[place], "left")
        n = np.searchsorted(self.gram, g[place], "right") - lo
        place, lo, n = place[n > 0], lo[n > 0], n[n > 0]
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.cumsum(n)
        at = 0
        while at < len(place):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HITS, "right")))
            part = n[at:to]
            where = np.repeat(lo[at:to] - (np.cumsum(part) - part), part) + np.arange(int(part.sum()))
            item = self.item[where]
            hit, band = self._bands(np.repeat(place[at:to], part), item, self.low[where], self.high[where])
            key, count = np.unique(item[hit] << 40 | band, return_counts=True)
            keys, back = np.unique(np.concatenate((keys, key)), return_inverse=True)
            counts = np.bincount(back, np.concatenate((counts, count)), len(keys)).astype(np.int64)
            at = to
        # strips overlap by one band, so any k + 1 neighbouring diagonals share one
        strip = np.concatenate((keys, keys - ((keys & ((1 << 40) - 1)) > 0)))
        strip, back = np.unique(strip, return_inverse=True)
        total = np.bincount(back, np.concatenate((counts, np.where(keys & ((1 << 40) - 1) > 0, counts, 0))), len(strip)).astype(np.int64)
        good = total >= self.least[strip >> 40]
        return strip[good][np.argsort(-total[good], kind="stable")]

    def _hits(self, g: np.ndarray, free: np.ndarray, i: int, b: int) -> int:
        """How many free places of a text hit item i in band b or b + 1."""
        m, w = int(self.m[i]), int(self.band[i])
        begin, end = max(0, b * w - m), min(len(g), (b + 2) * w)
        place = begin + np.flatnonzero(free[begin:end])
        gram, low, high = (x[self.first[i] : self.first[i + 1]] for x in self.own)
        lo = np.searchsorted(gram, g[place], "left")
        n = np.searchsorted(gram, g[place], "right") - lo
        where = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        place = np.repeat(place, n)
        hit, band = self._bands(place, np.full(len(place), i), low[where], high[where])
        return len(np.unique(place[hit[(band == b) | (band == b + 1)]]))

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, start, stop, distance) of the items within a text, the best place of each band."""
        if not self.ids or len(text) < MIN_ITEM // 2:
            return []
        points, at = normal(text)
        g = grams(points)
        out, free = set(), {}
        # strips with most hits first; hits within a place that was found count no more
        for x in self._strips(g).tolist():
            i, b = x >> 40, x & ((1 << 40) - 1)
            m, k, w = int(self.m[i]), int(self.k[i]), int(self.band[i])
            left = free.setdefault(i, np.ones(len(g), bool))
            if self._hits(g, left, i, b) < self.least[i]:
                continue
            low, high = b * w - m, (b + 2) * w - 1 - m
            begin, end = max(0, low - k), min(len(points), high + m + k)
            found = align(self.points[i], points[begin:end], k, low - begin - k, high - begin + k)
            if found:
                d, s, e = found
                out.add((self.ids[i], int(at[begin + s]), int(at[begin + e - 1]) + 1, d))
                left[begin + s : begin + e] = False
        return sorted(out, key=lambda x: (x[1], x[2], str(x[0])))


def _blocks(items: DataFrame) -> Iterator[DataFrame]:
    """``items`` in blocks of at most BLOCK_CHARS characters, or one item."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (BLOCK_CHARS // 2)))
    for k in range(n):
        yield items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)


def find_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, stop, distance): where items occur in documents, in code points."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for block in _blocks(items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))):
        got = block.collect()  # BLOCK_CHARS at most, by _blocks
        shared = spark.sparkContext.broadcast(([r[0] for r in got], [r[1] for r in got]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Items(*shared.value)
            for b in batches:
                found = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) if t.is_valid for hit in known.find(t.as_py())]
                if found:
                    yield batch(_OUT, *zip(*found, strict=True))

        part = rows.mapInArrow(run, "doc_id long, item_id long, start long, stop long, distance long")
        out = part if out is None else out.unionByName(part)
    return out


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item; each row is judged by its own text."""
    spark, names = docs.sparkSession, docs.columns
    text = names.index("text")
    # columns go by place, so clashing names don't matter
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    for block in _blocks(items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))):
        got = block.collect()
        shared = spark.sparkContext.broadcast(([r[0] for r in got], [r[1] for r in got]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Items(*shared.value)
            for b in batches:
                clean = pa.array([not (t.is_valid and known.find(t.as_py())) for t in b.column(text)], pa.bool_())
                yield b.filter(clean)

        rows = rows.mapInArrow(run, rows.schema)
    return rows.toDF(*names)
