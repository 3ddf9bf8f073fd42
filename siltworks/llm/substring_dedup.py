"""Repeated passages by difference-cover anchors, removed exactly.

A word is removed if it lies in a window of ``WINDOW`` consecutive words whose
sequence also starts in a document with a smaller ``doc_id``.

``COVER`` is a perfect difference set modulo ``PERIOD``: for any two places there
is a shift below the period that brings both to cover positions.  So only runs of
``WINDOW - PERIOD + 1`` words at cover positions are hashed; two equal windows
hold an equal anchor at the same place within them.  Steps:

1. a bitmap, sized by their number up to a bound, of anchors that may occur in two documents;
2. anchors that pass it, aggregated to those in two documents indeed, and
   listed by document;
3. all windows around listed anchors, by hash with the least ``doc_id``;
4. each document's windows that a smaller ``doc_id`` has, and the removal.

Documents whose whole word sequence a smaller ``doc_id`` has are settled from
hashes of whole documents before step 2's lists.  Aggregations combine before
they shuffle and joins are plain equi-joins that Spark may split, so a passage
that a third of all documents share is no hot spot.  Only documents that a step
needs are shuffled with their texts.

Cases: a null text is empty; a row of null ``doc_id`` neither removes nor loses
words; rows of one ``doc_id`` don't remove from each other; texts under the
window's length stay whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, Words, batch, bitmap_bits, block_rows, cut, merge_blocks, signed, slices, split_by_ids, window_hash, word_sums

WINDOW, PERIOD = 50, 31
#: A perfect difference set modulo 31 (fixed values): every residue is a difference of two.
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a document's anchors; none where it is shorter than a window."""
    if len(h) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    w = window_hash(h, ANCHOR)
    at = np.flatnonzero(_IN_COVER[np.arange(len(w)) % PERIOD])
    return at, w[at]


def _documents(b: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], Words, np.ndarray]]:
    """First row, texts, words and word hashes of the slices of a batch whose second column is the text."""
    for i, _, texts in slices(b.column(1)):
        w = Words(texts)
        yield i, texts, w, w.hashes()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())])
    for b in batches:
        for i, texts, w, h in _documents(b):
            a, c = word_sums(h, w.first)
            yield batch(schema, b.column(0).slice(i, len(texts)), np.diff(w.first), signed(a), signed(c))


def _twice(rows: DataFrame, bits: int) -> Bitmap:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return block_rows((np.unique(anchors(h[s:e])[1]) for b in batches for _, _, w, h in _documents(b) for s, e in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)), bits)

    return merge_blocks(rows.mapInArrow(run, "block int, positions binary"), bits, 2)


def _passing(rows: DataFrame, bitmap: Bitmap) -> DataFrame:
    """(anchor, doc_id) that pass the bitmap, once a document."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)
    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, texts, w, h in _documents(b):
                ids, found, whose = b.column(0).slice(i, len(texts)).to_numpy(zero_copy_only=False), [], []
                for k, (s, e) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                    a = anchors(h[s:e])[1]
                    a = np.unique(a[shared.value.test(a)])
                    found.append(a)
                    whose.append(np.full(len(a), ids[k], np.int64))
                if found:
                    yield batch(schema, signed(np.concatenate(found)), np.concatenate(whose))

    return rows.mapInArrow(run, "anchor long, doc_id long")


def _in_two(rows: DataFrame, key: str) -> DataFrame:
    """The keys of (key, doc_id) that two documents have, with the least of them."""
    return rows.groupBy(key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(key, "least")


def _windows(rows: DataFrame) -> DataFrame:
    """(window, doc_id) around listed anchors; ``rows`` has doc_id, text, list."""
    schema = pa.schema([("window", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, texts, w, h in _documents(b):
                for k in range(len(texts)):
                    own = h[w.first[k] : w.first[k + 1]]
                    at, a = anchors(own)
                    at = at[np.isin(signed(a), np.asarray(b.column(2)[i + k].values))]
                    if not len(at):
                        continue
                    edge = np.zeros(len(own) + 2, np.int64)
                    # a window around an anchor starts at most PERIOD - 1 words before it
                    np.add.at(edge, np.maximum(at - (PERIOD - 1), 0), 1)
                    np.subtract.at(edge, at + 1, 1)
                    full = window_hash(own, WINDOW)
                    hit = np.unique(signed(full[np.cumsum(edge[: len(full)]) > 0]))
                    yield batch(schema, hit, np.full(len(hit), b.column(0)[i + k].as_py(), np.int64))

    return rows.mapInArrow(run, "window long, doc_id long")


def _removed(texts: list[bytes], lists: list[np.ndarray], gone: list[set[int]]) -> tuple[list[int], list[int], list[bytes]]:
    """Words, removed words and kept text of each document."""
    w = Words(texts)
    h = w.hashes() if any(len(x) or y for x, y in zip(lists, gone, strict=True)) else np.empty(0, np.uint64)
    whole = signed(word_sums(h, w.first)[0]) if len(h) else None
    n, lost, kept = np.diff(w.first).tolist(), [], []
    for k, text in enumerate(texts):
        words = text.split()
        if gone[k] and n[k] >= WINDOW and int(whole[k]) in gone[k]:
            lost.append(n[k])
            kept.append(b"")
            continue
        if len(lists[k]) and n[k] >= WINDOW:
            hit = np.isin(signed(window_hash(h[w.first[k] : w.first[k + 1]], WINDOW)), lists[k])
            edge = np.zeros(n[k] + 1, np.int64)
            edge[: len(hit)] += hit
            edge[WINDOW:][: len(hit)] -= hit
            stay = np.cumsum(edge[:-1]) == 0
            words = [words[x] for x in np.flatnonzero(stay).tolist()]
        lost.append(n[k] - len(words))
        kept.append(b" ".join(words))
    return n, lost, kept


def _cleaned(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, text of ``rows`` (doc_id, text and, where there are any, list and gone)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])
    listed = "list" in rows.columns

    def values(x: pa.Scalar) -> np.ndarray:
        return np.asarray(x.values) if x.is_valid else np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in slices(b.column(1)):
                lists = [values(b.column(2)[k]) if listed else () for k in range(i, j)]
                gone = [set(values(b.column(3)[k]).tolist()) if listed else set() for k in range(i, j)]
                n, lost, kept = _removed(texts, lists, gone)
                yield batch(schema, b.column(0).slice(i, j - i), n, lost, pa.array(kept, pa.binary()).cast(pa.string()))

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space, for each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = rows.where(F.col("doc_id").isNotNull())
    signature = cut(known.mapInArrow(_signatures, "doc_id long, n_words long, w1 long, w2 long").where(F.col("n_words") >= WINDOW), "signatures")
    firsts = cut(signature.groupBy("w1", "w2").agg(F.min("doc_id").alias("least")), "firsts")
    copies = signature.join(firsts, ["w1", "w2"]).where("doc_id > least").select("doc_id", "w1")

    n_anchors = (signature.agg(F.sum("n_words")).first()[0] or 0) * len(COVER) // PERIOD
    passing = cut(_passing(known, _twice(known, bitmap_bits(n_anchors))), "anchors")
    lists = passing.join(_in_two(passing, "anchor"), "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("list"))
    lists = cut(lists.join(firsts.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi"), "lists")
    near, _ = split_by_ids(known, "doc_id", lists)
    windows = cut(_windows(near.join(lists, "doc_id").select("doc_id", "text", "list")).distinct(), "windows")
    taken = windows.join(_in_two(windows, "window"), "window").where("doc_id > least").groupBy("doc_id").agg(F.collect_list("window").alias("list"))
    gone = copies.groupBy("doc_id").agg(F.collect_set("w1").alias("gone"))
    work = cut(taken.join(gone, "doc_id", "full"), "work")
    touched, rest = split_by_ids(rows, "doc_id", work)
    return _cleaned(touched.join(work, "doc_id", "left").select("doc_id", "text", "list", "gone")).unionByName(_cleaned(rest))
