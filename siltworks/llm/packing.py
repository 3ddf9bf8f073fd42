"""Order-preserving packing by dynamic programming.

Documents are encoded and laid end to end in ``doc_id`` order.  Windows of at
most ``length`` tokens cover that stream; they may end at a document's end (free),
at a sentence's end (``sentence_cost``) or, where neither comes for
``stride`` tokens, inside a sentence (``token_cost``).  The cuts minimise padding plus these
penalties: with P the tokens before a boundary, the best value at boundary j is
``pen(j) + length - P(j) + min(best(i) + P(i))`` over boundaries i at most
``length`` tokens back, a sliding minimum kept in a monotone queue.

The stream is cut into ranges of documents, a Spark partition each; within one,
documents pass in runs of bounded size and only the last, still open window is
carried on.  A range's last window is split at powers of two, which need no
padding.

Cases: a null text is empty (its end id is still packed); a null ``doc_id`` sorts
first; repeated rows are all packed; an empty table gives no pieces; other
columns are ignored; a text longer than a window spans several.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, slices
from .tokens import SegmentEncoder, with_end

_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
PIECE_DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, stride: int, sentence_cost: float, token_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, ascending, and the penalty of each; no gap exceeds ``stride``."""
    stops = np.flatnonzero(sentence[ids]) + 1
    position = np.union1d(stops, doc_ends)
    gaps = np.diff(position, prepend=0)
    more = (gaps - 1) // stride
    begin = np.repeat(position - gaps, more)
    step = np.arange(len(begin)) - np.repeat(np.cumsum(more) - more, more)
    inner = begin + (step + 1) * stride
    penalty = np.where(np.isin(position, doc_ends), 0.0, sentence_cost)
    position, penalty = np.concatenate((position, inner)), np.concatenate((penalty, np.full(len(inner), token_cost)))
    order = np.argsort(position, kind="stable")
    return position[order], penalty[order]


def best_cuts(position: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """The window ends that minimise padding plus penalties, by a monotone queue.

    The last position always is one; what comes after the cut before it stays
    open (it is carried on, or split at powers of two) and counts no padding.
    """
    p, pen = [0, *position.tolist()], [0.0, *penalty.tolist()]
    value, back = [0.0] * len(p), [0] * len(p)
    queue: deque[int] = deque([0])
    for j in range(1, len(p)):
        while p[j] - p[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        value[j] = pen[j] + length - p[j] + value[i] + p[i]
        back[j] = i
        key = value[j] + p[j]
        while queue and value[queue[-1]] + p[queue[-1]] > key:
            queue.pop()
        queue.append(j)
    last = len(p) - 1
    cuts, j = [p[last]], min((i for i in range(last) if p[last] - p[i] <= length), key=lambda i: (value[i], -i))
    while j:
        cuts.append(p[j])
        j = back[j]
    return cuts[::-1]


def powers_of_two(n: int) -> list[int]:
    """``n`` as descending powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, sentence_cost: float = 4.0, token_cost: float = 24.0, stride: int = 32, run_tokens: int = 1 << 19, partition_chars: int = 32 << 20) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    A range of documents has about ``partition_chars`` characters; each ends in
    up to log2(length) short sequences, so ranges are kept large.
    """
    keep = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = keep.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // partition_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SegmentEncoder.of(tokenizer)
        vocabulary = encoder.tokenizer.get_vocab(with_added_tokens=True)
        sentence = np.zeros(max(max(vocabulary.values()), end_id) + 1, bool)
        sentence[[i for w, i in vocabulary.items() if w.removesuffix("</w>") and set(w.removesuffix("</w>")) <= set(".!?")]] = True
        sequence = TaskContext.get().partitionId() << 33
        # the open documents: id, tokens in all, tokens already packed; and the ids not yet packed
        open_docs: list[tuple[int | None, int, int]] = []
        held: list[np.ndarray] = []
        n_held = 0

        def emit(ids: np.ndarray, cuts: list[int]) -> pa.RecordBatch:
            nonlocal open_docs, sequence
            rest = np.array([n - s for _, n, s in open_docs], np.int64)
            stop = np.cumsum(rest)
            ends = np.union1d(np.array(cuts, np.int64), stop[stop < cuts[-1]])
            begin = np.concatenate(([0], ends[:-1])).astype(np.int64)
            doc = np.searchsorted(stop, begin, "right")
            window = np.searchsorted(cuts, begin, "right")
            window_begin = np.concatenate(([0], cuts)).astype(np.int64)[window]
            keys = [open_docs[d][0] for d in doc.tolist()]
            in_all = np.array([n for _, n, _ in open_docs], np.int64)[doc]
            taken = np.array([s for _, _, s in open_docs], np.int64)[doc]
            start = taken + begin - (stop - rest)[doc]
            offsets = np.concatenate((begin, ends[-1:])) * 4
            flat = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids[: ends[-1]].astype("<u4"))]).cast(pa.binary())
            out = batch(_PIECE, keys, start, ends - begin, in_all, sequence + window, begin - window_begin, flat)
            sequence += len(cuts)
            done = int(np.searchsorted(stop, cuts[-1], "right"))
            kept = open_docs[done:]
            if kept:
                k, n, s = kept[0]
                kept[0] = (k, n, s + int(cuts[-1] - (stop - rest)[done]))
            open_docs = kept
            return out

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, n_held
            ids = np.concatenate(held)
            doc_ends = np.cumsum([n - s for _, n, s in open_docs])
            cuts = best_cuts(*boundaries(ids, doc_ends, sentence, min(stride, length), sentence_cost, token_cost), length)
            if last:
                begin = cuts[-2] if len(cuts) > 1 else 0
                cuts = cuts[:-1] + (begin + np.cumsum(powers_of_two(cuts[-1] - begin))).tolist()
            elif len(cuts) > 2:
                cuts = cuts[:-2]
            out = emit(ids, cuts)
            held = [ids[cuts[-1] :]]
            n_held = len(held[0])
            return out

        for b in batches:
            keys = b.column(0).to_pylist()
            for i, j, texts in slices(b.column(1)):
                ids, n = with_end(*encoder.encode(texts), end_id)
                open_docs += [(k, m, 0) for k, m in zip(keys[i:j], n.tolist(), strict=True)]
                held.append(ids)
                n_held += len(ids)
                if n_held >= run_tokens:
                    yield flush(False)
        if n_held:
            yield flush(True)

    return keep.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, PIECE_DDL)
