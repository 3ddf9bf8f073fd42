"""Product codes of vectors: whole-number k-means by part, with Drake-Hamerly's adaptive bounds.

Components become floor(1024 * x), so distances, sums and codebooks are exact and
don't depend on order or partitioning.  Each round reads and writes one table
that holds, for each part of each vector, its entry, the ``b`` entries next
closest with a lower bound of the distance to each, and one lower bound of the
distance to all others.  When entries have moved, bounds shrink by the distance
moved (all others' by the greatest such distance).  The few entries that moved
far more than most are compared exactly with every part, so that they don't
spoil the bound of all others.  The distance to a part's own entry is computed
exactly; listed entries whose bound isn't above it are verified by whole-number
distances, and only a part whose best distance reaches the outer bound is
compared with the whole codebook.  ``b`` adapts: once most parts are settled by
their bounds, each round keeps what all but a few of them needed, half at least.
Bounds are rounded down to 16 bits when stored, so that ties and near ties are
always verified.

Memory: codebooks are of fixed size; a task holds a batch of vectors.

Cases: a row whose vector is null or empty or holds a null or non-finite
component is dropped, as is one of another length than the first row's by
vec_id, and one with a component whose integer is so large that a vector's
error could exceed a long (2 ** 27 at 64 components).  Null ids sort last, ties
of ids by the vector.  A length that isn't a multiple of the parts is filled
with zeros.  With fewer vectors than entries the codebooks are that much
smaller.  Repeated rows are all kept; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch
from .tables import Tables

SCALE = 1024
#: Closest entries listed at first, and at least; the share of settled parts that the next round's list would have settled.
FIRST_NEAR, LEAST_NEAR, ENOUGH = 24, 8, 0.98
#: Entries that moved over ``FAR`` times the median are compared with all parts, ``MOST_FAR`` of them at most.
FAR, MOST_FAR = 1.5, 32
#: Depth of a part that was compared with the whole codebook.
FULL = 255

_STATE = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("x", pa.binary()), ("code", pa.binary()), ("near", pa.binary()), ("low", pa.binary()), ("depth", pa.binary()), ("error", pa.int64())])
_STATE_DDL = "vec_id long, label long, x binary, code binary, near binary, low binary, depth binary, error long"


def under(distance: np.ndarray) -> np.ndarray:
    """16-bit values surely not above ``distance``; what is beyond their range is their greatest."""
    return np.nextafter(np.minimum(distance * (1 - 1e-12), 65504).astype(np.float16), np.float16(-np.inf))


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows (int64) to all entries: by float64 products where all whole numbers in them are exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(book)), np.int64)
    for k, c in enumerate(book):
        out[:, k] = ((x - c) ** 2).sum(axis=1)
    return out


def compare_all(x: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entry, squared distance, ``b`` next entries, and their bounds with the outer bound last."""
    d, k = squares(x, book), len(book)
    take = min(k, b + 2)
    at = np.argpartition(d, take - 1, axis=1)[:, :take] if take < k else np.broadcast_to(np.arange(k), d.shape)
    own = np.argmin(d, axis=1)
    dist = np.take_along_axis(d, at, axis=1)
    # nearest first, ties to the lower index, as for the entry itself
    order = np.lexsort((at, dist), axis=1)
    at, dist = np.take_along_axis(at, order, axis=1), np.sqrt(np.take_along_axis(dist, order, axis=1).astype(np.float64))
    listed, low = at[:, 1 : b + 1], under(dist[:, 1 : b + 2])
    if low.shape[1] < b + 1:  # a small codebook: all its entries are listed
        fill = b + 1 - low.shape[1]
        listed = np.concatenate((listed, np.repeat(own[:, None], b - listed.shape[1], axis=1)), axis=1)
        low = np.concatenate((low, np.full((len(x), fill), np.inf, np.float16)), axis=1)
    # where argpartition left out the entry itself, all it took are ties, which the outer bound then equals
    return own, d[np.arange(len(x)), own], listed, low


def far_movers(moved: np.ndarray) -> np.ndarray:
    """The entries that moved far more than most, farthest first."""
    order = np.argsort(-moved, kind="stable")
    return order[: min(MOST_FAR, len(moved) - 1, int((moved > FAR * np.median(moved)).sum()))]


def compare_bounded(x: np.ndarray, book: np.ndarray, moved: np.ndarray, movers: np.ndarray, own: np.ndarray, listed: np.ndarray, low: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """As ``compare_all``, from a former state whose entries ``moved`` by at most those distances; also each row's depth.

    ``movers`` are compared with every row.
    """
    n, width = listed.shape
    low = low.astype(np.float64)
    low[:, :width] -= moved[listed]
    low[:, width] -= np.delete(moved, movers).max(initial=0)
    order = np.argsort(low[:, :width], axis=1, kind="stable")
    listed, inner, outer = np.take_along_axis(listed, order, axis=1), np.take_along_axis(low[:, :width], order, axis=1), low[:, width]
    error = ((x - book[own]) ** 2).sum(axis=1)
    reach = np.sqrt(error.astype(np.float64)) * (1 + 1e-12)
    depth = (inner <= reach[:, None]).sum(axis=1)
    # the entry itself, the list, and the movers that are neither; distances not computed are out of reach
    none, far = np.iinfo(np.int64).max, squares(x, book[movers])
    known = np.concatenate((own[:, None], listed), axis=1)
    ids = np.concatenate((known, np.broadcast_to(movers, far.shape)), axis=1)
    exact = np.concatenate((error[:, None], np.full(listed.shape, none), far), axis=1)
    lows = np.concatenate((np.sqrt(error.astype(np.float64))[:, None], inner, np.sqrt(far.astype(np.float64))), axis=1)
    for k, e in enumerate(movers):
        at = np.flatnonzero((known == e).any(axis=1))
        exact[at, 1 + width + k], lows[at, 1 + width + k] = none, np.inf
    for k in range(int(depth.max(initial=0))):
        at = np.flatnonzero(depth > k)
        exact[at, k + 1] = ((x[at] - book[listed[at, k]]) ** 2).sum(axis=1)
        lows[at, k + 1] = np.sqrt(exact[at, k + 1].astype(np.float64))
    best = exact.min(axis=1)
    slot = np.where(exact == best[:, None], ids, len(book)).argmin(axis=1)
    rows = np.flatnonzero(slot)
    for a in (ids, lows):
        a[rows, 0], a[rows, slot[rows]] = a[rows, slot[rows]], a[rows, 0]
    own, listed, inner = ids[:, 0], ids[:, 1:], lows[:, 1:]
    if b < listed.shape[1]:
        order = np.argsort(inner, axis=1, kind="stable")
        listed, inner = np.take_along_axis(listed, order, axis=1), np.take_along_axis(inner, order, axis=1)
        outer = np.minimum(outer, inner[:, b])
        listed, inner = listed[:, :b], inner[:, :b]
    low = under(np.concatenate((inner, outer[:, None]), axis=1))
    # what the outer bound doesn't rule out
    rows = np.flatnonzero(outer <= np.sqrt(best.astype(np.float64)) * (1 + 1e-12))
    if len(rows):
        own[rows], best[rows], listed[rows], low[rows] = compare_all(x[rows], book, b)
        depth[rows] = FULL
    return own, best, listed, low, depth


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """A binary column of equally long values as a writable matrix."""
    values = column.to_pylist()
    return np.frombuffer(bytearray(b"".join(values)), kind).reshape(len(values), -1)


def _binary(m: np.ndarray, kind: str) -> pa.Array:
    m = np.ascontiguousarray(m, kind)
    width = m.shape[1] * m.itemsize
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((np.arange(len(m) + 1) * width).astype(np.int32)), pa.py_buffer(m)])


class Codes:
    """The coded vectors: ``rows`` (vec_id, label, code, error), and the final codebooks by part."""

    def __init__(self, rows: DataFrame, books: list[np.ndarray], listed: list[int], depths: list[dict[int, int]]):
        self.rows, self.books = rows, books
        #: The list's length and the parts by depth (FULL: compared with all entries), a round.
        self.listed, self.depths = listed, depths

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.books for v in book.ravel().tolist()).encode()).hexdigest()


def compress(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, vector: str = "embedding", label: str = "label") -> Codes:
    """Code the vectors of ``rows`` (vec_id, ``label``, ``vector``); labels are whole numbers."""
    spark, tables = rows.sparkSession, Tables(rows.sparkSession, "codes")
    v = F.col(vector).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    data = rows.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long"), F.col(label).cast("long").alias("label"), v.alias("v"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v").asc()]
    first = data.orderBy(*order).select(F.size("v")).first()
    if first is None:
        return Codes(spark.createDataFrame([], "vec_id long, label long, code binary, error long"), [], [], [])
    length = first[0]
    padded = -(-length // parts) * parts
    limit = math.isqrt(((1 << 63) - 1) // (4 * padded))
    small = F.forall("v", lambda x: F.abs(F.floor(x * SCALE).cast("double")) <= float(limit))
    # floor to a long saturates, so the double is checked first
    data = data.where((F.size("v") == length) & F.forall("v", lambda x: F.abs(x) <= float(limit) / SCALE) & small)
    start = [[math.floor(SCALE * x) for x in r.v] + [0] * (padded - length) for r in data.select("vec_id", "v").orderBy(*order).limit(entries).collect()]
    width = padded // parts
    books = [np.array([x[p * width : (p + 1) * width] for x in start], np.int64).reshape(-1, width) for p in range(parts)]
    k = len(start)
    if not k:
        return Codes(spark.createDataFrame([], "vec_id long, label long, code binary, error long"), [], [], [])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, length)
            x = np.zeros((b.num_rows, padded), "<i4")
            x[:, :length] = np.floor(flat * SCALE)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binary(x, "<i4")], names=["vec_id", "label", "x"])

    state, old, b, used, depths = data.mapInArrow(whole, "vec_id long, label long, x binary"), None, min(FIRST_NEAR, k - 1), [], []
    for no in range(rounds + 1):
        used.append(b)
        state = tables.keep(state.mapInArrow(_assign(books, old, b), _STATE_DDL), f"round{no}")
        if no:
            tables.drop(f"round{no - 1}")
        if no == rounds:
            break
        old, books, counts = books, *_moved(state, books)
        depths.append(counts)
        b = _enough(counts, b)
    out = state.select("vec_id", "label", "code", "error")
    return Codes(out, books, used, depths)


def _assign(books: list[np.ndarray], old: list[np.ndarray] | None, b: int):
    """Each part's closest entry and its bounds, anew or from the state that ``old`` codebooks left."""
    moved = [np.sqrt(((x - y) ** 2).sum(axis=1).astype(np.float64)) * (1 + 1e-12) for x, y in zip(books, old, strict=True)] if old else []
    movers = [far_movers(m) for m in moved]
    parts, width = len(books), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            n = rows.num_rows
            if not n:
                continue
            x = _matrix(rows.column(2), "<i4").astype(np.int64)
            code, near, low, depth, error = np.zeros((n, parts), np.uint8), np.zeros((n, parts, b), np.uint8), np.zeros((n, parts, b + 1), np.float16), np.full((n, parts), FULL, np.uint8), np.zeros(n, np.int64)
            if old:
                was = _matrix(rows.column(3), np.uint8).astype(np.int64)
                listed, bounds = _matrix(rows.column(4), np.uint8).reshape(n, parts, -1).astype(np.int64), _matrix(rows.column(5), "<f2").reshape(n, parts, -1)
            for p, book in enumerate(books):
                mine = x[:, p * width : (p + 1) * width]
                if old:
                    own, best, near[:, p], low[:, p], depth[:, p] = compare_bounded(mine, book, moved[p], movers[p], was[:, p], listed[:, p], bounds[:, p], b)
                else:
                    own, best, near[:, p], low[:, p] = compare_all(mine, book, b)
                code[:, p] = own
                error += best
            flat = lambda a: a.reshape(n, -1)
            yield batch(_STATE, rows.column(0), rows.column(1), rows.column(2), _binary(code, np.uint8), _binary(flat(near), np.uint8), _binary(flat(low), "<f2"), _binary(depth, np.uint8), error)

    return run


def _moved(state: DataFrame, books: list[np.ndarray]) -> tuple[list[np.ndarray], dict[int, int]]:
    """The codebooks of the parts' means, rounded down, and how many parts had each depth.

    A task sends one row an entry at most; the driver gets sums of a codebook's size.
    """
    parts, (k, width) = len(books), books[0].shape
    schema = pa.schema([("slot", pa.int32()), ("place", pa.int32()), ("value", pa.int64())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, depths = np.zeros((parts * k, width + 1), np.int64), np.zeros(FULL + 1, np.int64)
        for rows in batches:
            x, code = _matrix(rows.column(0), "<i4"), _matrix(rows.column(1), np.uint8).astype(np.int64)
            depths += np.bincount(_matrix(rows.column(2), np.uint8).ravel(), minlength=FULL + 1)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                at = code[order, p]
                edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                slots = p * k + at[edge]
                total[slots, :width] += np.add.reduceat(x[order, p * width : (p + 1) * width].astype(np.int64), edge, axis=0)
                total[slots, width] += np.diff(np.append(edge, len(at)))
        slot, place = np.nonzero(total)
        seen = np.flatnonzero(depths)
        yield batch(schema, np.concatenate((slot, np.full(len(seen), -1))), np.concatenate((place, seen)), np.concatenate((total[slot, place], depths[seen])))

    got = state.select("x", "code", "depth").mapInArrow(sums, "slot int, place int, value long").groupBy("slot", "place").agg(F.sum("value")).collect()
    total, depths = np.zeros((parts * k, width + 1), np.int64), {}
    for slot, place, value in got:
        if slot < 0:
            depths[place] = value
        else:
            total[slot, place] = value
    count = total[:, width:]
    mean = np.where(count > 0, total[:, :width] // np.maximum(count, 1), np.concatenate(books))
    return [mean[p * k : (p + 1) * k] for p in range(parts)], depths


def _enough(depths: dict[int, int], b: int) -> int:
    """The shortest list, half of the present one at least, that would have settled nearly all parts that this one settled; the same one until most are."""
    settled = [depths.get(d, 0) for d in range(b + 1)]
    if 2 * sum(settled) < sum(depths.values()):
        return b
    reached = np.cumsum(settled) >= ENOUGH * sum(settled)
    return min(b, max(LEAST_NEAR, -(-b // 2), int(np.argmax(reached))))
