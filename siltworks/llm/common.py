"""Shared pieces of the corpus operators: scratch tables, byte-level words, rolling hashes.

Words are runs of ``[^\\x20\\x09-\\x0D]``.  All hashing is vectorised over a
batch of documents, 64 bits wide, and the same in every process.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in slices of about this many bytes, which bounds a task's memory.
SLICE_BYTES = 2 << 20
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, as in tests, below a temporary folder, but only on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("siltworks.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("siltworks.scratch", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: a lineage cut that outlives executors.

    Dictionary pages may be large, as hashes that repeat compress in no other way.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.dictionary.page.size", 8 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- batches


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Consecutive rows i to j of a string column, of about ``limit`` bytes together (one row at least), as UTF-8; null is empty.

    Only a slice's texts exist as Python objects at a time.
    """
    column = column.cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield i, j, [x or b"" for x in column.slice(i, j - i).to_pylist()]
        i = j


def batch(schema: pa.Schema, *arrays: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(arrays, schema, strict=True)], schema=schema)


# ---------------------------------------------------------------- hashes

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one little-endian number."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))


def _pieces(eights: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All eight-byte pieces but the first of spans longer than that: the pieces, their number within the span, and the pieces of each span."""
    n = (lengths - 1) >> 3
    no = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1
    at, left = np.repeat(starts, n) + 8 * no, np.repeat(lengths, n) - 8 * no
    return eights[at] & _FIRST[np.minimum(left, 8)], no, n


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span ``data[start:end]``: of its eight-byte pieces, each scrambled with its place, and its length."""
    eights, lengths = _eights(data), ends - starts
    total = mix(eights[starts] & _FIRST[np.minimum(lengths, 8)])
    long = np.flatnonzero(lengths > 8)
    if len(long):
        piece, no, n = _pieces(eights, starts[long], lengths[long])
        total[long] += np.add.reduceat(mix(piece ^ mix(no.astype(np.uint64))), np.cumsum(n) - n)
    return mix(total + lengths.astype(np.uint64))


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span of each distinct byte string, and which of them each span equals; equal by bytes, not by hash alone."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    _, at, back = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    other, eights, lengths = at[back], _eights(data), ends - starts
    same = (lengths == lengths[other]).all() and (eights[starts] & _FIRST[np.minimum(lengths, 8)] == (eights[starts] & _FIRST[np.minimum(lengths, 8)])[other]).all()
    if same and len(long := np.flatnonzero(lengths > 8)):
        same = bool((_pieces(eights, starts[long], lengths[long])[0] == _pieces(eights, starts[other[long]], lengths[long])[0]).all())
    if not same:
        raw, seen = data.tobytes(), {}
        back = np.fromiter((seen.setdefault(raw[s:e], len(seen)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
        at = np.unique(back, return_index=True)[1]
    return at, back


def window_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values; one result per start, empty when too short."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, level, size = None, 0, h, 1
    while True:
        if width & size:
            part = level[done : done + n]
            out = part if out is None else mix(out * _U(0xD6E8FEB86659FD93) + part)
            done += size
        if size * 2 > width:
            return out
        level = mix(level[:-size] * _U(0xA0761D6478BD642F) + level[size:])
        size *= 2


class Words:
    """The words of a slice of documents, as byte spans of one buffer."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.raw = data
        self.data = _LOWER[data] if lower else data
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
        #: The words of document i are those from first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)


def word_sums(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each document's whole word sequence; 0 where it is empty."""
    n = np.diff(first)
    place = mix((np.arange(len(h)) - np.repeat(first[:-1], n)).astype(np.uint64) + _U(1))
    out = []
    for salt in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h * _U(salt) + place))))
        out.append(total[first[1:]] - total[first[:-1]])
    return out[0], out[1]


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


# ---------------------------------------------------------------- bitmaps
#
# A bitmap of fixed size says which hashes may occur (or occur twice) in all
# the data.  Tasks send the sorted bit positions of their hashes, a few bytes
# each; the blocks of the bitmap are counted apart from each other.  A bitmap only
# spares work: what passes it is decided exactly afterwards, and one that is too
# small for the data lets more pass.

_BLOCKS = 256
#: Bitmaps have at least 2 ** 24 bits (2 MB), and at most 2 ** 31 (256 MB).
LEAST_BITS, MOST_BITS = 24, 31
#: The driver reads a written bitmap in so many parts, one at a time.
_PARTS = 8


def bitmap_bits(n: int) -> int:
    """The size of a bitmap for ``n`` hashes, as a power of two: four bits a hash within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, (4 * n).bit_length()))


class Bitmap:
    """Bit ``h >> (64 - bits)`` says whether a hash may have been seen; ``counts`` has how often, by its first ``COUNT_BITS`` bits."""

    COUNT_BITS = 20

    def __init__(self, data: np.ndarray, bits: int, counts: np.ndarray):
        self.data, self.bits, self.counts = data, bits, counts

    def count(self, h: np.ndarray) -> np.ndarray:
        """An upper bound of each hash's occurrences."""
        return self.counts[(h >> _U(64 - self.COUNT_BITS)).astype(np.int64)]

    def test(self, h: np.ndarray) -> np.ndarray:
        at = (h >> _U(64 - self.bits)).astype(np.int64)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) == 1


def block_rows(hashes: Iterable[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, positions) of a task's hashes."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    schema = pa.schema([("block", pa.int32()), ("positions", pa.binary())])
    width = bits - (_BLOCKS - 1).bit_length()

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        at = np.sort(np.concatenate(held) >> _U(64 - bits))
        edge = np.searchsorted(at >> _U(width), np.arange(_BLOCKS + 1, dtype=np.uint64))
        low = (at & _U((1 << width) - 1)).astype("<u4")
        rows = [k for k in range(_BLOCKS) if edge[k] < edge[k + 1]]
        return batch(schema, rows, [press(np.diff(low[edge[k] : edge[k + 1]], prepend=np.uint32(0)).tobytes()) for k in rows])

    held, n = [], 0
    for h in hashes:
        held.append(h)
        n += len(h)
        if n >= 1 << 20:
            yield flush(held)
            held, n = [], 0
    if n:
        yield flush(held)


def merge_blocks(rows: DataFrame, bits: int, least: int) -> Bitmap:
    """The bitmap of positions that occur ``least`` times (1 or 2) or more; 2 ** bits bits come to the driver, by parts of a written table."""
    import zstandard

    width = bits - (_BLOCKS - 1).bit_length()
    schema = pa.schema([("block", pa.int32()), ("data", pa.binary()), ("counts", pa.binary())])
    coarse = max(0, bits - Bitmap.COUNT_BITS)
    cells = (1 << width) >> coarse

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        undo = zstandard.ZstdDecompressor().decompress
        block, seen, done, counts = None, None, None, None

        def out() -> pa.RecordBatch:
            return batch(schema, [block], [np.packbits(done if least > 1 else seen, bitorder="little").tobytes()], [np.minimum(counts, (1 << 32) - 1).astype("<u4").tobytes()])

        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != block:
                    if block is not None:
                        yield out()
                    block, seen, done, counts = k, np.zeros(1 << width, bool), np.zeros(1 << width, bool), np.zeros(cells, np.int64)
                at = np.cumsum(np.frombuffer(undo(data.as_py()), "<u4"), dtype=np.int64)
                done[at[1:][np.diff(at) == 0]] = True
                done[at[seen[at]]] = True
                seen[at] = True
                counts += np.bincount(at >> coarse, minlength=cells)
        if block is not None:
            yield out()

    whole = np.zeros(1 << (bits - 3), np.uint8)
    counts = np.zeros(_BLOCKS * cells, np.uint32)
    step = 1 << (width - 3)
    blocks = cut(rows.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, data binary, counts binary"), "bitmap")
    for r in blocks.coalesce(_PARTS).toLocalIterator():
        whole[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["data"], np.uint8)
        counts[r["block"] * cells : (r["block"] + 1) * cells] = np.frombuffer(r["counts"], "<u4")
    return Bitmap(whole, bits, counts)


# ---------------------------------------------------------------- ids


def dense(rows: DataFrame, size: int) -> Column:
    """An array of ``size`` values from (slot, value), as a scalar subquery; a slot without a row has 0."""
    all_slots = rows.sparkSession.range(size).select(F.col("id").alias("slot")).join(rows, "slot", "left")
    packed = all_slots.agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("value", F.lit(0).cast("long")).alias("value")))).alias("a"))
    return packed.select(F.transform("a", lambda s: s["value"])).scalar()


def among(ids: DataFrame, column: Column) -> Column:
    """Whether a value may be in ``ids``, a written table whose first column is an id; null surely isn't.

    A bit array of eight to sixteen bits an id, between 2 ** 20 and 2 ** 24 in
    all, that spares shuffling other rows; what passes it is joined afterwards.
    """
    bits = min(24, max(20, (8 * ids.count()).bit_length()))
    slot = lambda c: F.xxhash64(c.cast("long")).bitwiseAND(F.lit((1 << bits) - 1))
    own = slot(F.col(ids.columns[0]))
    words = ids.select(F.shiftright(own, 6).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), (own % 64).cast("int")).alias("bit"))
    array = dense(cut(words.groupBy("slot").agg(F.bit_or("bit").alias("value")), "bits"), 1 << (bits - 6))
    mine = slot(column)
    hit = F.call_function("getbit", F.element_at(array, (F.shiftright(mine, 6) + 1).cast("int")), (mine % 64).cast("int")) == 1
    return column.isNotNull() & hit


def split_by_ids(docs: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` that may be among the ids, and those that surely aren't (nulls too)."""
    hit = among(ids, F.col(column))
    return docs.where(hit), docs.where(~hit)
