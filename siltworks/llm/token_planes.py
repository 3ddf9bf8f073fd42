"""Bit-plane shuffled token files.

A file holds the ids of consecutive documents.  Fixed-size blocks of ids are
transposed into byte planes or bit planes (all lowest bytes or bits first), each
plane is compressed with zstandard by itself, and a block index gives every
plane's place.  Files are rows of a Parquet table (written by Spark's committer,
so a lost executor leaves no half-written file), one row a file, in ascending
``doc_id`` order over partitions and rows.

Layout, little-endian: magic ``BPL1``; uint32 block size, planes, bits a plane,
blocks, documents, bytes of the compressed document table; the document table
(uint8 valid, int64 id, uint32 length each, in planes of their own); the block
index (uint64 offset and uint32 size a plane, uint32 ids a block); the planes.

Cases: a null text has no ids of its own (only the end id); a null ``doc_id``
sorts first and comes back as null; repeated rows are all kept, ordered by text;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, slices
from .tokens import SegmentEncoder, with_end

MAGIC = b"BPL1"
#: Up to so many writer partitions, their offsets are sent to the files rather than joined by a shuffle of the files.
MOST_PARTS = 100_000
_HEAD = "<6I"


def to_planes(block: np.ndarray, planes: int, bits: int) -> list[bytes]:
    """Transpose ids into ``planes`` byte planes (bits=8) or bit planes (bits=1)."""
    raw = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(planes)]
    rows = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(np.ascontiguousarray(rows[:, k]), bitorder="little").tobytes() for k in range(planes)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if bits == 8:
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(p, np.uint8)
    else:
        rows = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            rows[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        out = np.packbits(rows, axis=1, bitorder="little")
    return out.reshape(-1).view("<u4").astype(np.uint32)


def write_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, block: int, bits: int, level: int) -> bytes:
    """The bytes of one file."""
    width = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    planes = -(-width // bits)
    press = zstandard.ZstdCompressor(level=level).compress
    docs = press(bytes(x is not None for x in doc_ids) + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + lengths.astype("<u4").tobytes())
    index, body, at, blocks = [], [], 0, range(0, len(ids), block)
    for b in blocks:
        part = ids[b : b + block]
        for p in to_planes(part, planes, bits):
            body.append(press(p))
            index.append(struct.pack("<QI", at, len(body[-1])))
            at += len(body[-1])
        index.append(struct.pack("<I", len(part)))
    return b"".join([MAGIC, struct.pack(_HEAD, block, planes, bits, len(blocks), len(doc_ids), len(docs)), docs, *index, *body])


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of a file."""
    if data[:4] != MAGIC:
        raise ValueError("not a plane file")
    _, planes, bits, n_blocks, n_docs, n_table = struct.unpack_from(_HEAD, data, 4)
    at = 4 + struct.calcsize(_HEAD)
    undo = zstandard.ZstdDecompressor().decompress
    table = undo(data[at : at + n_table])
    at += n_table
    doc_ids = np.frombuffer(table, "<i8", n_docs, n_docs).tolist()
    doc_ids = [x if ok else None for x, ok in zip(doc_ids, table[:n_docs], strict=True)]
    lengths = np.frombuffer(table, "<u4", n_docs, 9 * n_docs).astype(np.int64)
    body, out = at + n_blocks * (12 * planes + 4), []
    for _ in range(n_blocks):
        spans = [struct.unpack_from("<QI", data, at + 12 * k) for k in range(planes)]
        (n,) = struct.unpack_from("<I", data, at + 12 * planes)
        at += 12 * planes + 4
        out.append(from_planes([undo(data[body + o : body + o + s]) for o, s in spans], n, bits))
    return doc_ids, lengths, np.concatenate(out) if out else np.empty(0, np.uint32)


_FILE = pa.schema([("part", pa.int32()), ("part_start", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
_DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = 1 << 16, file_ids: int = 1 << 20, plane_bits: int = 8, level: int = 3) -> None:
    """Encode ``docs`` (doc_id, text) and write the files below ``path`` in ascending doc_id order.

    ``plane_bits`` is 8 (byte planes) or 1 (bit planes).  A file ends at the
    first document that brings it to ``file_ids`` ids.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = SegmentEncoder.of(tokenizer), TaskContext.get().partitionId()
        doc_ids, lengths, ids, held, before = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, lengths, ids, held, before
            n, all_ids = np.concatenate(lengths), np.concatenate(ids)
            out = batch(_FILE, [part], [before], [len(doc_ids)], [held], [write_file(doc_ids, n, all_ids, block_ids, plane_bits, level)])
            before += held
            doc_ids, lengths, ids, held = [], [], [], 0
            return out

        for b in batches:
            keys = b.column(0).to_pylist()
            for i, j, texts in slices(b.column(1)):
                flat, n = with_end(*encoder.encode(texts), end_id)
                doc_ids += keys[i:j]
                lengths.append(n)
                ids.append(flat)
                held += len(flat)
                if held >= file_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    spread = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    spread.mapInArrow(pack, "part int, part_start long, n_docs long, n_ids long, payload binary").write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32) from the files."""
    files = spark.read.parquet(path)
    # one row a partition of the writer: a short table, however many documents there are
    base = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids, n, ids = read_file(data.as_py())
                stop = np.cumsum(n)
                offsets = np.concatenate(([0], stop)).astype(np.int64) * 4
                flat = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
                yield batch(_DOC, doc_ids, start + stop - n, n, flat.cast(pa.binary()))

    small = files.select("part").distinct().limit(MOST_PARTS + 1).count() <= MOST_PARTS
    return files.join(F.broadcast(base) if small else base, "part").select((F.col("part_start") + F.col("base")).alias("start"), "payload").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")
