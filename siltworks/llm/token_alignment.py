"""Links between two tokenizers' tokens, counted corpus-wide by inverted pair bitmaps.

Every text is cut at the bytes where tokens of both tokenizers end; tokens whose
byte ranges overlap are linked.  Between two neighbouring ends of either
tokenizer lies exactly one link.

Postings: for each block of documents and each linked id pair there is a
compressed bitmap of the block's documents for each bit of the pair's
multiplicity in a document (sorted places for sparse ones, bits for dense ones).
Tasks build postings by slices of documents and OR-merge them into blocks.
A pair's documents are the population count of its planes' union, and its links
the planes' counts times their powers of two, added over blocks, which share no
document.  Scores then return through the postings: each block asks for its own
pairs' scores and adds them up over its bitmaps' documents.  Texts are read and
encoded once.

Texts are cut into segments before a single space or line feed between other
characters, and between a letter and punctuation, where neither tokenizer's
tokens can span (checked on the vocabularies; otherwise whole texts are
segments), and each distinct segment is encoded and aligned once per worker.

Memory: a worker keeps at most ``MOST_SEGMENTS`` segments; a block ends at the
first document that brings it to ``BLOCK_LINKS`` links or 65,536 documents.

Cases: texts that are null or empty, or that the second tokenizer doesn't keep
byte by byte, have zeros and ''; a null ``doc_id`` comes back as null; repeated
rows are documents of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, distinct_spans, slices
from .tables import Tables

#: Segments that a worker remembers; links and documents of a block.
MOST_SEGMENTS, BLOCK_LINKS, BLOCK_DOCS = 700_000, 1 << 22, 1 << 16
#: A bitmap with more than one document in so many is stored as bits.
DENSE = 16
_MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


# ---------------------------------------------------------------- segments


#: Segments of these letters alone are one word to the first tokenizer's splitting.
_WORD = re.compile("(?=.)[ ]?[A-Za-zÀ-ÖØ-öø-ɏ]*")
_LETTER, _PUNCTUATION = (np.array([k in range(*r[0]) or any(k in range(*x) for x in r[1:]) for k in range(256)]) for r in (((65, 91), (97, 123)), ((33, 48), (58, 65), (91, 97), (123, 127))))
#: A link's id pair is one number.
_SHIFT = 24
_LOW = (1 << _SHIFT) - 1


class Aligner:
    """Aligns segments of texts; remembers each distinct one."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = byte_alphabet()
        self.shown = {byte: c for c, byte in letters.items()}
        a_bytes = [b"" for _ in range(self.a.get_vocab_size())]
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            a_bytes[i] = bytes(letters[c] for c in token)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(_MARK, " ").encode() for i, x in enumerate(names)]
        if max(len(a_bytes), len(names)) >= 1 << 23:
            raise ValueError("vocabularies of 2 ** 23 ids and more don't fit a pair's number")
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (a_bytes, self.b_bytes))
        #: Ids in decimal with room for a separator.
        self.digits = np.zeros((max(len(a_bytes), len(names)), 8), np.uint8)
        self.n_digits = np.array([len(str(k)) for k in range(len(self.digits))])
        for k in range(len(self.digits)):
            self.digits[k, : self.n_digits[k]] = np.frombuffer(str(k).encode(), np.uint8)
        # segments: one tokenizer splits at white space and before punctuation, the other has no piece over a segment's edge
        whole = json.loads(self.a.to_str())
        split = whole["normalizer"] is None and whole["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        usual = [x for i, x in enumerate(names) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.split = split and not any(_MARK in x.lstrip(_MARK) or "\n" in x for x in usual) and self.b.encode(" \na", out_type=str)[0] == _MARK * 2
        self.word = split and whole["model"]["type"] == "BPE" and not whole["model"].get("ignore_merges")
        self.apart = _LETTER[:, None] & _PUNCTUATION
        for x in usual:
            x = x.encode()
            for k in range(len(x) - 1):
                self.apart[x[k], x[k + 1]] = False
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        #: Tokens of either kind, groups, and whether the bytes are kept; links, and the groups as text, from ``first`` and ``begin`` on.
        self.stats, self.fine = np.zeros((0, 3), np.int64), np.zeros(0, bool)
        self.first, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.begin, self.text = np.zeros(1, np.int64), np.zeros(0, np.uint8)

    def _encode_a(self, keys: list[bytes], texts: list[str]) -> list[list[int]]:
        whole, model = _WORD.fullmatch, self.a.model.tokenize
        out = [[t.id for t in model(k.decode("latin-1").translate(self.shown))] if self.word and whole(x) else None for k, x in zip(keys, texts, strict=True)]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.a.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    def _encode_b(self, texts: list[str]) -> list[list[int]]:
        """The tokenizer adds a space itself; before a line feed, which no piece holds, it is a piece of its own."""
        lead = [0 if t[:1] == " " else 1 if t[:1] == "\n" else 2 for t in texts]
        out = self.b.encode([t[1:] if n == 0 else t if n == 1 else "\n" + t for t, n in zip(texts, lead, strict=True)], num_threads=1)
        return [x[n:] if n else x for x, n in zip(out, lead, strict=True)]

    def learn(self, keys: list[bytes]) -> None:
        """Encode and align new segments."""
        texts = [k.decode() for k in keys]
        a, b, kept = self._encode_a(keys, texts), self._encode_b(texts), [True] * len(keys)
        ids_b = np.fromiter(chain.from_iterable(b), np.int64)
        if b"".join(map(self.b_bytes.__getitem__, ids_b.tolist())) != b"".join(keys):
            kept = [b"".join(map(self.b_bytes.__getitem__, x)) == k for x, k in zip(b, keys, strict=True)]
            a, b = ([x if ok else [] for x, ok in zip(t, kept, strict=True)] for t in (a, b))
            ids_b = np.fromiter(chain.from_iterable(b), np.int64)
        n_a, n_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (a, b))
        ids_a = np.fromiter(chain.from_iterable(a), np.int64)
        end_a, end_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        ends = np.union1d(end_a, end_b)
        links = ids_a[np.searchsorted(end_a, ends)] << _SHIFT | ids_b[np.searchsorted(end_b, ends)]
        stop = np.cumsum(np.where(kept, np.fromiter(map(len, keys), np.int64, len(keys)), 0))
        per = np.diff(np.searchsorted(ends, stop, "right"), prepend=0)
        # groups end where both end
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        groups = np.diff(np.searchsorted(both, stop, "right"), prepend=0)
        text, lengths = self._shown(ids_a, ids_b, np.searchsorted(both, end_a), np.searchsorted(both, end_b), len(both))
        size = np.diff(np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(both, stop, "right")], prepend=0)
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys)), strict=True))
        self.stats = np.concatenate((self.stats, np.stack((n_a, n_b, groups), axis=1)))
        self.fine = np.concatenate((self.fine, np.array(kept, bool)))
        self.first, self.pairs = np.concatenate((self.first, self.first[-1] + np.cumsum(per))), np.concatenate((self.pairs, links))
        self.begin, self.text = np.concatenate((self.begin, self.begin[-1] + np.cumsum(size))), np.concatenate((self.text, text))

    def _shown(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Groups as text, ``a1,a2|b1;`` each, and the length of each."""
        ids, of_b = np.concatenate((ids_a, ids_b)), np.repeat([False, True], [len(ids_a), len(ids_b)])
        side = 2 * np.concatenate((group_a, group_b)) + of_b
        order = np.argsort(side, kind="stable")
        ids, of_b, side = ids[order], of_b[order], side[order]
        last = np.append(side[1:] != side[:-1], True) if len(side) else np.zeros(0, bool)
        rows, width = self.digits[ids], self.n_digits[ids]
        rows[np.arange(len(ids)), width] = np.where(last, np.where(of_b, ord(";"), ord("|")), ord(","))
        return rows[np.arange(8) <= width[:, None]], np.bincount(side >> 1, width + 1, n).astype(np.int64)

    def segments(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each segment of " " + text of all texts, one after another, and each text's number of segments."""
        data = np.frombuffer(b"".join(b" " + t for t in texts) + b" ", np.uint8)
        edge = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
        begin = np.zeros(len(data), bool)
        if self.split:
            space = white(data)
            begin[1:-1] = ((data[1:-1] == 32) | (data[1:-1] == 10)) & ~space[:-2] & ~space[2:]
            begin[1:] |= self.apart[data[:-1], data[1:]]
        begin[edge] = True
        starts = np.flatnonzero(begin)
        first = np.searchsorted(starts, edge)
        starts, ends = starts[:-1], starts[1:]
        at, back = distinct_spans(data, starts, ends)
        if len(self.known) + len(at) > MOST_SEGMENTS:
            self.clear()
        raw = data.tobytes()
        keys = [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        if new := [k for k in keys if k not in self.known]:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[back], np.diff(first)


def spans(first: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places of spans ``first[k]`` to ``first[k + 1]`` for each k of ``which``, one after another."""
    size = first[which + 1] - first[which]
    return np.repeat(first[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


#: Lead bytes of characters beyond ASCII that are white space, and what may follow (None: anything).
_WIDE = {b"\xc2": (b"\x85", b"\xa0"), b"\xe1": (b"\x9a\x80",), b"\xe2": (*(b"\x80" + bytes([k]) for k in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f"), b"\xe3": (b"\x80\x80",)}


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space of any kind (the ASCII separators 28 to 31 too)."""
    table = np.zeros(256, bool)
    table[[*range(9, 14), *range(28, 33)]] = True
    out = table[data]
    for lead, rest in _WIDE.items():
        at = np.flatnonzero(data == lead[0])
        for r in rest:
            hit = at[at + len(r) < len(data)]
            for k, byte in enumerate(r):
                hit = hit[data[hit + k + 1] == byte]
            for k in range(len(r) + 1):
                out[hit + k] = True
    return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_level: str, pieces: str) -> Aligner:
    if (byte_level, pieces) not in _aligners:
        _aligners[byte_level, pieces] = Aligner(byte_level, pieces)
    return _aligners[byte_level, pieces]


# ---------------------------------------------------------------- postings


class Postings:
    """Bitmaps over a block's ``n`` documents: by plane, which pairs have one, its form, and its places or bits."""

    def __init__(self, n: int, pairs: np.ndarray, planes: list[tuple[np.ndarray, ...]]):
        self.n, self.pairs, self.planes = n, pairs, planes

    @classmethod
    def of(cls, n: int, pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> Postings:
        """From entries sorted by pair and document."""
        new = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.empty(0, np.int64)
        pairs, no = pair[new], np.repeat(np.arange(len(new)), np.diff(np.append(new, len(pair))))
        planes, bit = [], 0
        while (times >> bit).any():
            at = (times >> bit) & 1 == 1
            planes.append(cls._pack(n, no[at], doc[at]))
            bit += 1
        return cls(n, pairs, planes)

    @staticmethod
    def _pack(n: int, no: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """(pairs with sorted places, their numbers of places, places; pairs with bits, bits)."""
        row, count = np.unique(no, return_counts=True)
        dense = count * DENSE > n
        bits_of = row[dense]
        inside = np.repeat(dense, count)
        wide = np.zeros((len(bits_of), n), bool)
        wide[np.searchsorted(bits_of, no[inside]), doc[inside]] = True
        return row[~dense].astype("<u4"), count[~dense].astype("<u4"), doc[~inside].astype("<u2"), bits_of.astype("<u4"), np.packbits(wide, axis=1, bitorder="little")

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the pair, document, multiplicity's bit) of all planes' documents."""
        out = []
        for bit, (row, count, places, dense, bits) in enumerate(self.planes):
            r, d = np.nonzero(np.unpackbits(bits, axis=1, count=self.n, bitorder="little"))
            no, doc = np.concatenate((np.repeat(row, count), dense[r])), np.concatenate((places, d))
            out.append((no.astype(np.int64), doc.astype(np.int64), np.full(len(no), bit, np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents and links of each pair, by population counts of the planes' union and of the planes."""
        docs, links = np.zeros(len(self.pairs), np.int64), np.zeros(len(self.pairs), np.int64)
        for bit, (row, count, _, dense, bits) in enumerate(self.planes):
            links[row] += count.astype(np.int64) << bit
            links[dense] += np.bitwise_count(bits).sum(axis=1, dtype=np.int64) << bit
        no, doc, _ = self.entries()
        key = np.sort(no << 16 | doc)
        docs += np.bincount(key[np.diff(key, prepend=-1) != 0] >> 16, minlength=len(self.pairs))
        return docs, links

    @classmethod
    def union(cls, parts: list[Postings]) -> Postings:
        """OR-merge the postings of consecutive slices of one block's documents."""
        n, planes = sum(p.n for p in parts), []
        pairs = np.unique(np.concatenate([p.pairs for p in parts]))
        starts = np.cumsum([0, *(p.n for p in parts)])
        shifted = []
        for p, start in zip(parts, starts, strict=False):
            no, doc, bit = p.entries()
            shifted.append((np.searchsorted(pairs, p.pairs)[no], doc + start, bit))
        no, doc, bit = (np.concatenate(x) for x in zip(*shifted, strict=True))
        for k in range(int(bit.max(initial=-1)) + 1):
            key = np.sort(no[bit == k] << 16 | doc[bit == k])
            planes.append(cls._pack(n, key >> 16, key & 0xFFFF))
        return cls(n, pairs, planes)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each document, the sum of its pairs' ``values`` times their multiplicity."""
        no, doc, bit = self.entries()
        out = np.zeros(self.n, np.int64)
        np.add.at(out, doc, values[no] << bit)
        return out

    def dump(self) -> bytes:
        """All arrays one after another, each with its length, compressed; sorted ids and places as differences."""
        body = []
        for x in (self.pairs.astype("<i8"), *chain.from_iterable(self.planes)):
            x = np.ascontiguousarray(x).ravel()
            body += [np.array([len(x)], "<u4").tobytes(), np.diff(x, prepend=x.dtype.type(0)).tobytes() if x.dtype.itemsize > 1 else x.tobytes()]
        return zstandard.ZstdCompressor(level=1).compress(np.array([self.n, len(self.planes)], "<u4").tobytes() + b"".join(body))

    @classmethod
    def load(cls, data: bytes) -> Postings:
        data = zstandard.ZstdDecompressor().decompress(data)
        n, n_planes = (int(x) for x in np.frombuffer(data, "<u4", 2))
        at = 8

        def take(kind: str) -> np.ndarray:
            nonlocal at
            size = int(np.frombuffer(data, "<u4", 1, at)[0])
            x = np.frombuffer(data, kind, size, at + 4)
            at += 4 + x.nbytes
            return np.cumsum(x, dtype=x.dtype) if x.dtype.itemsize > 1 else x

        pairs, planes = take("<i8"), []
        for _ in range(n_planes):
            row, count, places, dense, bits = (take(k) for k in ("<u4", "<u4", "<u2", "<u4", "u1"))
            planes.append((row, count, places, dense, bits.reshape(len(dense), -(-n // 8))))
        return cls(n, pairs.astype(np.int64), planes)


_BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("postings", pa.binary())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])


def _ipc(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema) as out:
        out.write_batch(b)
    return sink.getvalue().to_pybytes()


class Builder:
    """Builds one block after another from slices of documents."""

    def __init__(self, tool: Aligner):
        self.tool, self.parts, self.docs, self.links = tool, [], [], 0

    def add(self, ids: pa.Array, texts: list[bytes]) -> int:
        """Add documents; the number that the block takes."""
        tool = self.tool
        segment, n = tool.segments(texts)
        doc = np.repeat(np.arange(len(texts)), n)
        bad = np.array([not t for t in texts])
        bad[doc[~tool.fine[segment]]] = True
        links = np.diff(tool.first)
        per = np.where(bad, 0, np.bincount(doc, links[segment], len(texts)).astype(np.int64))
        room = min(len(texts), BLOCK_DOCS - sum(p.n for p in self.parts))
        taken = min(room, 1 + int(np.searchsorted(np.cumsum(per), max(1, BLOCK_LINKS - self.links))))
        use = ~bad[doc] & (doc < taken)
        segment, doc = segment[use], doc[use]
        stats = np.stack([np.bincount(doc, tool.stats[segment, k], taken) for k in range(3)]).astype(np.int64)
        said = tool.text[spans(tool.begin, segment)].tobytes()
        edge = np.concatenate(([0], np.cumsum(np.bincount(doc, np.diff(tool.begin)[segment], taken)))).astype(np.int64).tolist()
        hashes = ["" if bad[i] else hashlib.sha256(said[edge[i] : edge[i + 1] - 1]).hexdigest() for i in range(taken)]
        self.docs.append(batch(_DOCS, ids.slice(0, taken), *stats, per[:taken], hashes))
        key = np.sort(tool.pairs[spans(tool.first, segment)] << 16 | np.repeat(doc, links[segment]))
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        self.parts.append(Postings.of(taken, key[edge] >> 16, key[edge] & 0xFFFF, np.diff(np.append(edge, len(key)))))
        self.links += int(per[:taken].sum())
        return taken

    def full(self) -> bool:
        return self.links >= BLOCK_LINKS or sum(p.n for p in self.parts) >= BLOCK_DOCS

    def flush(self, block: int) -> pa.RecordBatch:
        docs = pa.Table.from_batches(self.docs).combine_chunks().to_batches()[0]
        out = batch(_BLOCK, [block], [_ipc(docs)], [Postings.union(self.parts).dump()])
        self.parts, self.docs, self.links = [], [], 0
        return out


class Alignment:
    """A corpus's alignment: its blocks (a written table), and ``pairs`` (a, b, docs, links, best)."""

    def __init__(self, docs: DataFrame, byte_level: str, pieces: str):
        tables = Tables(docs.sparkSession, "alignment")

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            builder, part, no = Builder(aligner(byte_level, pieces)), TaskContext.get().partitionId(), 0
            for b in batches:
                for i, j, texts in slices(b.column(1)):
                    ids = b.column(0).slice(i, j - i)
                    while texts:
                        n = builder.add(ids, texts)
                        ids, texts = ids.slice(n), texts[n:]
                        if builder.full():
                            yield builder.flush(part << 32 | no)
                            no += 1
            if builder.parts:
                yield builder.flush(part << 32 | no)

        rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        self.blocks = tables.keep(rows.mapInArrow(build, "block long, docs binary, postings binary"), "blocks")
        self.by_block = self.blocks.select("block", "postings").mapInArrow(_pair_counts, "block long, a int, b int, docs long, links long")
        total = tables.keep(self.by_block.groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links")), "pairs")
        # a row for each id of the second vocabulary: bounded by its size
        most = F.broadcast(total.groupBy("b").agg(F.max("links").alias("most")))
        self.pairs = total.join(most, "b").select("a", "b", "docs", "links", (F.col("links") == F.col("most")).alias("best"))

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
        asked = self.by_block.select("block", "a", "b").join(self.pairs.select("a", "b", "links", "best"), ["a", "b"])
        replies = asked.select("block", F.shiftleft(F.col("a").cast("long"), _SHIFT).bitwiseOR(F.col("b").cast("long")).alias("pair"), "links", "best")

        def back(block: pa.Table, scores: pa.Table) -> pa.Table:
            out = []
            for docs, data in zip(block["docs"].to_pylist(), block["postings"].to_pylist(), strict=True):
                postings = Postings.load(data)
                order = np.argsort(scores["pair"].to_numpy())
                links = scores["links"].to_numpy()[order]
                best = scores["best"].to_numpy(zero_copy_only=False).astype(np.int64)[order]
                table = pa.ipc.open_stream(docs).read_all()
                out.append(table.append_column("n_best", pa.array(postings.sums(best))).append_column("count_sum", pa.array(postings.sums(links))))
            return pa.concat_tables(out).select(_RESULT)

        return self.blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(back, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

    def holders(self, wanted: DataFrame) -> DataFrame:
        """(a, b, doc_id, times) of each document that holds a pair of ``wanted`` (a, b): the postings read by pair."""
        asked = self.by_block.select("block", "a", "b").join(wanted.select("a", "b").distinct(), ["a", "b"])

        def find(block: pa.Table, pairs: pa.Table) -> pa.Table:
            out = [pa.table({n: pa.array([], t) for n, t in (("a", pa.int32()), ("b", pa.int32()), ("doc_id", pa.int64()), ("times", pa.int64()))})]
            if pairs.num_rows:
                key = pairs["a"].to_numpy().astype(np.int64) << _SHIFT | pairs["b"].to_numpy()
                for docs, data in zip(block["docs"].to_pylist(), block["postings"].to_pylist(), strict=True):
                    postings, ids = Postings.load(data), pa.ipc.open_stream(docs).read_all()["doc_id"]
                    no, doc, bit = postings.entries()
                    at = np.isin(postings.pairs[no], key)
                    held, back = np.unique(no[at] << 16 | doc[at], return_inverse=True)
                    times = np.zeros(len(held), np.int64)
                    np.add.at(times, back, np.int64(1) << bit[at])
                    pair = postings.pairs[held >> 16]
                    out.append(pa.table({"a": (pair >> _SHIFT).astype(np.int32), "b": (pair & _LOW).astype(np.int32), "doc_id": ids.take(pa.array(held & 0xFFFF)).combine_chunks(), "times": times}))
            return pa.concat_tables(out)

        return self.blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(find, "a int, b int, doc_id long, times long")


_RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
_COUNTS = pa.schema([("block", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64()), ("links", pa.int64())])


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for block, data in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
            postings = Postings.load(data.as_py())
            docs, links = postings.counts()
            if len(docs):
                yield batch(_COUNTS, np.full(len(docs), block), (postings.pairs >> _SHIFT).astype(np.int32), (postings.pairs & _LOW).astype(np.int32), docs, links)
