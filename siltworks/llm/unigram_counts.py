"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each
character of a word; dynamic programming carries the best score and that path's
number of pieces.  Words are independent (a piece holds the word mark at its
start only), so each distinct word is solved once per worker and documents sum
their words.

Tie rules are those of the ``tokenizers`` library's Unigram model: among
segmentations of a prefix the later of two equal scores doesn't replace the
earlier, where starts are tried from left to right; a character with no piece
of its own also has an unknown step, scored ten below the vocabulary's lowest
score, tried after the pieces from that start; unknown characters in a row are
one piece.

Cases: a null, empty or blank text has no pieces and a score of 0; a null
``doc_id`` stays; repeated rows each give a row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batch, distinct_spans, slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_pieces", pa.int64()), ("score", pa.float64())])


def zipf_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file in rank order, scored as by Zipf's law; control and byte pieces are left out.

    The installed vocabularies are of merge type and have ranks, no
    probabilities; nothing is trained here.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = sum(1 / (r + 10) for r in range(len(pieces)))
    return [(p, math.log(1 / (r + 10) / total)) for r, p in enumerate(pieces)]


class Counter:
    """Best scores and piece counts of words; keeps those of at most ``limit`` words."""

    def __init__(self, vocabulary: list[tuple[str, float]], limit: int = 500_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and MARK not in piece[1:]:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.limit = limit
        self.known: dict[bytes, tuple[int, float]] = {}

    def count(self, word: str) -> tuple[int, float]:
        """Pieces and score of ``word``, its mark included."""
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        pieces, unknown = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        found: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if len(self.automaton):
            for last, x in self.automaton.iter(word):
                found[last + 1].append(x)
        for end in range(1, n + 1):
            # longer pieces start further left and so come first; an unknown step comes last
            for length, score in sorted(found[end], reverse=True):
                start = end - length
                if best[start] is not None and (best[end] is None or best[start] + score > best[end]):
                    best[end], pieces[end], unknown[end] = best[start] + score, pieces[start] + 1, False
            if word[end - 1] not in self.single:
                start = end - 1
                if best[end] is None or best[start] + self.unknown > best[end]:
                    best[end], pieces[end], unknown[end] = best[start] + self.unknown, pieces[start] + (not unknown[start]), True
        return pieces[n], float(best[n])

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, pieces and score of each text."""
        w = Words(texts)
        n = np.diff(w.first)
        if not len(w.starts):
            return n, np.zeros(len(texts), np.int64), np.zeros(len(texts))
        at, back = distinct_spans(w.raw, w.starts, w.ends)
        if len(self.known) + len(at) > self.limit:
            self.known.clear()
        raw, values = w.raw.tobytes(), []
        for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True):
            key = raw[s:e]
            found = self.known.get(key)
            if found is None:
                found = self.known[key] = self.count(MARK + key.decode("utf-8", "replace"))
            values.append(found)
        pieces = np.fromiter((v[0] for v in values), np.int64, len(values))[back]
        score = np.fromiter((v[1] for v in values), np.float64, len(values))[back]
        doc = np.repeat(np.arange(len(texts)), n)
        return n, np.bincount(doc, pieces, len(texts)).astype(np.int64), np.bincount(doc, score, len(texts))


_counters: dict[int, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """doc_id, n_words, n_pieces, score of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary: a size of its own, not the data's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (key := hash(tuple(shared.value))) not in _counters:
            _counters.clear()
            _counters[key] = Counter(shared.value)
        for b in batches:
            for i, j, texts in slices(b.column(1)):
                yield batch(_OUT, b.column(0).slice(i, j - i), *_counters[key].texts(texts))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_pieces long, score double")
