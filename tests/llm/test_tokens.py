import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltworks.llm import packing, token_planes
from siltworks.llm.queries import END_ID, QUERIES, vocabulary
from siltworks.llm.tokens import SegmentEncoder

ODD = [None, "", " \n ", "The the don't l'été <|endoftext|> x", "a" * 3000, "w " * 9000, "3.14,15 ÉTÉ İß \x1c\x85 ≠", "The cat. Sat? Down!"]


def ids_of(text):
    t = SegmentEncoder.of(vocabulary()).tokenizer
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, END_ID], "<u4")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abZé'’ .,\n\t\x1c|<>endoftx!9ſK̀", max_size=40), min_size=1, max_size=6))
def test_encoder_equals_the_tokenizer(texts):
    e = SegmentEncoder.of(vocabulary())
    flat, n = e.encode([t.encode() for t in texts])
    expected = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(x) for x in expected]
    assert flat.tolist() == [i for x in expected for i in x]


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("n", [0, 1, 63, 1000])
def test_file_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 70_000, n).astype(np.uint32)
    lengths = np.array([n // 2, 0, n - n // 2], np.int64)
    data = token_planes.write_file([3, None, -5], lengths, ids, 64, bits, 1)
    got_ids, got_lengths, got = token_planes.read_file(data)
    assert got_ids == [3, None, -5] and got_lengths.tolist() == lengths.tolist() and (got == ids).all()


@pytest.mark.parametrize("bits", [1, 8])
def test_token_files(spark, docs, tmp_path, bits):
    rows = list(enumerate(ODD)) + [(2, "again"), (None, "no id")]
    token_planes.write_token_files(docs(rows), f"{tmp_path}/t", vocabulary(), END_ID, block_ids=64, file_ids=500, plane_bits=bits)
    out = token_planes.read_token_files(spark, f"{tmp_path}/t").orderBy("start").collect()
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1]))
    at = 0
    for r, (d, t) in zip(out, expected, strict=True):
        ids = ids_of(t)
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (d, at, len(ids), ids.tobytes())
        at += len(ids)


def test_token_files_of_nothing(spark, docs, tmp_path):
    token_planes.write_token_files(docs([(1, "a")]).limit(0), f"{tmp_path}/t", vocabulary(), END_ID)
    assert token_planes.read_token_files(spark, f"{tmp_path}/t").count() == 0


def test_op1_on_the_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    at = 0
    for r in QUERIES["op1_bit_planes"](spark, sf_dir).orderBy("doc_id").collect():
        ids = ids_of(texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def check_pieces(pieces, texts, length):
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for d, parts in by_doc.items():
        ids, at = ids_of(texts[d]), 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and bytes(r.ids) == ids[at : at + r.length].tobytes() and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding / max(1, sum(r.length for r in pieces))


@pytest.mark.parametrize("length,run", [(64, 100), (4096, 1 << 19)])
def test_packing_holds_every_id_once(docs, length, run):
    rows = list(enumerate(ODD))
    check_pieces(packing.pack(docs(rows), vocabulary(), END_ID, length=length, run_tokens=run).collect(), dict(rows), length)


def test_packing_edge_rows(docs):
    assert packing.pack(docs([(1, "a")]).limit(0), vocabulary(), END_ID).count() == 0
    out = packing.pack(docs([(1, "a b"), (1, "a b"), (None, None)]), vocabulary(), END_ID).collect()
    assert sum(r.length for r in out) == 7


def test_packing_pads_little(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check_pieces(packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), END_ID).collect(), texts, 4096) < 0.01


def brute_cut_cost(position, penalty, length):
    """Least padding plus penalties over all cuts; the part after the last inner cut is open."""
    p, pen = [0, *position], [0.0, *penalty]
    value = [0.0] + [float("inf")] * (len(p) - 1)
    for j in range(1, len(p)):
        value[j] = min((value[i] + pen[j] + length - (p[j] - p[i]) for i in range(j) if p[j] - p[i] <= length), default=float("inf"))
    return min(value[i] for i in range(len(p) - 1) if p[-1] - p[i] <= length)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from([0.0, 4.0, 24.0])), min_size=1, max_size=25))
def test_cuts_are_the_best(steps):
    position = np.cumsum([s for s, _ in steps])
    penalty = np.array([c for _, c in steps])
    cuts = packing.best_cuts(position, penalty, 20)
    assert cuts[-1] == position[-1] and set(cuts) <= set(position.tolist())
    edges = [0, *cuts]
    assert all(b - a <= 20 for a, b in zip(edges, edges[1:], strict=False))
    cost = sum(penalty[list(position).index(b)] + 20 - (b - a) for a, b in zip(edges[:-2], edges[1:-1], strict=True))
    assert cost == pytest.approx(brute_cut_cost(position.tolist(), penalty.tolist(), 20))


def test_words_that_collide_under_polynomial_hashes():
    """A Thue-Morse word of 1,024 letters and its complement keep their own ids and counts."""
    from siltworks.llm.unigram_counts import Counter

    t = "a"
    for _ in range(10):
        t += t.translate({97: 98, 98: 97})
    c = t.translate({97: 98, 98: 97})
    e = SegmentEncoder.of(vocabulary())
    flat, n = e.encode([t.encode(), c.encode()])
    expected = [e.tokenizer.encode(x, add_special_tokens=False).ids for x in (t, c)]
    assert n.tolist() == [len(x) for x in expected] and flat.tolist() == expected[0] + expected[1]
    counter = Counter([("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -2.5)])
    assert counter.texts([t.encode(), c.encode()])[1].tolist() == [counter.count("▁" + x)[0] for x in (t, c)]
