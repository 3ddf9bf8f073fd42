import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltworks.llm import token_alignment as T
from siltworks.llm.queries import QUERIES, vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ODD = [None, "", " ", "  two  spaces ", "a\nb\n\nc \n d", "don't stop, won't. www.x.org/a?b=1", "l'été à Ñandú, “quoted” — dash", "▁x y▁ z", "<|endoftext|> <s> <0x41>", "\x00\t\r\n\x1c\x85\xa0end", "日本語 🙂🙂 é", "w " * 9000, "a" * 3000, "The cat.\nThe cat.\n", "x> y>z"]
FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Brute:
    """Whole texts, token by token."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.letters = T.byte_alphabet()

    def tokens(self, text):
        want = (" " + (text or "")).encode()
        a = self.a.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(self.letters[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i in self.b.encode(text or "") for p in [self.b.id_to_piece(i)]]
        fine = text and b"".join(x for _, x in a) == want == b"".join(x for _, x in b)
        return (a, b) if fine else ([], [])

    def align(self, text):
        """n_a, n_b, groups, links of one text."""
        a, b = self.tokens(text)
        links, groups, i, j, p, q = [], [], 0, 0, 0, 0
        one, two = [], []
        while i < len(a) or j < len(b):
            if p <= q and i < len(a):
                one.append((p, p + len(a[i][1]), a[i][0]))
                p += len(a[i][1])
                i += 1
            else:
                two.append((q, q + len(b[j][1]), b[j][0]))
                q += len(b[j][1])
                j += 1
            if p == q:
                groups.append(",".join(str(x[2]) for x in one) + "|" + ",".join(str(x[2]) for x in two))
                links += [(x[2], y[2]) for x in one for y in two if max(x[0], y[0]) < min(x[1], y[1])]
                one, two = [], []
        return len(a), len(b), groups, links

    def table(self, texts):
        found = [self.align(t) for t in texts]
        count = Counter(x for f in found for x in f[3])
        most = defaultdict(int)
        for (_, b), n in count.items():
            most[b] = max(most[b], n)
        out = []
        for n_a, n_b, groups, links in found:
            sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
            out.append((n_a, n_b, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha))
        return out


BRUTE = Brute()
letters = st.text(alphabet="abZé'’ .,>\n\t\x1c\xa0▁<|s0-9!日🙂\r", max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(letters, min_size=1, max_size=5))
def test_segments_are_those_of_whole_texts(texts):
    tool = T.aligner(A, B)
    assert tool.split and tool.word
    segment, n = tool.segments([t.encode() for t in texts])
    for t, part in zip(texts, np.split(segment, np.cumsum(n)[:-1]), strict=True):
        n_a, n_b, groups, links = BRUTE.align(t)
        if not t or not tool.fine[part].all():
            assert not links
            continue
        said = tool.text[T.spans(tool.begin, part)].tobytes().decode()
        assert said == "".join(g + ";" for g in groups)
        assert tool.stats[part].sum(axis=0).tolist() == [n_a, n_b, len(groups)]
        pairs = tool.pairs[T.spans(tool.first, part)]
        assert sorted(zip((pairs >> 24).tolist(), (pairs & 0xFFFFFF).tolist(), strict=True)) == sorted(links)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 6), st.integers(0, 90)), st.integers(1, 300), max_size=120))
def test_postings_round_trip_counts_and_union(entries):
    keys = sorted(entries)
    pair, doc = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
    times = np.array([entries[k] for k in keys], np.int64)
    parts = []
    for low, high in ((0, 40), (40, 91)):
        at = (doc >= low) & (doc < high)
        parts.append(T.Postings.of(high - low, pair[at] * 1000, doc[at] - low, times[at]))
    got = T.Postings.load(T.Postings.union([T.Postings.load(p.dump()) for p in parts]).dump())
    docs, links = got.counts()
    assert got.n == 91 and got.pairs.tolist() == sorted({k[0] * 1000 for k in keys})
    assert docs.tolist() == [sum(k[0] * 1000 == p for k in keys) for p in got.pairs]
    assert links.tolist() == [sum(v for k, v in entries.items() if k[0] * 1000 == p) for p in got.pairs]
    values = np.arange(len(got.pairs)) * 7 + 1
    place = {p: i for i, p in enumerate(got.pairs.tolist())}
    assert got.sums(values).tolist() == [sum(v * int(values[place[k[0] * 1000]]) for k, v in entries.items() if k[1] == d) for d in range(91)]


@pytest.mark.parametrize("links,segments", [(1 << 22, 700_000), (40, 5)])
def test_alignment(docs, monkeypatch, links, segments):
    """Also with small blocks; the worker's limits are the module's, so they are set through a fresh builder."""
    rows = [*enumerate(ODD), (3, "the cat"), (3, "the cat"), (None, "no id"), (None, None)]
    out = T.Alignment(docs(rows), A, B).documents().collect()
    expected = BRUTE.table([t for _, t in rows])
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r.doc_id, *(r[f] for f in FIELDS)) for r in out), key=key) == sorted(((d, *e) for (d, _), e in zip(rows, expected, strict=True)), key=key)
    monkeypatch.setattr(T, "BLOCK_LINKS", links)
    monkeypatch.setattr(T, "MOST_SEGMENTS", segments)
    import pyarrow as pa

    builder, blocks, texts = T.Builder(T.aligner(A, B)), [], [(t or "").encode() for _, t in rows]
    ids = pa.array([d for d, _ in rows], pa.int64())
    while texts:
        n = builder.add(ids, texts)
        ids, texts = ids.slice(n), texts[n:]
        if builder.full():
            blocks.append(builder.flush(len(blocks)))
    if builder.parts:
        blocks.append(builder.flush(len(blocks)))
    got = Counter()
    for b in blocks:
        p = T.Postings.load(b["postings"][0].as_py())
        got.update(dict(zip(p.pairs.tolist(), p.counts()[1].tolist(), strict=True)))
    assert got == Counter(a << 24 | b for _, t in rows for a, b in BRUTE.align(t)[3])
    assert (len(blocks) > 3) == (links == 40)
    T.aligner(A, B).clear()


def test_pairs_and_holders(spark, docs):
    texts = ["the cat sat", "the the dog", None, "a dog. the end"]
    found = T.Alignment(docs(list(enumerate(texts))), A, B)
    links = [Counter(BRUTE.align(t)[3]) for t in texts]
    total, held = Counter(), Counter()
    for x in links:
        total.update(x)
        held.update(x.keys())
    most = defaultdict(int)
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    assert {(r.a, r.b): (r.docs, r.links, r.best) for r in found.pairs.collect()} == {k: (held[k], n, n == most[k[1]]) for k, n in total.items()}
    wanted = [k for k, n in total.items() if n > 1]
    got = {(r.a, r.b, r.doc_id): r.times for r in found.holders(spark.createDataFrame([*wanted, (1, 1)], "a int, b int")).collect()}
    assert got == {(*k, d): x[k] for d, x in enumerate(links) for k in wanted if x[k]}


def test_alignment_of_nothing(docs):
    assert T.Alignment(docs([(1, "a")]).limit(0), A, B).documents().count() == 0


def test_op13_on_the_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in QUERIES["op13_token_alignment"](spark, sf_dir).collect()}
    assert got == dict(zip([r.doc_id for r in rows], BRUTE.table([r.text for r in rows]), strict=True))
