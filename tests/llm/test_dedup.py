import random

import brute
import numpy as np
import pytest

from siltworks.llm import common, jaccard_join, line_dedup, substring_dedup
from siltworks.llm.queries import QUERIES

WORDS = [f"w{i}" for i in range(400)]


def corpus(n, seed):
    """Texts with copies, near copies, shared passages, odd rows, and one large group of near copies."""
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 160))) for _ in range(n)]
    passage = " ".join(r.choice(WORDS) for _ in range(60))
    hub = [r.choice(WORDS) for _ in range(80)]
    out = []
    for t in base:
        out.append(t)
        w = t.split()
        if r.random() < 0.3:
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = "edit" + str(r.randrange(10**6))
            out.append(" ".join(w))
        if r.random() < 0.2:
            out.append(t)
        if r.random() < 0.2:
            out.append(" ".join(w[: len(w) // 2]) + "\n" + passage + "\n" + " ".join(w[len(w) // 2 :]))
    for _ in range(n):
        w = list(hub)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(10**6))
        out.append(" ".join(w))
    out += [None, "", " \n\t ", "one", "one two", "One TWO", "x " * 3000]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_all_pairs(docs, seed):
    rows = corpus(60, seed)
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(docs(rows)).collect())
    assert got == sorted(brute.components(rows))


def test_components_of_odd_rows(docs):
    rows = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "A b c d e f"), (3, "p q r s t u"), (4, None), (4, "z")]
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(docs(rows)).collect())
    assert got == sorted(brute.components(rows))
    assert [r.component_id for r in jaccard_join.near_duplicates(docs([(None, "a b c d e f"), (None, "a b c d e f")])).collect()] == [None, None]
    assert jaccard_join.near_duplicates(docs([(1, "a")]).limit(0)).count() == 0


def short_and_long_rows():
    """7- and 8-word texts that link, their copies, and longer texts that share their shingles and sort first."""
    r, out = random.Random(9), []
    for _ in range(12):
        w = [r.choice(WORDS) + str(r.randrange(10**6)) for _ in range(8)]
        more = " ".join(r.choice(WORDS) for _ in range(30))
        out += [" ".join(w[:7])] * 6 + [" ".join(w)] * 6 + [" ".join(w) + " " + more] * 3 + [" ".join(w[1:]) + " " + " ".join(r.choice(WORDS) for _ in range(12)) for _ in range(30)]
    r.shuffle(out)
    return list(enumerate(out))


def test_links_of_short_texts_stay(docs):
    rows = short_and_long_rows()
    assert sorted(tuple(r) for r in jaccard_join.near_duplicates(docs(rows)).collect()) == sorted(brute.components(rows))


@pytest.mark.parametrize("pairs_a_row", [1, None])
def test_near_copies_that_do_not_link_with_their_leader(docs, monkeypatch, pairs_a_row):
    """A group with up to six edits each: some link with few others only, which takes the pair join, after several rounds where these start at fewer pairs."""
    monkeypatch.setattr(jaccard_join, "PAIRS_A_ROW", pairs_a_row or jaccard_join.PAIRS_A_ROW)
    r = random.Random(11)
    base = [f"{x}{i}" for i, x in enumerate(r.choice(WORDS) for _ in range(150))]
    rows = []
    for d in range(250):
        w = list(base)
        for at in r.sample(range(15), r.randint(1, 6)):
            w[at * 10] = r.choice("abc") + str(at)
        rows.append((d, " ".join(w)))
    rounds, pairs = [], jaccard_join._leader_pairs
    monkeypatch.setattr(jaccard_join, "_leader_pairs", lambda open_, no: rounds.append(no) or pairs(open_, no))
    got = sorted(tuple(x) for x in jaccard_join.near_duplicates(docs(rows)).collect())
    assert got == sorted(brute.components(rows)) and (pairs_a_row is None or len(rounds) > 1) and len({x[2] for x in got}) > 3


def thue_morse(n=10):
    """A word of 2 ** n letters and its complement, which collide under polynomial hashes modulo a power of two."""
    t = "a"
    for _ in range(n):
        t += t.translate({97: 98, 98: 97})
    return t, t.translate({97: 98, 98: 97})


def test_words_that_collide_under_polynomial_hashes(docs):
    t, c = thue_morse()
    tail = " ".join(WORDS[:60])
    rows = [(1, f"p q {t} r s"), (2, f"p q {c} r s"), (3, f"{t} {tail}"), (4, f"{c} {tail}"), (5, f"{t} " + " ".join(WORDS[100:149])), (6, f"{c} " + " ".join(WORDS[100:149]))]
    assert sorted(tuple(r) for r in jaccard_join.near_duplicates(docs(rows)).collect()) == sorted(brute.components(rows))
    assert digest(substring_dedup.remove_repeats(docs(rows))) == sorted(brute.without_repeats(rows), key=str)


def test_equal_spans_are_equal_bytes(monkeypatch):
    texts = [b"aa b aa " + b"x" * 20 + b" b " + b"y" * 20]
    w = common.Words(texts)
    expected = [0, 1, 0, 2, 1, 3]
    for broken in (False, True):
        if broken:
            monkeypatch.setattr(common, "hash_spans", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
        at, back = common.distinct_spans(w.raw, w.starts, w.ends)
        word = lambda i: w.raw[w.starts[i] : w.ends[i]].tobytes()
        assert [word(at[b]) for b in back] == [word(i) for i in range(6)] and len(at) == 4
        assert (back[:, None] == back).tolist() == (np.array(expected)[:, None] == np.array(expected)).tolist()


@pytest.mark.parametrize("n", range(1, 12))
@pytest.mark.parametrize("frequent", [1, 100000])
def test_prefixes_ask_for_no_more_than_a_link_shares(n, frequent):
    flag, cost = np.ones(n, bool), np.full(n, frequent)
    l, length = jaccard_join.choose_prefix(flag, cost)
    least = -(-jaccard_join.SIMILAR * n // 100)
    assert l <= least and length == n - least + l


def test_keep_one_keeps_columns(docs):
    df = docs([(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "other words are here now"), (None, "a b c d e f"), (4, None), (5, None), (6, "six"), (6, "six")])
    out = jaccard_join.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 3, 4, 5, 6]


def test_op3_on_the_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op3_jaccard_join"](spark, sf_dir).collect()) == sorted(brute.components(rows))


def test_cover_is_a_difference_cover():
    d = substring_dedup.COVER
    assert {(a - b) % substring_dedup.PERIOD for a in d for b in d} == set(range(substring_dedup.PERIOD))


def digest(df):
    import hashlib

    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_repeats_match_all_windows(docs, seed):
    rows = corpus(50, seed)
    assert digest(substring_dedup.remove_repeats(docs(rows))) == sorted(brute.without_repeats(rows), key=str)


def test_repeats_of_odd_rows(docs):
    long = " ".join(WORDS[:70])
    rows = [(5, long), (5, long), (3, "x " + long), (None, long), (9, None), (9, long + " y")]
    assert digest(substring_dedup.remove_repeats(docs(rows))) == sorted(brute.without_repeats(rows), key=str)
    assert substring_dedup.remove_repeats(docs([(1, "a")]).limit(0)).count() == 0


def test_op5_on_the_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op5_difference_cover"](spark, sf_dir).collect()) == sorted(brute.without_repeats(rows))


def similar_lines(rows):
    lines = []
    for d, t in rows:
        if d is not None and t is not None:
            lines += [(d, i, frozenset(brute.words(x.lower()))) for i, x in enumerate(t.split("\n"))]
    lines = sorted(((d, i, s) for d, i, s in lines if s), key=lambda x: x[:2])
    return {(d, i) for d, i, s in lines for e, j, z in lines if (e, j) < (d, i) and 100 * len(s & z) >= line_dedup.SIMILAR * len(s | z)}


def line_rows(seed):
    r = random.Random(seed)
    base = [[r.choice(WORDS) for _ in range(r.randint(1, 40))] for _ in range(30)]
    out = []
    for d in range(40):
        lines = []
        for _ in range(r.randint(1, 6)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = "edit" + str(r.randrange(10**6))
            lines.append(" ".join(w))
        out.append((d, "\n".join(lines)))
    return [*out, (100, None), (101, ""), (102, "\n\n"), (None, out[0][1])]


@pytest.mark.parametrize("seed", [5, 6])
def test_lines_match_all_pairs(docs, seed):
    rows = line_rows(seed)
    got = {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(docs(rows)).collect()}
    assert got == similar_lines(rows)


def test_drop_lines(docs):
    df = docs([(1, "a b c d e f\nkeep this one"), (2, "A b c d e f\nand more"), (3, "a b c d e f"), (None, "a b c d e f"), (4, None), (5, "")])
    out = {r.doc_id: r.text for r in line_dedup.drop_lines(df).collect()}
    assert out == {1: "a b c d e f\nkeep this one", 2: "and more", None: "a b c d e f", 4: None, 5: ""}
    assert line_dedup.drop_lines(df).columns == df.columns
    assert line_dedup.removed_lines(df.limit(0)).count() == 0


def test_repeats_of_short_lines_go(docs):
    df = docs([(1, "all rights reserved\none two three four"), (2, "All rights reserved\none two three five\n\nall rights reserved"), (3, "all rights reserved"), (None, "all rights reserved")])
    out = {r.doc_id: r.text for r in line_dedup.drop_lines(df).collect()}
    assert out == {1: "all rights reserved\none two three four", 2: "one two three five\n", None: "all rights reserved"}
    assert sorted((r.doc_id, r.line_no) for r in line_dedup.removed_lines(df).collect()) == [(2, 0), (2, 3), (3, 0)]


def test_lines_go_by_their_own_text(docs):
    """Rows of one doc_id with other texts, a long line, many lines of one rare word."""
    long = " ".join(f"w{i}" for i in range(6000))
    rows = [(1, "p q r"), (2, "p q r\nx"), (2, "keep me\nx"), (3, long), (4, long + " end"), (4, long + " end")]
    rows += [(10 + i, " ".join(["rare", *(f"v{(i * 7 + k) % 40}" for k in range(12 + i % 9))])) for i in range(90)]
    out = sorted((r.doc_id, r.text) for r in line_dedup.drop_lines(docs(rows)).collect())
    gone = similar_lines(rows)
    assert {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(docs(rows)).collect()} == gone
    assert [t for d, t in out if d == 2] == ["keep me", "x"] or [t for d, t in out if d == 2] == ["keep me\nx", "x"]
    assert not {4} & {d for d, _ in out}
