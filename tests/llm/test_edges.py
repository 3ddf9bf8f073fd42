"""Long texts, ties, repeated rows, empty tables and clashing names."""

import random

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from siltworks.llm import common, decontaminate, jaccard_join, line_dedup, mcd_quality, substring_dedup, url_cascade

LETTERS = "abcdefghijklmnop"


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(2, 8))) for _ in range(n)]


LONG = " ".join(words(450_000, 1))  # over one slice of 2 MB


@pytest.fixture
def odd(spark):
    """Documents with columns named like the operators' working ones."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, __t string, __id long, c0 string, `a.b` int, kept boolean"
        return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", 7, "y", 1, None) for d, t in rows], schema)

    return make


def test_texts_over_a_slice(docs):
    assert len(LONG) > common.SLICE_BYTES
    w = LONG.split(" ")
    other = " ".join(w[:-50] + words(50, 2))
    rows = [(1, LONG), (2, other), (3, " ".join(words(80, 3) + w[1000:1070] + words(30, 4)))]
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(docs(rows)).collect()}
    assert out[1].n_removed == 0 and out[2].n_removed == len(w) - 50 and out[3].n_removed == 70
    item = " ".join(w[300_000:300_030])
    found = decontaminate.Items([5], [item]).find(LONG)
    assert [(x[0], x[3]) for x in found] == [(5, 0)] and LONG[found[0][1] : found[0][2]] == item


def test_a_very_long_line(docs):
    """One line of 30,000 different words, a copy but for a few, and a short one."""
    w = [f"w{i}" for i in range(30_000)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:-100], *(f"v{i}" for i in range(100))])), (3, "one two three\n" + " ".join(w[:20_000]))]
    got = {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(docs(rows)).collect()}
    assert got == {(2, 0)}


def test_repeated_rows_of_lines_and_passages(spark, docs):
    text = "a line that is long enough to count for the filter\nother words stand here in a second line of it"
    rows = [(1, text), (1, text), (2, text), (2, text)]
    lost = {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(docs(rows)).collect()}
    assert lost == {(2, 0), (2, 1)}
    bench = spark.createDataFrame([(9, text[:40]), (9, text[:40]), (8, text[:40]), (None, text[:40])], "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in decontaminate.find_passages(docs(rows), bench).collect()]
    assert {(d, i) for d, i in found} == {(d, i) for d in (1, 2) for i in (8, 9, None)}
    assert decontaminate.remove_contaminated(docs([*rows, (3, "clean")]), bench).select("doc_id").collect() == [(3,)]


def test_ties_of_places_and_rules(spark):
    """Two items of one text tie; so do two urls, and a rule that is both allowed and blocked by one length."""
    items = decontaminate.Items([1, 2], ["the same passage in two items"] * 2)
    assert {(x[0], x[3]) for x in items.find("so the same passage in two items ends")} == {(1, 0), (2, 0)}
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://a.com/x"), (2, "http://a.com/x"), (3, "http://b.a.com/x/" + "y" * 200_000)], "page_id long, url string")
    rules = spark.createDataFrame([("a.com", "/x", "block"), ("a.com", "/x/", "allow")], "host string, path string, verdict string")
    none = spark.createDataFrame([], "host string")
    got = sorted((r.page_id, r.rule, r.verdict, len(r.path)) for r in url_cascade.judge(pages, rules, none).collect())
    assert got == [(1, "a.com/x", "block", 2), (2, "a.com/x", "block", 2), (2, "a.com/x", "block", 2), (3, "a.com/x/", "allow", 200_003)]


def test_equal_documents_share_a_verdict(docs):
    """All rows alike: distances tie at nought, and nothing is rejected."""
    text = " ".join(words(60, 5))
    out = mcd_quality.judge(docs([(i, text) for i in range(220)]), "doc_id").collect()
    assert len(out) == 220 and all(r.kept for r in out) and len({r.distance for r in out}) == 1


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_odd_columns_and_take_empty_tables(spark, odd, sf_dir, stage):
    rows = [(i, " ".join(words(40, i)) + "\n" + " ".join(words(30, i + 100))) for i in range(30)] + [(50, " ".join(words(40, 1))), (None, " ".join(words(40, 77))), (60, None), (61, "")]
    out = stage(spark, odd(rows), sf_dir)
    assert out.columns == odd(rows).columns
    got = out.collect()
    assert len(got) >= 28 and all((r["__t"], r["__id"], r["c0"], r["a.b"], r["kept"]) == ("x", 7, "y", 1, None) for r in got)
    empty = stage(spark, odd(rows).limit(0), sf_dir)
    assert empty.columns == out.columns and empty.count() == 0


def test_packing_takes_odd_columns_and_an_empty_table(spark, odd, sf_dir):
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, odd([(1, "a b"), (2, None)]), sf_dir).agg(F.sum("length")).first()[0] == 4
    assert pack(spark, odd([(1, "a")]).limit(0), sf_dir).count() == 0


def test_brute_components_agree_on_ties():
    """Two documents of equal sets link at any order of words within."""
    rows = [(2, "a b c d e f"), (1, "a b c d e f"), (3, "a b c d e f g h i j")]
    assert {(d, c) for d, _, c in brute.components(rows)} == {(1, 1), (2, 1), (3, 3)}
