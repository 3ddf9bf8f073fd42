import math
import random
from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltworks.llm import decontaminate, mcd_quality, unigram_counts, url_cascade
from siltworks.llm.queries import ORACLE_SQL, QUERIES, vocabulary

# ---------------------------------------------------------------- quality rules


def counts(text):
    text = text or ""
    w = brute.words(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


ODD = [None, "", " \n\n ", "é 😀 \x1c x", "a b c d e f g h " * 3, "line one\nline one\n\n\nline one \n", "# | $ é*", "w\x0bv\x0cu", "x " * 30000, "a b c d e f g h i"]


def test_counts_of_odd_texts(docs):
    got = {r.doc_id: tuple(r)[1:6] for r in mcd_quality.judge(docs(list(enumerate(ODD))), "doc_id").collect()}
    assert got == {i: counts(t) for i, t in enumerate(ODD)}


def test_base_counts_on_the_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op2_mcd_quality"](spark, sf_dir).collect():
        n = counts(texts[r.doc_id])
        assert tuple(r)[1:6] == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r.base_failed and r.kept)


def plain_mcd(x):
    """The same estimate by numpy: both starts, C-steps over all rows."""
    p, floor = x.shape[1], np.array([mcd_quality.FEATURES[k][1] * mcd_quality.STEP for k in mcd_quality.NAMES])

    def scaled(rows):
        mean, cov = rows.mean(0), np.cov(rows.T, bias=True)
        cov = cov + np.diag(floor**2 * np.clip(1 - np.diag(cov) / floor**2, 0.05, 1))
        return mean, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    def distance(s):
        d = x - s[0]
        return np.einsum("ij,jk,ik->i", d, s[1], d)

    med = np.median(x, 0)
    mad = np.maximum(1.4826 * np.median(abs(x - med), 0), floor)
    found = []
    for s in ((med, np.diag(1 / mad**2), 1e300), scaled(x)):
        for _ in range(mcd_quality.MAX_STEPS):
            b = np.floor(np.log1p(np.clip(distance(s), 0, 1e9)) * 128)
            s = scaled(x[b <= np.quantile(b, mcd_quality.COVER)])
        found.append(s)
    d = distance(min(found, key=lambda s: s[2]))
    return d / max(1.0, np.expm1(np.median(np.floor(np.log1p(d) * 128)) / 128) / mcd_quality.MEDIAN)


def test_distances_equal_plain_numpy(spark):
    rng = np.random.default_rng(3)
    n = 400
    values = np.round(rng.normal(0, [60, 30, 10, 0.1, 5], (n, 5)) + rng.integers(0, 2, (n, 1)) * 20)
    values[:20] += 900
    rows = spark.createDataFrame([("g", *map(int, v)) for v in values], "__group string, " + ", ".join(f"{k} long" for k in mcd_quality.NAMES))
    out = rows.join(mcd_quality.fit(rows), "__group").select(*mcd_quality.NAMES, (mcd_quality.distance() / F.col("scale")).alias("d")).collect()
    expected = dict(zip(map(tuple, values.astype(int).tolist()), plain_mcd(values), strict=True))
    assert len(out) == n
    for r in out:
        assert r.d == pytest.approx(expected[tuple(r)[:5]], rel=1e-6)


def test_outliers_go_and_usual_rows_stay(spark, docs):
    r = random.Random(1)
    usual = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(r.randint(60, 200))) for _ in range(300)]
    junk = [" ".join("x" + "%$#" * 3 for _ in range(100)) for _ in range(5)]
    df = docs([(i, t, "en", "s") for i, t in enumerate(usual + junk)] + [(900, "tiny text", None, None), (None, usual[0], "en", "s"), (7, usual[7], "en", "s")])
    out = mcd_quality.judge(df, "doc_id").collect()
    assert len(out) == df.count()
    lost = {x.doc_id for x in out if not x.kept}
    assert lost >= {300, 301, 302, 303, 304, 900} and len(lost) <= 8
    kept = mcd_quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(x.kept for x in out)
    assert mcd_quality.judge(df.limit(0), "doc_id").count() == 0


def test_verdicts_follow_the_quality_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = mcd_quality.judge(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").where("not base_failed").join(labels, "doc_id").collect()
    bad, good = [x.kept for x in rows if x.quality == 0], [x.kept for x in rows if x.quality == 1]
    assert len(bad) > 10 and sum(bad) <= 0.1 * len(bad)
    assert len(good) > 100 and sum(good) >= 0.985 * len(good)


# ---------------------------------------------------------------- URLs

URLS = [None, "", "no scheme", "http://A.Example.COM/en/7x?q#f", "http://example.com/en/8", "https://x.com?y=/en/", "http://x.de/de/8", "https://sub.example.net/de/8/9", "http://example.net/de/9", "http://com/en/", "a://b://c/d", "http://org/es/", "http://xorg/es/", "http://host.org#/es/", "://", "http://..com/en/"]


def url_by_hand(url, rules, blocked):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = brute.lower(rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))])
    tail = rest[len(host) :]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if any(host == b or host.endswith("." + b) for b in blocked) else "allow"


@pytest.mark.parametrize("broadcast", [True, False])
def test_urls_match_plain_rules(spark, monkeypatch, broadcast):
    from siltworks.llm.queries import URL_RULES

    if not broadcast:
        monkeypatch.setattr(url_cascade, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(url_cascade, "SHARD_KEYS", 2)
    r = random.Random(2)
    urls = URLS + ["http://" + ".".join(r.choice(["a", "b", "example", "spam"]) for _ in range(r.randint(1, 3))) + "." + r.choice(["com", "net", "org"]) + r.choice(["/en/7", "/de/8", "/es/", "/x", ""]) for _ in range(150)]
    blocked = ["spam.com", "a.org", "b.example.net", "unseen.com"]
    pages = spark.createDataFrame([*enumerate(urls), (None, URLS[3]), (3, URLS[3])], "page_id long, url string").withColumn("host", F.lit(1))
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    hosts = spark.createDataFrame([(b,) for b in blocked], "host string")
    out = url_cascade.judge(pages.select("page_id", "url", "host"), rules, hosts).collect()
    assert len(out) == len(urls) + 2
    for x in out:
        assert (x.host, x.path, x.rule, x.verdict) == url_by_hand(URLS[3] if x.page_id is None else urls[x.page_id], URL_RULES, blocked)
    assert url_cascade.judge(pages.limit(0), rules, hosts).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where(F.abs(F.xxhash64("key")) % 10 == 0)
    c = url_cascade.build(universe, listed)
    got = url_cascade.member(universe, c, "listed")
    assert c.depth > 1
    assert got.where(F.col("listed") != (F.abs(F.xxhash64("key")) % 10 == 0)).count() == 0


def test_op4_takes_several_levels(spark, monkeypatch):
    depths, build = [], url_cascade.build

    def noted(*args):
        depths.append((c := build(*args)).depth)
        return c

    monkeypatch.setattr(url_cascade, "build", noted)
    rows = QUERIES["op4_url_cascade"](spark, "/root/testdata/sf0.01").collect()
    assert max(depths) > 1 and {r.verdict for r in rows if r.rule is None} == {"allow", "block"}


# ---------------------------------------------------------------- token counts


def unigram(vocabulary):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    low = min(s for _, s in vocabulary)
    t = Tokenizer(models.Unigram([*vocabulary, ("<unk>", low)], unk_id=len(vocabulary), byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    del normalizers
    return t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abc☃", min_size=1, max_size=12), min_size=1, max_size=4), st.randoms(use_true_random=False))
def test_counts_equal_the_tokenizer(words, r):
    pieces = {"▁", "a", "b"} | {"".join(r.choice("abc") for _ in range(r.randint(2, 4))) for _ in range(8)} | {"▁" + "".join(r.choice("abc") for _ in range(r.randint(1, 3))) for _ in range(4)}
    vocabulary = [(p, -float(r.choice([1, 2, 2, 3, 4]))) for p in sorted(pieces)]
    c, t = unigram_counts.Counter(vocabulary), unigram(vocabulary)
    for w in words:
        assert c.count("▁" + w)[0] == len(t.encode(w, add_special_tokens=False).ids)


def test_op6_on_the_whole_table(spark, sf_dir):
    v = unigram_counts.zipf_vocabulary(vocabulary("piece_bpe_32k.model"))
    t, known = unigram(v), {}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op6_unigram_counts"](spark, sf_dir).collect():
        w = brute.words(texts[r.doc_id])
        for x in w:
            if x not in known:
                known[x] = len(t.encode(x, add_special_tokens=False).ids)
        assert (r.n_words, r.n_pieces) == (len(w), sum(known[x] for x in w))
        assert math.isfinite(r.score)


def test_counts_of_odd_rows(docs):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "aa"), (4, "aa"), (4, "aa"), (5, "a" * 5000)]
    out = unigram_counts.count_tokens(docs(rows), [("▁aa", -1.0), ("a", -2.0), ("▁", -1.0)]).collect()
    assert sorted((r.doc_id or 0, r.n_pieces) for r in out) == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (5, 4999)]
    assert unigram_counts.count_tokens(docs(rows).limit(0), [("a", -1.0)]).count() == 0


# ---------------------------------------------------------------- benchmark passages


def edits(a, b):
    """Least edit distance of ``a`` to a part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def changed(r, text, n):
    s = list(text)
    for _ in range(n):
        at = r.randrange(len(s))
        s[at : at + r.choice([0, 1])] = r.choice(["", "q", "zz"])
    return "".join(s)


def test_alignment_is_least():
    r = random.Random(4)
    for _ in range(300):
        a = "".join(r.choice("abc ") for _ in range(r.randint(3, 25)))
        b = "".join(r.choice("abc ") for _ in range(r.randint(0, 8))) + changed(r, a, r.randint(0, 5)) + "b" * r.randint(0, 8)
        code = lambda s: np.array([ord(c) for c in s], np.uint32)
        got = decontaminate.align(code(a), code(b), 60, -len(a), len(b))
        assert got[0] == edits(a, b) == edits(a, b[got[1] : got[2]])


def test_passages_match_alignment_everywhere(spark, docs):
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(n))
    items = [(i, text(r.randint(8, 30))) for i in range(12)] + [(50, "short"), (51, None)]
    rows = []
    for d in range(60):
        t = text(40)
        if d % 2:
            i = r.randrange(12)
            t = t[:50] + " " + changed(r, items[i][1], r.choice([0, 1, 2, 4, 12])).upper() + ". " + t[50:]
        rows.append((d, t))
    rows += [(100, None), (101, ""), (None, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.find_passages(docs(rows), bench).collect()}
    plain = lambda s: "".join(map(chr, decontaminate.normal(s or "")[0]))
    expected = {}
    for d, t in rows:
        for i, b in items:
            a = plain(b)
            if len(a) >= decontaminate.MIN_ITEM and (n := edits(a, plain(t))) <= decontaminate.budget(len(a)):
                expected[d, i] = n
    assert got == expected and len(expected) > 15
    df = docs(rows)
    clean = decontaminate.remove_contaminated(df, bench)
    assert clean.columns == df.columns
    assert {x.doc_id for x in clean.collect()} == {d for d, _ in rows} - {d for d, _ in expected}
    assert decontaminate.find_passages(df.limit(0), bench).count() == 0
    assert decontaminate.find_passages(df, bench.limit(0)).count() == 0


def test_repetitive_texts_cost_in_proportion():
    """Items and texts of one repeated pair of letters: hits are counted by bands, not listed."""
    import time
    import tracemalloc

    items = decontaminate.Items([1, 2], ["ab" * 1000, "ab" * 30 + " and then something else that is told once"])
    took = {}
    tracemalloc.start()
    for n in (10_000, 40_000):
        began = time.time()
        found = items.find("ab" * (n // 2))
        took[n] = time.time() - began
        assert {x[0] for x in found} == {1} and max(x[2] for x in found) > n - 2000
        assert all(x[3] <= decontaminate.budget(2000) for x in found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took[40_000] < 10 * took[10_000] and peak < 200 << 20
    mixed = "x" * 50 + " " + "ab" * 30 + " and then something else that is told once" + " ab" * 500
    assert {x[0] for x in items.find(mixed)} == {2}


def test_op8_on_the_whole_table(spark, sf_dir):
    """An item within k edits holds one of its k + 1 pieces as it is; those pairs are aligned over the whole text."""
    bench = [(r.item_id, decontaminate.normal(r.text or "")[0]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    expected = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        points = decontaminate.normal(r.text or "")[0]
        raw = points.tobytes()
        for i, item in bench:
            m = len(item)
            if m < decontaminate.MIN_ITEM:
                continue
            k = decontaminate.budget(m)
            edge = [m * j // (k + 1) for j in range(k + 2)]
            if any(item[a:b].tobytes() in raw for a, b in zip(edge, edge[1:], strict=False)) and decontaminate.align(item, points, k, -m, len(points)):
                expected.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in QUERIES["op8_benchmark_passages"](spark, sf_dir).collect()}
    assert got == expected and got


@pytest.mark.parametrize("name", ["op3_jaccard_join", "op4_url_cascade", "op5_difference_cover", "op10_line_dedup"])
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(got.columns)
    plain = lambda f: sorted(map(str, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(c.execute(ORACLE_SQL[name]).df())
