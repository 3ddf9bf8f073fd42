import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltworks.llm import vector_codes as C
from siltworks.llm import vector_neardup as N
from siltworks.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, component_id int, code int"


@pytest.fixture
def table(spark):
    """(vec_id, embedding, label), with columns of clashing names."""
    return lambda rows, schema=SCHEMA: spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema)


def fine(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


# ---------------------------------------------------------------- op12


def brute_links(rows, threshold=0.95):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector, ...)."""
    good = [i for i, r in enumerate(rows) if r[0] is not None and fine(r[1]) and any(r[1])]
    parent = {i: i for i in range(len(rows))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links, first = [0] * len(rows), {}
    for i in good:
        if rows[i][0] in first:
            parent[root(i)] = root(first[rows[i][0]])
        first.setdefault(rows[i][0], i)
        for j in good:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.float32(rows[k][1]).astype(float) for k in (i, j))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i in good:
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    out = []
    for i, r in enumerate(rows):
        c = least[root(i)] if i in good else r[0]
        out.append((r[0], links[i], c, r[0] is not None and r[0] == c))
    return sorted(out, key=str)


def judged(df, **options):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in N.near_vectors(df, **options).collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([2, 3, 16, 64, 1500]), st.sampled_from([0.02, 0.3, 1.0]))
def test_bounds_hold_and_decide(seed, dim, spread):
    rng = np.random.default_rng(seed)
    raw = rng.standard_normal((1, dim)) + spread * rng.standard_normal((24, dim))
    raw *= 10.0 ** rng.integers(-30, 30, (24, 1))
    x = N.unit(raw)
    q, (scale, norm, rest) = N.quantise(x)
    about = N.products(q, q) * scale[:, None] * scale
    error = norm[:, None] * rest + norm * rest[:, None] + rest[:, None] * rest
    exact = x @ x.T
    assert (np.abs(exact - about) <= error + 1e-9).all()
    threshold = float(np.quantile(exact, 0.7)) if exact.min() < 0.9 else 0.95
    block = N.Block({"n": 24, "dim": dim, "nodes": np.arange(24).tobytes(), "weights": np.ones(24, "<i8").tobytes(), "raw": raw.tobytes(), "quantised": q.tobytes(), "stats": np.stack((scale, norm, rest)).tobytes()}, "<f8")
    threshold = max(threshold, 0.01)
    i, j, _ = N.tile_links(block, block, slice(0, 24), slice(0, 24), threshold)
    got = np.zeros((24, 24), bool)
    got[i, j] = True
    sure = np.abs(exact - threshold) > 1e-12
    assert (got == (exact >= threshold))[sure].all()


def test_few_pairs_are_computed_anew():
    rng = np.random.default_rng(1)
    x = N.unit(rng.standard_normal((600, 64)))
    q, stats = N.quantise(x)
    block = N.Block({"n": 600, "dim": 64, "nodes": np.arange(600).tobytes(), "weights": np.ones(600, "<i8").tobytes(), "raw": x.tobytes(), "quantised": q.tobytes(), "stats": stats.tobytes()}, "<f8")
    i, _, anew = N.tile_links(block, block, slice(0, 600), slice(0, 600), 0.95)
    assert len(i) == 600 and anew == 0  # a vector's cosine with itself is surely above


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 19), st.integers(0, 19)), max_size=40))
def test_merge_is_the_least_of_each_component(edges):
    label = np.arange(20)
    for k in range(0, len(edges), 7):
        part = np.array(edges[k : k + 7]).reshape(-1, 2)
        label = N.merge(label, part[:, 0], part[:, 1])
    expected = list(range(20))
    for _ in range(20):
        for a, b in edges:
            expected[a] = expected[b] = min(expected[a], expected[b])
    assert label.tolist() == expected


def test_near_vectors_on_odd_rows(table):
    nan, inf = float("nan"), float("inf")
    near = [[1.0, 0.1 * k, 0.0] for k in range(8)]
    rows = [(k, v, k % 3) for k, v in enumerate(near)]
    rows += [(20, None, 1), (21, [], 1), (22, [0.0, 0.0, 0.0], 1), (23, [1.0, None, 0.0], 1), (24, [nan, 1.0, 1.0], 1), (25, [inf, 1.0, 1.0], 1), (None, [1.0, 0.0, 0.0], 1), (None, None, None)]
    rows += [(30, [2.0, 0.2, 0.0], 1), (31, [1e-30, 1e-31, 0.0], 1), (32, [1e30, 0.0, 0.0], 1), (33, [1.0, 0.1], 1), (34, [2.0, 0.2], 1), (35, [-1.0, -0.1, 0.0], 1)]
    rows += [(3, [1.0, 0.3, 0.0], 1), (3, [1.0, 0.3, 0.0], 1)]  # repeated rows
    rows += [(40, [0.0, 0.0, 1.0], 1), (41, [0.0, 0.01, 1.0], 1), (40, [0.0, 1.0, 0.0], 1), (42, [0.01, 1.0, 0.0], 1)]  # two vectors under one id
    for size in (2, 4096, None):
        assert judged(table(rows), block_rows=size) == brute_links(rows)


def test_near_vectors_of_nothing(table):
    assert judged(table([]).limit(0)) == []
    assert judged(table([(1, None, 1), (2, [0.0], 1)])) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors_against_brute_force(table, kind):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 24))
    rows = []
    for k in range(400):
        c = centres[0] if k % 3 == 0 else centres[rng.integers(12)]  # a third of all rows are near one another
        rows.append((int(k * 7 % 400), np.float32(c + rng.choice([0.0, 0.02, 0.2, 0.25]) * rng.standard_normal(24)).tolist(), int(k % 5)))
    df = table(rows, SCHEMA.replace("float", kind))
    expected = brute_links(rows)
    assert max(r[1] for r in expected) > 100
    for size in (37, 150, 4096):
        assert judged(df, block_rows=size) == expected


def test_keep_one_vector(table):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (2, [0.0, 1.0], 2), (5, None, 1)]
    out = N.keep_one(table(rows))
    assert out.columns == table(rows).columns and sorted((r.vec_id for r in out.collect()), key=str) == [1, 5, None]


# ---------------------------------------------------------------- op11


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """Codes and errors by vec_id order, and the codebooks, by plain whole numbers."""
    kept = sorted((r for r in rows if fine(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    whole = [[math.floor(1024 * x) for x in r[1]] + [0] * (-len(r[1]) % parts) for r in kept]
    width = len(whole[0]) // parts if whole else 0
    split = [[w[p * width : (p + 1) * width] for w in whole] for p in range(parts)]
    books = [[list(x) for x in s[:entries]] for s in split]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for s, book in zip(split, books, strict=True):
            groups = {}
            for x in s:
                groups.setdefault(nearest(x, book)[1], []).append(x)
            for k, g in groups.items():
                book[k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    best = [[nearest(x, book) for x in s] for s, book in zip(split, books, strict=True)]
    out = [(r[0], "".join(f"{best[p][i][1]:02x}" for p in range(parts)), sum(best[p][i][0] for p in range(parts))) for i, r in enumerate(kept)]
    return out, books


def coded(df, **options):
    found = C.compress(df, **options)
    return sorted(((r.vec_id, bytes(r.code).hex(), r.error) for r in found.rows.collect()), key=str), found


@pytest.mark.parametrize("seed,n,dim,entries", [(0, 300, 8, 16), (1, 120, 12, 40), (2, 60, 4, 256), (3, 90, 10, 8)])
def test_codes_against_brute_force(table, seed, n, dim, entries):
    """Integer-valued vectors on a coarse grid, so that ties abound; lengths that aren't multiples of four too."""
    rng = np.random.default_rng(seed)
    rows = [(int(k), (rng.integers(-6, 7, dim) / 8 + (0.001 * rng.standard_normal(dim) if k % 2 else 0)).tolist(), int(k % 3)) for k in rng.permutation(n)]
    rows = [(i, np.float32(v).astype(float).tolist(), y) for i, v, y in rows]
    expected, books = brute_codes(rows, entries=entries)
    got, found = coded(table(rows), entries=entries)
    assert [b.tolist() for b in found.books] == books
    assert got == sorted(expected, key=str)


def test_codes_of_odd_rows(table):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [0.5, -0.25, 1e-4, -1e-4], 1), (5, [0.5, -0.25, 1e-4, -1e-4], 1), (5, [0.25, 0.0, 0.0, 0.0], None), (None, [0.1, 0.2, 0.3, 0.4], 1), (2, None, 1), (3, [], 1), (4, [1.0, None, 0.0, 0.0], 1), (6, [nan, 0.0, 0.0, 0.0], 1), (7, [inf, 0.0, 0.0, 0.0], 1), (8, [1.0], 1), (9, [3e30, 0.0, 0.0, 0.0], 1), (10, [900.0, -900.0, 1e5, 0.5], 2)]
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    expected, books = brute_codes([r for r in rows if r[0] != 9])
    got, found = coded(table(rows))
    assert got == sorted(expected, key=str) and [b.tolist() for b in found.books] == books
    assert coded(table([]).limit(0))[0] == [] and coded(table([(1, None, 1)]))[0] == []
    assert coded(table([(1, [0.5], 1)]))[0] == [(1, "00000000", 0)]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([1, 2, 5, 9]), st.booleans(), st.integers(0, 3))
def test_bounded_comparison_equals_the_full_one(seed, b, coarse, far):
    """Over several moves of the entries, some of them far, with lists that shrink."""
    rng = np.random.default_rng(seed)
    draw = lambda n: rng.integers(-3, 4, (n, 3)) if coarse else rng.integers(-500, 500, (n, 3))
    x, book = draw(80), draw(12)
    own, _, listed, low = C.compare_all(x, book, b)
    for _ in range(4):
        step = rng.integers(-1, 2, book.shape) * rng.integers(0, 30 if not coarse else 2)
        step[rng.permutation(len(book))[:far]] *= 9
        new = book + step
        moved = np.sqrt((step**2).sum(axis=1).astype(float)) * (1 + 1e-12)
        b = max(1, b - int(rng.integers(0, 2)))
        movers = C.far_movers(moved)
        assert len(movers) < len(book) and (moved[movers] > 1.5 * np.median(moved)).all()
        own, best, listed, low, depth = C.compare_bounded(x, new, moved, movers, own, listed.astype(np.int64), low, b)
        d = ((x[:, None] - new) ** 2).sum(axis=2)
        assert own.tolist() == d.argmin(axis=1).tolist() and best.tolist() == d.min(axis=1).tolist()
        # each bound is below the distance it stands for
        dist = np.sqrt(d)
        assert (np.take_along_axis(dist, listed, axis=1) >= low[:, :-1]).all()
        others = dist.copy()
        np.put_along_axis(others, np.concatenate((listed, own[:, None]), axis=1), np.inf, axis=1)
        assert (others.min(axis=1) >= low[:, -1]).all()
        book = new


def test_lists_shrink_and_spare_comparisons(table):
    """Ten times as many vectors as entries: from the second move on, most parts are settled without the whole codebook."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, 1600)] + 0.4 * rng.standard_normal((1600, 16))
    found = C.compress(table([(i, np.float32(v).tolist(), 0) for i, v in enumerate(x)]), entries=160)
    assert found.listed == sorted(found.listed, reverse=True) and found.listed[-1] < found.listed[0]
    share = [d.get(C.FULL, 0) / sum(d.values()) for d in found.depths]
    assert share[0] == 1 and max(share[2:]) < 0.5, (found.listed, share)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_near_vectors"])
def test_vector_queries_equal_sql(spark, sf_dir, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    expected = c.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()[list(expected.columns)]
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, expected.to_numpy().tolist()))
