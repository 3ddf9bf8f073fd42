import numpy as np
import pytest

from siltworks.operators import neighbours as N


def table(spark, ids, x, extra=()):
    return spark.createDataFrame([*((int(i), v.tolist()) for i, v in zip(ids, x, strict=True)), *extra], "id long, v array<double>")


def brute(q_ids, q, i_ids, i, k, metric, exclude_self):
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    a, b = unit(q), unit(i)
    out = set()
    for n, v in zip(q_ids, a, strict=True):
        sim = np.round(b @ v if metric == "cosine" else -((b - v) ** 2).sum(axis=1), 9)
        order = sorted((-s, m) for s, m in zip(sim, i_ids, strict=True) if not (exclude_self and m == n))[:k]
        out |= {(int(n), int(m), r + 1) for r, (_, m) in enumerate(order)}
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("exclude", [False, True])
def test_blocks_equal_brute_force(spark, monkeypatch, metric, exclude):
    """Several blocks on each side, ties by equal rows, a zero vector, nulls, and vectors of another length."""
    monkeypatch.setattr(N, "QUERY_ROWS", 30)
    monkeypatch.setattr(N, "INDEX_ROWS", 50)
    monkeypatch.setattr(N, "STEP", 7)
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((160, 5)), 1)
    x[40:60] = x[3]
    x[70] = 0
    ids = rng.permutation(160)
    q, i = table(spark, ids[:80], x[:80], [(900, None), (None, [1.0] * 5), (901, [1.0, 2.0]), (903, []), (904, [1.0, None, 0.0, 0.0, 0.0])]), table(spark, ids[20:], x[20:], [(902, None), (None, [1.0] * 5), (905, [float('nan')] * 5), (906, [])])
    got = {(r.query_id, r.idx_id, r["rank"]) for r in N.knn(q, i, 6, metric, exclude).collect()}
    assert got == brute(ids[:80], x[:80], ids[20:], x[20:], 6, metric, exclude)


def test_cells_compare_few_rows_of_clustered_vectors(spark, monkeypatch):
    """Half of the index is one cluster, which is more than a block."""
    monkeypatch.setattr(N, "INDEX_ROWS", 300)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 24))
    at = np.where(np.arange(2000) % 2 == 0, 0, rng.integers(0, 20, 2000))
    x = centres[at] + 0.3 * rng.standard_normal((2000, 24))
    q = table(spark, np.arange(0, 2000, 20), x[::20], [(5000, None)])
    i = table(spark, np.arange(2000), x, [(5001, None)])
    found = N.knn_cells(q, i, 10, probe=0.6, refine=0.3).collect()
    exact = {(r.query_id, r.idx_id) for r in N.knn(q, i, 10).collect()}
    hit = exact & {(r.query_id, r.idx_id) for r in found}
    compared = {r.query_id: r.compared for r in found}
    assert len(hit) >= 0.9 * len(exact) and len(compared) == 100 and np.mean(list(compared.values())) < 0.2 * 2000
    sims = {(r.query_id, r.idx_id): r.sim for r in found}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(abs(s - unit[a] @ unit[b]) < 1e-8 for (a, b), s in sims.items())


def test_cells_of_nothing(spark):
    q = table(spark, [1], np.ones((1, 3)))
    assert N.knn_cells(q, q.limit(0), 3).count() == 0 and N.knn_cells(q.limit(0), q, 3).count() == 0
    assert [(r.query_id, r.idx_id, r.compared) for r in N.knn_cells(q, q, 3).collect()] == [(1, 1, 1)]
    mixed = spark.createDataFrame([(i, [1.0, float(i)] if i % 2 else [1.0]) for i in range(20)], "id long, v array<double>")
    assert {r.idx_id % 2 for r in N.knn_cells(mixed, mixed, 3).collect()} in ({0}, {1})


def test_cells_send_a_query_once_to_a_block(spark, monkeypatch):
    """The best of a block come back, not the best of each of its cells, and no query is repeated for its cells."""
    rows, keep = {}, N.kept

    def counted(df, name):
        out = keep(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(N, "kept", counted)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 8))
    got = N.knn_cells(table(spark, np.arange(50), x[:50]), table(spark, np.arange(600), x), 4, cells=30).collect()
    assert len(got) == 200 and rows["found"] == 50 * 4


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_a_block_product_holds_little_at_once(metric):
    import tracemalloc

    rng = np.random.default_rng(1)
    q, i = rng.standard_normal((512, 4)), rng.standard_normal((N.INDEX_ROWS, 4))
    tracemalloc.start()
    try:
        found = N.best(np.arange(512), q, np.arange(N.INDEX_ROWS), i, 5, metric, False)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.num_rows == 512 * 5 and peak < 32e6
