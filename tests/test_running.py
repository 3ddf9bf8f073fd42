import hashlib
import io
from collections import Counter
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from siltworks.operators import metrics, running, split


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_running_sums_by_key(spark, parts):
    """A third of all rows have one key; another key is null, and so are some values and one order."""
    rows = [(None if i % 5 == 0 else "hot" if i % 3 else f"k{i % 7}", (i * 37) % 101 if i else None, None if i % 11 == 0 else i) for i in range(101)]
    df = spark.createDataFrame(rows, "k string, o int, v long").withColumn("same", F.lit(1))
    got = {(r.k, r.o): (r.v_upto, r.same_upto) for r in running.running_sums(df, [F.col("o").desc()], ["v", "same"], ["k"], parts).collect()}
    for k, o, _ in rows:
        upto = [r for r in rows if r[0] == k and (o is None or (r[1] is not None and r[1] >= o))]
        assert got[k, o] == (sum(r[2] or 0 for r in upto), len(upto))
    assert running.running_sums(df.limit(0), [F.col("o")], ["v"], parts=parts).count() == 0


def test_ranks_of_one_value_are_many_ranges(spark):
    """All rows share the value, so the key alone spreads them."""
    df = spark.range(2000).select(F.lit(0.5).alias("x"), F.col("id"))
    ranked = running.global_rank(df, [F.col("x"), F.col("id")], "rank")
    assert ranked.where("rank <> id + 1").count() == 0
    said = io.StringIO()
    with redirect_stdout(said):
        ranked.explain("formatted")
    # what one task orders is a table of one row a range
    assert "SinglePartition" not in said.getvalue().split("Window")[0]


def windows_over_one_task(df):
    """Windows without a partition by range, as (what they order)."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Window " in line and "__range" not in line]


@pytest.mark.parametrize("make", [lambda d: metrics.roc_auc(d, "s", "y"), lambda d: metrics.roc_curve(d, "s", "y"), lambda d: metrics.average_precision(d, "s", "y"), lambda d: metrics.tpr_at_fpr(d, "s", "y", [0.1]), lambda d: metrics.val_threshold(d, "s", "y", "p", 0.1), lambda d: metrics.risk_coverage(d, "s", "id", "s", "y", [0.9]), lambda d: split.size_batches(d, "id", "id", 10, "1")])
def test_no_window_holds_all_values(spark, make):
    df = spark.range(500).select("id", F.rand(1).alias("s"), (F.col("id") % 2).alias("y"), F.when(F.col("id") % 3 == 0, "val").otherwise("test").alias("p"))
    assert windows_over_one_task(make(df)) == []


def brute_draw(rows, n, seed):
    line, at = [], 0
    for k, w in sorted((k, round(w / 1e-6)) for k, w in rows if k is not None and w is not None and w > 0):
        line.append((at, at + w, k))
        at += w
    out = Counter()
    for j in range(n if at else 0):
        u = int(hashlib.sha256(f"{seed}:{j}".encode()).hexdigest()[:12], 16) / 16**12
        out.update(k for a, b, k in line if a <= int(u * at) < b)
    return out


@pytest.mark.parametrize("rows", [[(k, 1.0 + k % 3) for k in range(50)], [(1, 1000.0), (2, 0.001), (3, 0.0), (4, None), (None, 5.0), (5, -1.0)], [(7, 0.5)], [(1, 0.0)], []])
def test_draws_with_replacement(spark, rows):
    df = spark.createDataFrame(rows, "k long, w double")
    got = {r.k: r.copies for r in running.draw(df, "k", "w", 300, "5").collect()}
    assert got == brute_draw(rows, 300, "5")
    assert sum(got.values()) == (300 if any(k is not None and w and w > 0 for k, w in rows) else 0)


def test_quota_needs_more_than_there_is(spark):
    rows = [(i, "a" if i % 4 else "b", ["x"] if i % 10 == 0 else ["y"] if i % 2 else None, i == 1) for i in range(60)] + [(100, None, ["x"], None)]
    df = spark.createDataFrame(rows, "id long, part string, tags array<string>, force boolean")
    got = split.quota_sample(df, "id", "tags", "part", 8, 20, "1", F.col("force"), {"a": 1.0, "b": 0.5})
    assert got.columns == df.columns
    by_part = {}
    for r in got.collect():
        by_part.setdefault(r.part, []).append(r)
    assert set(by_part) == {"a", "b"} and 1 in {r.id for r in by_part["a"]}
    assert len(by_part["a"]) == 20 and len(by_part["b"]) == 10
    tagged = lambda p, t: sum(t in (r.tags or []) for r in by_part[p])
    assert tagged("a", "x") == 3 and tagged("b", "x") == 3  # as many as there are
    assert tagged("a", "y") >= 8


def test_a_class_of_most_rows_is_split_by_ranges(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).when(F.col("id") % 30 == 1, "rare").otherwise("hot").alias("c"))
    parts = split.stratified_split(df, "c", "id", 0.15, "1").groupBy("c", "part").count().collect()
    assert {(r.c, r.part): r["count"] for r in parts} == {(None, "test"): 45, (None, "val"): 45, (None, "train"): 210, ("rare", "test"): 4, ("rare", "val"): 4, ("rare", "train"): 22, ("hot", "test"): 85, ("hot", "val"): 85, ("hot", "train"): 400}
    kept = split.proportional_sample(df, "c", "id", 90, "1").groupBy("c").count().collect()
    assert {r.c: r["count"] for r in kept} == {None: 30, "rare": 3, "hot": 57}


def test_fingerprint_by_several_levels(spark, monkeypatch):
    df = spark.range(3000)
    monkeypatch.setattr(split, "ONE_LEVEL", 1000)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    blocks = {}
    for i in range(3000):
        blocks.setdefault(sha(str(i))[:6], []).append(str(i))
    leaves = {b: sha("\n".join(sorted(ids))) for b, ids in blocks.items()}
    upper = {}
    for b in sorted(leaves):
        upper.setdefault(b[:3], []).append(leaves[b])
    expected = sha("\n".join(sha("\n".join(upper[b])) for b in sorted(upper)))
    assert split.ordered_fingerprint(df, "id").first().fingerprint == expected == split.ordered_fingerprint(df.repartition(5), "id").first().fingerprint
