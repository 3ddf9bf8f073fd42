import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.operators import metrics as M
from siltworks.operators import models as L
from siltworks.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def told(spark):
    """Rows whose label and tags the vector tells, but for a twentieth of them: (id, y, tags, v, part)."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 6))
    flip = rng.random(600) < 0.05
    y = (x[:, 0] * x[:, 1] > 0) ^ flip
    line = x[:, 0] + x[:, 1] > 0
    part = np.where(np.arange(600) % 10 < 6, "train", np.where(np.arange(600) % 10 < 8, "val", "test"))
    rows = [(i, int(y[i]), int(line[i] ^ flip[i]), [t for t, c in (("p", x[i, 2] > 0.5), ("q", x[i, 3] > 0)) if c] + ["rare"] * (i < 3), x[i].tolist(), str(part[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, y int, line int, tags array<string>, v array<double>, part string")
    return L.prepared(df, "v").cache()


def auc_of(model, rows, label):
    return M.roc_auc(L.predict(model, rows.where("part = 'test'"), label), "score", label).first().auc


def test_boosted_trees_learn_what_a_line_cannot(told):
    train, val = F.col("part") == "train", F.col("part") == "val"
    assert auc_of(L.boosted(told, "y", train, val, rounds=30), told, "y") > 0.8
    assert auc_of(L.linear_head(told, "y", train), told, "y") < 0.7


def test_feed_forward_learns(told):
    assert auc_of(L.feed_forward(told, "line", F.col("part") == "train", [6, 12, 2]), told, "line") > 0.85


def test_linear_head_learns(told):
    assert auc_of(L.linear_head(told, "line", F.col("part") == "train"), told, "line") > 0.9


def test_a_model_for_each_tag_with_enough_rows(told):
    models = L.boosted_per_tag(told, "tags", ["p", "q", "rare"], F.col("part") == "train", F.col("part") == "val")
    assert set(models) == {"p", "q"}
    for t, model in models.items():
        rows = told.withColumn("has", F.array_contains("tags", t).cast("int"))
        assert auc_of(model, rows, "has") > 0.9


def test_folds_learn_from_the_others(told):
    rows = told.withColumn("fold", F.col("id") % 3)
    means = {r.fold: r.auc for r in L.fold_means(L.cross_validated(rows, "line", "fold", 3, [0.001, 10.0])).collect()}
    assert set(means) == {0, 1, 2, -1} and min(means.values()) > 0.9
    assert means[-1] == pytest.approx(np.mean([means[k] for k in range(3)]))


def test_folds_of_the_query_beat_a_constant(spark, sf_dir):
    got = {r.fold: r.auc for r in QUERIES["kfold_auc"](spark, sf_dir).collect()}
    assert set(got) == {-1, 0, 1, 2, 3, 4} and min(got.values()) > 0.6


def test_a_constant_predictor_has_half_the_area(spark):
    df = spark.createDataFrame([(0.5, i % 2) for i in range(10)], "s double, y int")
    assert M.roc_auc(df, "s", "y").first().auc == 0.5
    one = df.where("y = 1")
    assert M.roc_auc(one, "s", "y").first().auc is None and M.average_precision(one.where("y = 0"), "s", "y").first().ap is None


def test_per_tag_query_and_dropout_sweep(spark, sf_dir):
    got = QUERIES["gbt_per_tag"](spark, sf_dir).first()
    assert 0 <= got.micro_f1 <= 1 and 0 < got.map <= 1
    sweep = QUERIES["dropout_sweep"](spark, sf_dir).collect()
    assert [r.rate for r in sweep] == [0.1, 0.3, 0.5] and all(0 < r.ap <= 1 for r in sweep)


def test_unordered_fingerprint_sees_every_row(spark, sf_dir):
    from siltworks.operators.split import fingerprint

    df = spark.range(1000)
    first = fingerprint(df, "id").first()
    assert first == fingerprint(df.repartition(7, F.col("id") % 5), "id").first()
    assert first != fingerprint(df.where("id <> 500"), "id").first() and first != fingerprint(df.withColumn("id", F.when(F.col("id") == 3, 1001).otherwise(F.col("id"))), "id").first()
    assert QUERIES["fingerprint_unordered"](spark, sf_dir).first().n == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_best_mix_takes_the_least_of_equal_weights(spark):
    df = spark.createDataFrame([(0.9, 0.8, 1), (0.8, 0.9, 1), (0.1, 0.2, 0)], "a double, b double, y int")
    best = M.best_mix(df, "a", "b", "y").first()
    assert (best.alpha, best.ap) == (0.0, 1.0)
    bad = spark.createDataFrame([(0.9, 0.1, 1), (0.2, 0.8, 0), (0.1, 0.9, 0)], "a double, b double, y int")
    assert M.best_mix(bad, "a", "b", "y").first().alpha == 0.6  # at 0.5 all three are equal


def test_dropout_sweep_fits_on_kept_features(spark, sf_dir, monkeypatch):
    """No pass of a fit works out digests or fusion anew."""
    from siltworks.operators import models as L

    plans, prepared = [], L.prepared

    def seen(df, vector):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return prepared(df, vector)

    monkeypatch.setattr(L, "prepared", seen)
    QUERIES["dropout_sweep"](spark, sf_dir)
    assert len(plans) == 3 and not any("sha2" in p or "zip_with" in p for p in plans)
