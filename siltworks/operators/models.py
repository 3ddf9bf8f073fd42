"""Baselines as Spark ML pipelines."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prepared(df: DataFrame, vector: str) -> DataFrame:
    """Rows with the vector as ML features; rows without one are left out."""
    return df.where(F.col(vector).isNotNull()).withColumn("features", array_to_vector(F.col(vector)))


def predict(model, df: DataFrame, *keep: str) -> DataFrame:
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("score"))


def boosted(df: DataFrame, label: str, train: Column, val: Column, seed: int = 1, rounds: int = 15):
    """Boosted trees that stop early on val rows."""
    rows = df.where(train | val).withColumn("__val", val).withColumn("label", F.col(label).cast("double"))
    return GBTClassifier(maxIter=rounds, maxDepth=3, seed=seed, validationIndicatorCol="__val").fit(rows)


def boosted_per_tag(df: DataFrame, tags: str, names: list[str], train: Column, val: Column, least: int = 5) -> dict[str, object]:
    """A model for each tag that has enough positive rows in train; the names are a short fixed list."""
    counts = df.where(train).agg(*(F.count_if(F.array_contains(tags, n)).alias(n) for n in names)).first()
    return {n: boosted(df.withColumn("__y", F.array_contains(tags, n).cast("int")), "__y", train, val) for n in names if counts[n] >= least}


def feed_forward(df: DataFrame, label: str, train: Column, layers: list[int], seed: int = 1):
    return MultilayerPerceptronClassifier(layers=layers, seed=seed, maxIter=40).fit(df.where(train).withColumn("label", F.col(label).cast("double")))


def linear_head(df: DataFrame, label: str, train: Column):
    return LogisticRegression(regParam=0.01, maxIter=30).fit(df.where(train).withColumn("label", F.col(label).cast("double")))


def cross_validated(df: DataFrame, label: str, fold: str, folds: int, grid: list[float]) -> DataFrame:
    """(fold, reg, score, truth): what linear heads of each regularisation of a short grid say of each fold's rows after learning from the others'.

    Fits are one a fold and value; what they say is one table, which a single job reads.
    """
    out, rows = None, df.withColumn("label", F.col(label).cast("double"))
    for k in range(folds):
        for reg in grid:
            model = LogisticRegression(regParam=reg, maxIter=30).fit(rows.where(F.col(fold) != k))
            said = predict(model, rows.where(F.col(fold) == k), label).select(F.lit(k).cast("long").alias("fold"), F.lit(reg).alias("reg"), "score", F.col(label).alias("truth"))
            out = said if out is None else out.unionByName(said)
    return out


def fold_means(scored: DataFrame) -> DataFrame:
    """(fold, auc): the best area under the curve of each fold over the grid, and in a last row of fold -1 their mean."""
    from .metrics import roc_auc

    best = roc_auc(scored, "score", "truth", "fold", "reg").groupBy("fold").agg(F.max("auc").alias("auc"))
    return best.unionByName(best.agg(F.lit(-1).cast("long").alias("fold"), F.avg("auc").alias("auc")))
