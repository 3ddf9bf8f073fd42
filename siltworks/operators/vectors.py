"""Fusion of partial embeddings, and votes of nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fuse(how: str, experts: Column, mask: Column, weights: Column) -> Column:
    """Expert vectors as one: ``gated`` (weighted sum), ``mean`` of the available, ``concat`` with the mask, or ``single:<no>``."""
    scaled = lambda w: F.zip_with(experts, w, lambda e, x: F.transform(e, lambda y: y * x))
    summed = lambda v: F.aggregate(F.slice(v, 2, F.size(v) - 1), F.element_at(v, 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    if how == "gated":
        return summed(scaled(weights))
    if how == "mean":
        n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
        return F.transform(summed(scaled(mask)), lambda x: x / n)
    if how == "concat":
        return F.concat(F.flatten(scaled(mask)), mask)
    kind, _, no = how.partition(":")
    if kind != "single":
        raise ValueError(how)
    return F.element_at(scaled(mask), int(no) + 1)


def class_score(neighbours: DataFrame, labels: DataFrame, temperature: float) -> DataFrame:
    """(query_id, score, nearest): softmax-weighted share of neighbours of class 1; labels are (id, y)."""
    n = neighbours.join(labels.toDF("idx_id", "y"), "idx_id")
    w = n.withColumn("w", F.exp((F.col("sim") - F.max("sim").over(Window.partitionBy("query_id"))) / temperature))
    return w.groupBy("query_id").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("score"), F.max("sim").alias("nearest"))


def tag_votes(neighbours: DataFrame, tags: DataFrame, temperature: float) -> DataFrame:
    """(query_id, tag, score) by the same vote; tags are (id, tags)."""
    n = neighbours.join(tags.toDF("idx_id", "tags"), "idx_id")
    w = n.withColumn("w", F.exp((F.col("sim") - F.max("sim").over(Window.partitionBy("query_id"))) / temperature))
    total = w.groupBy("query_id").agg(F.sum("w").alias("all"))
    votes = w.select("query_id", "w", F.explode("tags").alias("tag")).groupBy("query_id", "tag").agg(F.sum("w").alias("w"))
    return votes.join(total, "query_id").select("query_id", "tag", (F.col("w") / F.col("all")).alias("score"))
