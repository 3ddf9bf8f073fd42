"""Detection, calibration, retrieval and triage metrics as aggregations.

Scores are grouped by value first; the table of distinct scores is accumulated
by ranges (``running_sums``), as it may be as long as the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import at_temperature, clipped
from .running import global_rank, running_sums


def confusion(df: DataFrame, score: str, truth: str, threshold: float = 0.5) -> DataFrame:
    hit, pos = F.col(score) >= threshold, F.col(truth) == 1
    c = df.where(F.col(score).isNotNull()).agg(*(F.count_if(x).alias(n) for n, x in {"tp": hit & pos, "fp": hit & ~pos, "fn": ~hit & pos, "tn": ~hit & ~pos}.items()))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    precision, recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9))
    majority = F.greatest(F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")) / n
    return c.select("tp", "fp", "fn", "tn", *(F.round(x, 6).alias(k) for k, x in {"accuracy": (F.col("tp") + F.col("tn")) / n, "precision": precision, "recall": recall, "f1": f1, "majority": majority}.items()))


def by_score(df: DataFrame, score: str, truth: str, *keys: str) -> DataFrame:
    """(keys, score, pos, neg): rows of each class at each distinct score."""
    return df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))


def roc_auc(df: DataFrame, score: str, truth: str, *keys: str) -> DataFrame:
    """Area under the ROC curve; ties count half; null if there is one class only."""
    t = running_sums(by_score(df, score, truth, *keys), [F.col("score")], ["neg"], list(keys))
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)
    return t.groupBy(*keys).agg(F.round(F.try_divide(F.sum(won), F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def roc_curve(df: DataFrame, score: str, truth: str) -> DataFrame:
    """(threshold, tpr, fpr) at each distinct score."""
    t = running_sums(by_score(df, score, truth), [F.col("score").desc()], ["pos", "neg"])
    total = t.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return t.crossJoin(F.broadcast(total)).select(F.col("score").alias("threshold"), (F.col("pos_upto") / F.col("p")).alias("tpr"), (F.col("neg_upto") / F.col("n")).alias("fpr"))


def average_precision(df: DataFrame, score: str, truth: str, *keys: str) -> DataFrame:
    """Step sum of precision over recall at distinct thresholds."""
    t = running_sums(by_score(df, score, truth, *keys), [F.col("score").desc()], ["pos", "neg"], list(keys))
    part = F.col("pos") * F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto"))
    return t.groupBy(*keys).agg(F.try_divide(F.sum(part), F.sum("pos")).alias("ap"))


def tpr_at_fpr(df: DataFrame, score: str, truth: str, targets: list[float]) -> DataFrame:
    """Greatest TPR with FPR at most each target; 0 if there is none."""
    curve = roc_curve(df, score, truth)
    return curve.agg(*(F.round(F.coalesce(F.max(F.when(F.col("fpr") <= t, F.col("tpr"))), F.lit(0.0)), 6).alias(f"t{i}") for i, t in enumerate(targets)))


def val_threshold(df: DataFrame, score: str, truth: str, part: str, fpr: float) -> DataFrame:
    """A threshold fixed on val negatives, the k-th from the top, and what lies strictly above it in test."""
    neg = df.where((F.col(part) == "val") & (F.col(truth) == 0) & F.col(score).isNotNull())
    t = running_sums(by_score(neg, score, truth), [F.col("score").desc()], ["neg"])
    limit = t.crossJoin(F.broadcast(t.agg(F.floor(fpr * F.sum("neg")).alias("k")))).where("neg_upto > k").agg(F.max("score").alias("threshold"))
    test = df.where((F.col(part) == "test") & F.col(score).isNotNull()).crossJoin(F.broadcast(limit))
    above = F.col(score) > F.col("threshold")
    return test.groupBy("threshold").agg(F.round(F.avg(F.when(F.col(truth) == 1, above.cast("int"))), 6).alias("tpr"), F.round(F.avg(F.when(F.col(truth) == 0, above.cast("int"))), 6).alias("fpr"))


def ece(df: DataFrame, p: Column, truth: str, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    t = df.select(p.alias("p"), F.col(truth).alias("y")).where("p is not null")
    b = t.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("acc"), F.avg("p").alias("conf"))
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), 6).alias("ece"))


def nll(p: Column, y: Column) -> Column:
    q = clipped(p, 1e-7, 1 - 1e-7)
    return -F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))


def fit_temperature(df: DataFrame, p: str, truth: str, low: float = 0.05, high: float = 20.0, steps: int = 200) -> DataFrame:
    """The temperature of a log-spaced grid with the least loss; of equal ones the first."""
    import math

    grid = [math.exp(math.log(low) + i * (math.log(high) - math.log(low)) / (steps - 1)) for i in range(steps)]
    counted = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p"), F.col(truth).alias("y")).agg(F.count("*").alias("n"))
    sums = counted.agg(*(F.sum(F.col("n") * nll(_tempered(t), F.col("y"))).alias(f"t{i}") for i, t in enumerate(grid)), F.sum("n").alias("n"))
    best = F.array_min(F.array(*(F.struct(F.round(F.col(f"t{i}") / F.col("n"), 9).alias("loss"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(grid))))
    return sums.select(F.round(best["t"], 6).alias("temperature"), F.round(best["loss"], 6).alias("loss"))


def _tempered(t: float) -> Column:
    return at_temperature(F.col("p"), t)


def label_retrieval(neighbours: DataFrame, labels: DataFrame, index: DataFrame, ks: list[int]) -> DataFrame:
    """By k: P@k, nDCG@k (ideal from what was retrieved), recall over min(R, k) with R relevant rows in the index, F1, and accuracy of the majority vote.

    Votes: most rows first, then the label whose best rank is smallest.  ``labels`` is (id, y) of queries and index, ``index`` that of the index alone.
    """
    n = neighbours.join(labels.toDF("idx_id", "y"), "idx_id").join(labels.toDF("query_id", "qy"), "query_id")
    total = index.toDF("id", "qy").groupBy("qy").agg(F.count("*").alias("r"))
    at = n.select("query_id", "rank", "y", "qy", F.explode(F.array(*map(F.lit, ks))).alias("k")).where("rank <= k")
    rel = (F.col("y") == F.col("qy")).cast("int")
    votes = at.groupBy("query_id", "k", "qy", "y").agg(F.count("*").alias("n"), F.min("rank").alias("first")).groupBy("query_id", "k", "qy").agg(F.min_by("y", F.struct(-F.col("n"), "first")).alias("vote"))
    q = at.groupBy("query_id", "k", "qy").agg(F.sum(rel).alias("hits"), F.sum(rel / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest("hits", F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    q = q.join(total, "qy", "left").join(votes.select("query_id", "k", "vote"), ["query_id", "k"])
    p, rc = F.col("hits") / F.col("k"), F.col("hits") / F.greatest(F.least("r", "k"), F.lit(1))
    f1 = F.when(p + rc > 0, 2 * p * rc / (p + rc)).otherwise(0.0)
    scores = {"precision": p, "ndcg": F.when(F.col("hits") > 0, F.col("dcg") / ideal).otherwise(0.0), "recall": rc, "f1": f1, "vote_accuracy": (F.col("vote") == F.col("qy")).cast("int")}
    return q.groupBy("k").agg(F.count("*").alias("n"), *(F.round(F.avg(x), 6).alias(c) for c, x in scores.items()))


def tag_retrieval(neighbours: DataFrame, queries: DataFrame, index: DataFrame, ks: list[int]) -> DataFrame:
    """By k: P@k and nDCG@k where sharing a tag is relevant; the ideal counts relevant rows of the whole index, by tag signature."""
    qt, it = queries.toDF("query_id", "qt"), index.toDF("idx_id", "it")
    n = neighbours.join(it, "idx_id").join(qt, "query_id").withColumn("rel", F.arrays_overlap("qt", "it").cast("int"))
    signature = lambda c: F.array_join(c, ",")
    i_sig = it.groupBy(signature("it").alias("is")).agg(F.first("it").alias("it"), F.count("*").alias("n"))
    q_sig = qt.groupBy(signature("qt").alias("qs")).agg(F.first("qt").alias("qt"))
    # signatures that share a tag, once each: tables of the tags' combinations, not of rows
    shared = q_sig.select("qs", F.explode("qt").alias("tag")).join(i_sig.select("is", F.explode("it").alias("tag")), "tag").select("qs", "is").distinct()
    n_rel = shared.join(i_sig.select("is", "n"), "is").groupBy("qs").agg(F.sum("n").alias("n_rel"))
    at = n.select("query_id", "rank", "rel", signature("qt").alias("qs"), F.explode(F.array(*map(F.lit, ks))).alias("k")).where("rank <= k")
    q = at.groupBy("query_id", "k", "qs").agg(F.sum("rel").alias("hits"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg")).join(n_rel, "qs", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("k", F.coalesce("n_rel", F.lit(0))), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return q.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hits") / F.col("k")), 6).alias("precision"), F.round(F.avg(F.when(F.coalesce("n_rel", F.lit(0)) > 0, F.col("dcg") / ideal).otherwise(0.0)), 6).alias("ndcg"))


def multilabel(df: DataFrame, threshold: Column | float) -> DataFrame:
    """Micro precision, recall and F1, macro F1 (labels without support count 0) and mAP over labels with support, of (tag, truth, score)."""
    hit, pos = F.col("score") >= threshold, F.col("truth") == 1
    c = df.groupBy("tag").agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"))
    ap = average_precision(df, "score", "truth", "tag")
    t = c.join(ap, "tag", "left")
    tp, fp, fn = (F.sum(x) for x in ("tp", "fp", "fn"))
    macro = F.avg(2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)))
    supported = F.when(F.col("tp") + F.col("fn") > 0, F.col("ap"))
    return t.agg(*(F.round(x, 6).alias(k) for k, x in {"micro_p": tp / F.greatest(tp + fp, F.lit(1)), "micro_r": tp / F.greatest(tp + fn, F.lit(1)), "micro_f1": 2 * tp / F.greatest(2 * tp + fp + fn, F.lit(1)), "macro_f1": macro, "map": F.avg(supported)}.items()))


def select_threshold(df: DataFrame, grid: list[float]) -> DataFrame:
    """The threshold of the grid with the greatest micro F1; of equal ones the first."""
    cells = df.select("truth", "score", F.explode(F.array(*map(F.lit, grid))).alias("t"))
    hit, pos = F.col("score") >= F.col("t"), F.col("truth") == 1
    c = cells.groupBy("t").agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"))
    f1 = F.round(2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)), 9)
    return c.agg(F.max(F.struct(f1.alias("f1"), (-F.col("t")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("threshold"), F.round("b.f1", 6).alias("f1"))


def mixed(df: DataFrame, first: str, second: str, steps: int = 10) -> DataFrame:
    """Each row once for every weight 0, 1/steps, ..., 1 of ``first`` against ``second``: ``alpha``, ``mixed``."""
    cells = df.select("*", F.explode(F.array(*(F.lit(i / steps) for i in range(steps + 1)))).alias("alpha"))
    return cells.withColumn("mixed", F.round(F.col("alpha") * F.col(first) + (1 - F.col("alpha")) * F.col(second), 6))


def best_mix(val: DataFrame, first: str, second: str, truth: str, steps: int = 10) -> DataFrame:
    """(alpha, ap): the weight with the greatest average precision on validation rows; of equal ones the least."""
    scored = average_precision(mixed(val, first, second, steps), "mixed", truth, "alpha").select("alpha", F.round("ap", 9).alias("ap"))
    return scored.agg(F.max(F.struct("ap", (-F.col("alpha")).alias("low"))).alias("b")).select((-F.col("b.low")).alias("alpha"), F.col("b.ap").alias("ap"))


def risk_coverage(df: DataFrame, novelty: str, key: str, score: str, truth: str, shares: list[float]) -> DataFrame:
    """Metrics over the least novel share of rows, for each share."""
    ranked = global_rank(df, [F.col(novelty), F.col(key)], "rank")
    ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("__n"))))
    cells = ranked.select("*", F.explode(F.array(*map(F.lit, shares))).alias("share")).where(F.col("rank") <= F.bround(F.col("share") * F.col("__n")))
    hit, pos = F.col(score) >= 0.5, F.col(truth) == 1
    return cells.groupBy("share").agg(F.count("*").alias("n"), F.round(F.avg((hit == pos).cast("int")), 6).alias("accuracy"), F.round(F.avg(F.when(pos, hit.cast("int"))), 6).alias("recall"), F.round(F.avg(F.when(~pos, hit.cast("int"))), 6).alias("fpr"))
