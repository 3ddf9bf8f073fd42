"""Queries: nearest neighbours and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import sigmoid
from ..operators import metrics as M
from ..operators import report as R
from ..operators import vectors as V
from ..operators.neighbours import knn, knn_cells
from ..sources.tables import kept, workspace
from . import fixtures as X
from .accounting import EVAL, eval_records
from .registry import query, table

S = SparkSession


def neighbour_sql(vec: str = "emb", k: int = 20, query_where: str = "part = 'test'", index_where: str = "part <> 'test'", order: str = "sim DESC", sim: str = "list_dot_product(q.u, i.u)", more: str = "") -> str:
    """CTEs up to ``nb`` (query_id, idx_id, rank, sim)."""
    return f"""{X.VECTORS}, units AS (SELECT *, list_transform({vec}, lambda x: x / greatest(sqrt(list_sum(list_transform({vec}, lambda z: z * z))), 1e-12)) AS u FROM vectors WHERE {vec} IS NOT NULL),
sims AS (SELECT q.vec_id AS query_id, i.vec_id AS idx_id, round({sim}, 9) AS sim FROM (SELECT * FROM units WHERE {query_where}) q, (SELECT * FROM units WHERE {index_where}) i {more}),
nb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, idx_id) AS rank FROM sims QUALIFY rank <= {k})"""


def neighbours(spark: S, d: str, vec: str = "emb", k: int = 20, metric: str = "cosine") -> DataFrame:
    v = X.vectors(spark, d)
    return knn(v.where("part = 'test'").select("vec_id", vec), v.where("part <> 'test'").select("vec_id", vec), k, metric)


def shown(n: DataFrame) -> DataFrame:
    return n.select("query_id", "idx_id", "rank", F.round("sim", 6).alias("sim"))


NB = "SELECT query_id, idx_id, rank, round(sim, 6) AS sim FROM nb"


@query(f"WITH {neighbour_sql(k=10)} {NB}")
def knn_cosine(spark: S, d: str) -> DataFrame:
    return shown(neighbours(spark, d, k=10))


@query(f"WITH {neighbour_sql(k=10, sim='-list_sum(list_transform(list_zip(q.u, i.u), lambda p: (p[1] - p[2]) ** 2))')} {NB}")
def knn_l2(spark: S, d: str) -> DataFrame:
    return shown(neighbours(spark, d, k=10, metric="l2"))


@query(f"WITH {neighbour_sql(k=5, index_where='true', more='WHERE q.vec_id <> i.vec_id')} {NB}")
def knn_self_excluded(spark: S, d: str) -> DataFrame:
    v = X.vectors(spark, d)
    return shown(knn(v.where("part = 'test'").select("vec_id", "emb"), v.select("vec_id", "emb"), 5, exclude_self=True))


@query(f"WITH {neighbour_sql('b', 10)} {NB}")
def knn_covered(spark: S, d: str) -> DataFrame:
    return shown(neighbours(spark, d, "b", 10))


SCORED = f"""{neighbour_sql()}, w AS (SELECT query_id, idx_id, sim, exp((sim - max(sim) OVER (PARTITION BY query_id)) / 0.07) AS w FROM nb),
cls AS (SELECT query_id, sum(w * y) / sum(w) AS score, max(sim) AS nearest FROM w JOIN vectors ON vec_id = idx_id GROUP BY 1)"""


def class_scores(spark: S, d: str) -> DataFrame:
    return V.class_score(neighbours(spark, d), X.vectors(spark, d).select("vec_id", "y"), 0.07)


@query(f"WITH {SCORED} SELECT query_id, round(score, 6) AS score, round(nearest, 6) AS nearest FROM cls")
def knn_score(spark: S, d: str) -> DataFrame:
    return class_scores(spark, d).select("query_id", F.round("score", 6).alias("score"), F.round("nearest", 6).alias("nearest"))


@query(f"""WITH {neighbour_sql()}, w AS (SELECT query_id, idx_id, exp((sim - max(sim) OVER (PARTITION BY query_id)) / 0.3) AS w FROM nb),
al AS (SELECT query_id, sum(w) AS a FROM w GROUP BY 1), t AS (SELECT query_id, w, unnest(tags) AS tag FROM w JOIN vectors ON vec_id = idx_id)
SELECT query_id, tag, round(sum(w) / any_value(a), 6) AS score FROM t JOIN al USING (query_id) GROUP BY 1, 2""")
def knn_tag_scores(spark: S, d: str) -> DataFrame:
    t = V.tag_votes(neighbours(spark, d), X.vectors(spark, d).select("vec_id", "tags"), 0.3)
    return t.select("query_id", "tag", F.round("score", 6).alias("score"))


@query(f"WITH {SCORED} SELECT query_id, round(1 - nearest, 6) AS novelty FROM cls")
def novelty(spark: S, d: str) -> DataFrame:
    return class_scores(spark, d).select("query_id", F.round(1 - F.col("nearest"), 6).alias("novelty"))


@query()
def knn_lsh_recall(spark: S, d: str) -> DataFrame:
    """The share of the exact neighbours that cells and sign sketches find, and of the pairs compared in full for that."""
    v = X.vectors(spark, d)
    index = v.where("part <> 'test'").select("vec_id", "emb")
    near = knn_cells(v.where("part = 'test'").select("vec_id", "emb"), index, 10)
    share = near.select("query_id", "compared").distinct().crossJoin(F.broadcast(index.agg(F.count("*").alias("rows")))).agg(F.round(F.avg(F.col("compared") / F.col("rows")), 4).alias("compared_share"))
    hits = neighbours(spark, d, k=10).join(near.select("query_id", "idx_id", F.lit(1).alias("hit")), ["query_id", "idx_id"], "left")
    return hits.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall")).crossJoin(share)


# ---------------------------------------------------------------- detection

CONF = """c AS (SELECT count_if(score >= 0.5 AND y = 1) AS tp, count_if(score >= 0.5 AND y = 0) AS fp, count_if(score < 0.5 AND y = 1) AS fn, count_if(score < 0.5 AND y = 0) AS tn FROM scores WHERE score IS NOT NULL),
m AS (SELECT *, tp + fp + fn + tn AS n, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM c)"""


@query(f"WITH {X.SCORES}, {CONF} SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp + tn) / n, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(p + r, 1e-9), 6) AS f1, round(greatest(tp + fn, fp + tn) / n, 6) AS majority FROM m")
def detection_metrics(spark: S, d: str) -> DataFrame:
    return M.confusion(X.scores(spark, d), "score", "y")


GROUPED = "g AS (SELECT score, count_if(y = 1)::BIGINT AS pos, count_if(y = 0)::BIGINT AS neg FROM scores WHERE score IS NOT NULL GROUP BY 1)"
CURVE = GROUPED + ", curve AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) / sum(pos) OVER () AS tpr, sum(neg) OVER (ORDER BY score DESC) / sum(neg) OVER () AS fpr FROM g)"


@query(f"WITH {X.SCORES}, {GROUPED}, w AS (SELECT pos * (sum(neg) OVER (ORDER BY score) - neg + neg / 2) AS won, pos, neg FROM g) SELECT round(sum(won) / (sum(pos) * sum(neg)), 6) AS auc FROM w")
def roc_auc(spark: S, d: str) -> DataFrame:
    return M.roc_auc(X.scores(spark, d), "score", "y")


@query(f"WITH {X.SCORES}, {CURVE} SELECT score AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM curve")
def roc_curve(spark: S, d: str) -> DataFrame:
    return M.roc_curve(X.scores(spark, d), "score", "y").select("threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


AP = "a AS (SELECT pos, pos * sum(pos) OVER w / (sum(pos) OVER w + sum(neg) OVER w) AS part FROM g WINDOW w AS (ORDER BY score DESC))"


@query(f"WITH {X.SCORES}, {GROUPED}, {AP} SELECT round(sum(part) / sum(pos), 6) AS ap FROM a")
def average_precision(spark: S, d: str) -> DataFrame:
    return M.average_precision(X.scores(spark, d), "score", "y").select(F.round("ap", 6).alias("ap"))


@query(f"WITH {X.SCORES}, {CURVE} SELECT round(coalesce(max(tpr) FILTER (fpr <= 0.001), 0), 6) AS t0, round(coalesce(max(tpr) FILTER (fpr <= 0.01), 0), 6) AS t1, round(coalesce(max(tpr) FILTER (fpr <= 0.1), 0), 6) AS t2 FROM curve")
def tpr_at_fpr(spark: S, d: str) -> DataFrame:
    return M.tpr_at_fpr(X.scores(spark, d), "score", "y", [0.001, 0.01, 0.1])


@query(f"WITH {X.SCORES} SELECT count_if(y = 0)::BIGINT AS negatives, count_if(y = 0) * 0.001 >= 10 AS reliable_1e3, count_if(y = 0) * 0.1 >= 10 AS reliable_1e1 FROM scores WHERE score IS NOT NULL")
def reliability_flag(spark: S, d: str) -> DataFrame:
    n = F.count_if(F.col("y") == 0)
    return X.scores(spark, d).where("score is not null").agg(n.alias("negatives"), (n * 0.001 >= 10).alias("reliable_1e3"), (n * 0.1 >= 10).alias("reliable_1e1"))


@query(f"""WITH {X.SCORES}, n AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS rn, count(*) OVER () AS c FROM scores WHERE part = 'val' AND y = 0 AND score IS NOT NULL),
t AS (SELECT score AS threshold FROM n WHERE rn = floor(0.05 * c) + 1)
SELECT threshold, round(avg((score > threshold)::INTEGER) FILTER (y = 1), 6) AS tpr, round(avg((score > threshold)::INTEGER) FILTER (y = 0), 6) AS fpr FROM scores, t WHERE part = 'test' AND score IS NOT NULL GROUP BY 1""")
def val_threshold(spark: S, d: str) -> DataFrame:
    return M.val_threshold(X.scores(spark, d), "score", "y", "part", 0.05)


@query(f"WITH {X.SCORES}, b AS (SELECT least(floor(score * 15), 14) AS bin, count(*) AS n, avg(y) AS acc, avg(score) AS conf FROM scores WHERE score IS NOT NULL GROUP BY 1) SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM b")
def ece(spark: S, d: str) -> DataFrame:
    return M.ece(X.scores(spark, d), F.col("score"), "y")


@query(f"""WITH {X.SCORES}, grid AS (SELECT i, exp(ln(0.05) + i * (ln(20.0) - ln(0.05)) / 199) AS t FROM range(200) r(i)),
l AS (SELECT y, ln(least(greatest(score, 1e-7), 1 - 1e-7) / (1 - least(greatest(score, 1e-7), 1 - 1e-7))) AS z FROM scores WHERE part = 'val' AND score IS NOT NULL),
p AS (SELECT i, t, y, least(greatest(1 / (1 + exp(-least(greatest(z / t, -50), 50))), 1e-7), 1 - 1e-7) AS p FROM l, grid),
s AS (SELECT i, t, round(avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 9) AS loss FROM p GROUP BY ALL)
SELECT round(t, 6) AS temperature, round(loss, 6) AS loss FROM s ORDER BY s.loss, i LIMIT 1""")
def fit_temperature(spark: S, d: str) -> DataFrame:
    return M.fit_temperature(X.scores(spark, d).where("part = 'val'"), "score", "y")


@query(f"""WITH {neighbour_sql()}, n AS (SELECT query_id, rank, i.label AS y, q.label AS qy FROM nb JOIN vectors i ON i.vec_id = idx_id JOIN vectors q ON q.vec_id = query_id),
tot AS (SELECT label AS qy, count(*) AS r FROM vectors WHERE part <> 'test' GROUP BY 1), tops AS (SELECT * FROM n, (SELECT unnest([1, 5, 10]) AS k) WHERE rank <= k),
v AS (SELECT query_id, k, y, row_number() OVER (PARTITION BY query_id, k ORDER BY count(*) DESC, min(rank)) AS o FROM tops GROUP BY query_id, k, y),
q AS (SELECT query_id, k, qy, sum((y = qy)::INTEGER) AS hits, sum((y = qy)::INTEGER / log2(rank + 1)) AS dcg FROM tops GROUP BY ALL),
e AS (SELECT q.*, coalesce(r, NULL) AS r, v.y AS vote, hits / q.k AS p, hits / greatest(least(r, q.k), 1) AS rc, list_sum(list_transform(range(1, greatest(hits, 1)::BIGINT + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM q LEFT JOIN tot USING (qy) JOIN v ON v.query_id = q.query_id AND v.k = q.k AND v.o = 1)
SELECT k::INTEGER AS k, count(*) AS n, round(avg(p), 6) AS precision, round(avg(CASE WHEN hits > 0 THEN dcg / ideal ELSE 0 END), 6) AS ndcg, round(avg(rc), 6) AS recall, round(avg(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END), 6) AS f1, round(avg((vote = qy)::INTEGER), 6) AS vote_accuracy FROM e GROUP BY 1""")
def label_retrieval_at_k(spark: S, d: str) -> DataFrame:
    v = X.vectors(spark, d)
    return M.label_retrieval(neighbours(spark, d), v.select("vec_id", "label"), v.where("part <> 'test'").select("vec_id", "label"), [1, 5, 10])


@query(f"""WITH {neighbour_sql(query_where="part = 'test' AND y = 1", index_where="part <> 'test' AND y = 1")}, ix AS (SELECT * FROM vectors WHERE part <> 'test' AND y = 1), qs AS (SELECT * FROM vectors WHERE part = 'test' AND y = 1),
nr AS (SELECT qs.vec_id AS query_id, count(*) FILTER (len(list_intersect(qs.tags, ix.tags)) > 0) AS n_rel FROM qs, ix GROUP BY 1),
n AS (SELECT query_id, rank, (len(list_intersect(q.tags, i.tags)) > 0)::INTEGER AS rel FROM nb JOIN vectors i ON i.vec_id = idx_id JOIN vectors q ON q.vec_id = query_id),
a AS (SELECT query_id, k, sum(rel) AS hits, sum(rel / log2(rank + 1)) AS dcg FROM n, (SELECT unnest([1, 5, 10]) AS k) WHERE rank <= k GROUP BY ALL)
SELECT k::INTEGER AS k, count(*) AS n, round(avg(hits / k), 6) AS precision, round(avg(CASE WHEN n_rel > 0 THEN dcg / list_sum(list_transform(range(1, least(k, n_rel) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END), 6) AS ndcg FROM a JOIN nr USING (query_id) GROUP BY 1""")
def tag_retrieval_at_k(spark: S, d: str) -> DataFrame:
    v = X.vectors(spark, d).where("y = 1")
    q, i = v.where("part = 'test'"), v.where("part <> 'test'")
    n = knn(q.select("vec_id", "emb"), i.select("vec_id", "emb"), 20)
    return M.tag_retrieval(n, q.select("vec_id", "tags"), i.select("vec_id", "tags"), [1, 5, 10])


@query(f"WITH {neighbour_sql()} SELECT count(*) AS n, round(avg((i.label = q.label)::INTEGER), 6) AS accuracy FROM nb JOIN vectors i ON i.vec_id = idx_id JOIN vectors q ON q.vec_id = query_id WHERE rank = 1")
def accuracy_at_1(spark: S, d: str) -> DataFrame:
    v = X.vectors(spark, d).select("vec_id", "label")
    n = neighbours(spark, d).where("rank = 1").join(v.toDF("idx_id", "y"), "idx_id").join(v.toDF("query_id", "qy"), "query_id")
    return n.agg(F.count("*").alias("n"), F.round(F.avg((F.col("y") == F.col("qy")).cast("int")), 6).alias("accuracy"))


TAG_COUNTS = """ct AS (SELECT tag, count_if(score >= 0.5 AND truth = 1) AS tp, count_if(score >= 0.5 AND truth = 0) AS fp, count_if(score < 0.5 AND truth = 1) AS fn FROM tag_scores GROUP BY 1),
tg AS (SELECT tag, score, count_if(truth = 1)::BIGINT AS pos, count_if(truth = 0)::BIGINT AS neg FROM tag_scores GROUP BY 1, 2),
ta AS (SELECT tag, pos, pos * sum(pos) OVER w / (sum(pos) OVER w + sum(neg) OVER w) AS part FROM tg WINDOW w AS (PARTITION BY tag ORDER BY score DESC)),
tap AS (SELECT tag, sum(part) / nullif(sum(pos), 0) AS ap FROM ta GROUP BY 1)"""


@query(f"""WITH {X.TAG_SCORES}, {TAG_COUNTS} SELECT round(sum(tp) / greatest(sum(tp) + sum(fp), 1), 6) AS micro_p, round(sum(tp) / greatest(sum(tp) + sum(fn), 1), 6) AS micro_r, round(2 * sum(tp) / greatest(2 * sum(tp) + sum(fp) + sum(fn), 1), 6) AS micro_f1,
round(avg(2 * tp / greatest(2 * tp + fp + fn, 1)), 6) AS macro_f1, round(avg(ap) FILTER (tp + fn > 0), 6) AS map FROM ct JOIN tap USING (tag)""")
def multilabel_metrics(spark: S, d: str) -> DataFrame:
    return M.multilabel(X.tag_scores(spark, d), 0.5)


@query(f"""WITH {X.TAG_SCORES}, grid AS (SELECT (5 * i) / 100.0 AS t FROM range(1, 19) r(i)), c AS (SELECT t, count_if(score >= t AND truth = 1) AS tp, count_if(score >= t AND truth = 0) AS fp, count_if(score < t AND truth = 1) AS fn FROM tag_scores, grid GROUP BY 1),
f AS (SELECT t, round(2 * tp / greatest(2 * tp + fp + fn, 1), 9) AS f1 FROM c) SELECT t::DOUBLE AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, t LIMIT 1""")
def select_threshold(spark: S, d: str) -> DataFrame:
    return M.select_threshold(X.tag_scores(spark, d), [5 * i / 100 for i in range(1, 19)])


@query(f"""WITH {X.TAG_SCORES}, grid AS (SELECT (5 * i) / 100.0 AS t FROM range(1, 19) r(i)), c AS (SELECT t, count_if(score >= t AND truth = 1) AS tp, count_if(score >= t AND truth = 0) AS fp, count_if(score < t AND truth = 1) AS fn FROM tag_scores, grid WHERE part = 'val' GROUP BY 1),
b AS (SELECT t FROM c ORDER BY round(2 * tp / greatest(2 * tp + fp + fn, 1), 9) DESC, t LIMIT 1),
e AS (SELECT count_if(score >= t AND truth = 1)::BIGINT AS tp, count_if(score >= t AND truth = 0)::BIGINT AS fp, count_if(score < t AND truth = 1)::BIGINT AS fn FROM tag_scores, b WHERE part = 'test')
SELECT t::DOUBLE AS threshold, tp, fp, fn, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS micro_f1 FROM e, b""")
def threshold_from_val(spark: S, d: str) -> DataFrame:
    """The threshold that is best on the validation part, and what it gives on the test part."""
    scores = X.tag_scores(spark, d)
    best = M.select_threshold(scores.where("part = 'val'"), [5 * i / 100 for i in range(1, 19)]).select("threshold")
    hit, true = F.col("score") >= F.col("threshold"), F.col("truth") == 1
    test = scores.where("part = 'test'").withColumn("threshold", best.scalar())
    counts = test.agg(F.max("threshold").alias("threshold"), F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"))
    return counts.withColumn("micro_f1", F.round(2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)), 6))


FUSED = f"""{SCORED}, f AS (SELECT query_id, y, score AS knn, round(1 / (1 + exp(-8 * emb[1])), 3) AS head FROM cls JOIN vectors ON vec_id = query_id),
al AS (SELECT i / 10.0 AS alpha, y, round((i / 10.0) * head + (1 - i / 10.0) * knn, 6) AS score FROM f, range(11) r(i)),
g AS (SELECT alpha, score, count_if(y = 1)::BIGINT AS pos, count_if(y = 0)::BIGINT AS neg FROM al GROUP BY 1, 2),
a AS (SELECT alpha, pos, pos * sum(pos) OVER w / (sum(pos) OVER w + sum(neg) OVER w) AS part FROM g WINDOW w AS (PARTITION BY alpha ORDER BY score DESC))"""


@query(f"WITH {FUSED} SELECT alpha::DOUBLE AS alpha, round(sum(part) / sum(pos), 6) AS ap FROM a GROUP BY 1")
def fuse_alpha(spark: S, d: str) -> DataFrame:
    head = X.vectors(spark, d).select(F.col("vec_id").alias("query_id"), "y", F.round(sigmoid(8 * F.col("emb")[0]), 3).alias("head"))
    f = class_scores(spark, d).join(head, "query_id").select("y", "score", "head", F.explode(F.array(*(F.lit(i / 10) for i in range(11)))).alias("alpha"))
    f = f.withColumn("mixed", F.round(F.col("alpha") * F.col("head") + (1 - F.col("alpha")) * F.col("score"), 6))
    return M.average_precision(f, "mixed", "y", "alpha").select("alpha", F.round("ap", 6).alias("ap"))


#: Scores of validation rows by their neighbours in train, and of test rows by those in train and validation.
PHASED = f"""{X.VECTORS}, units AS (SELECT *, list_transform(emb, lambda x: x / greatest(sqrt(list_sum(list_transform(emb, lambda z: z * z))), 1e-12)) AS u FROM vectors),
sims AS (SELECT q.vec_id AS query_id, i.y AS iy, i.vec_id AS idx_id, round(list_dot_product(q.u, i.u), 9) AS sim FROM units q JOIN units i ON (q.part = 'val' AND i.part = 'train') OR (q.part = 'test' AND i.part <> 'test')),
nb AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, idx_id) <= 20),
w AS (SELECT query_id, iy, exp((sim - max(sim) OVER (PARTITION BY query_id)) / 0.07) AS w FROM nb),
heads AS (SELECT vec_id AS query_id, part, y, round(any_value(1 / (1 + exp(-8 * emb[1]))), 3) AS head, round(sum(w * iy) / sum(w), 6) AS knn FROM w JOIN vectors ON vec_id = query_id GROUP BY 1, 2, 3)"""


def phased(spark: S, d: str) -> DataFrame:
    """(query_id, part, y, head, knn) of validation and test rows."""
    v, out = X.vectors(spark, d), None
    for part, seen in (("val", "part = 'train'"), ("test", "part <> 'test'")):
        near = knn(v.where(F.col("part") == part).select("vec_id", "emb"), v.where(seen).select("vec_id", "emb"), 20)
        scored = V.class_score(near, v.select("vec_id", "y"), 0.07)
        out = scored if out is None else out.unionByName(scored)
    head = v.select(F.col("vec_id").alias("query_id"), "part", "y", F.round(sigmoid(8 * F.col("emb")[0]), 3).alias("head"))
    return head.join(out.select("query_id", F.round("score", 6).alias("knn")), "query_id")


@query(f"""WITH {PHASED}, al AS (SELECT i / 10.0 AS alpha, part, y, round((i / 10.0) * head + (1 - i / 10.0) * knn, 6) AS score FROM heads, range(11) r(i)),
g AS (SELECT part, alpha, score, count_if(y = 1)::BIGINT AS pos, count_if(y = 0)::BIGINT AS neg FROM al GROUP BY 1, 2, 3),
s AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (PARTITION BY part, alpha ORDER BY score DESC)),
ap AS (SELECT part, alpha, sum(pos * tp / (tp + fp)) / sum(pos) AS ap, sum(pos * (sum_neg - fp + neg / 2)) / (sum(pos) * any_value(sum_neg)) AS auc FROM (SELECT *, sum(neg) OVER (PARTITION BY part, alpha) AS sum_neg FROM s) GROUP BY 1, 2),
b AS (SELECT alpha FROM ap WHERE part = 'val' ORDER BY round(ap, 9) DESC, alpha LIMIT 1),
c AS (SELECT count_if(score >= 0.5 AND y = 1) AS tp, count_if(score >= 0.5 AND y = 0) AS fp, count_if(score < 0.5 AND y = 1) AS fn, count_if(score < 0.5 AND y = 0) AS tn FROM al JOIN b USING (alpha) WHERE part = 'test'),
m AS (SELECT tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r, (tp + tn) / (tp + fp + fn + tn) AS acc FROM c)
SELECT alpha::DOUBLE AS alpha, round(acc, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(p + r, 1e-9), 6) AS f1, round(auc, 6) AS roc_auc, round(ap, 6) AS pr_auc FROM b JOIN ap USING (alpha), m WHERE part = 'test'""")
def fuse_alpha_from_val(spark: S, d: str) -> DataFrame:
    """The weight of head against neighbours that is best on validation, and what it gives on test."""
    rows = kept(phased(spark, d), "phased")
    best = kept(M.best_mix(rows.where("part = 'val'"), "head", "knn", "y").select("alpha"), "alpha")
    test = rows.where("part = 'test'").crossJoin(F.broadcast(best)).withColumn("mixed", F.round(F.col("alpha") * F.col("head") + (1 - F.col("alpha")) * F.col("knn"), 6))
    measures = M.confusion(test, "mixed", "y").select("accuracy", "precision", "recall", "f1")
    auc, ap = M.roc_auc(test, "mixed", "y").toDF("roc_auc"), M.average_precision(test, "mixed", "y").select(F.round("ap", 6).alias("pr_auc"))
    return best.crossJoin(measures).crossJoin(auc).crossJoin(ap)  # a row each


@query(f"""WITH {SCORED}, f AS (SELECT (round(score, 9) >= 0.5) <> (y = 1) AS wrong, round(1 - nearest, 9) AS novelty FROM cls JOIN vectors ON vec_id = query_id),
p AS (SELECT count(*) AS pairs, sum(CASE WHEN a.novelty > b.novelty THEN 1.0 WHEN a.novelty = b.novelty THEN 0.5 ELSE 0 END) AS won FROM f a JOIN f b ON a.wrong AND NOT b.wrong)
SELECT (SELECT count_if(wrong) FROM f)::BIGINT AS errors, CASE WHEN pairs > 0 THEN round(won / pairs, 6)::DOUBLE END AS auroc FROM p""")
def novelty_auroc(spark: S, d: str) -> DataFrame:
    """How well novelty tells the errors of the neighbours' score from its hits."""
    y = X.vectors(spark, d).select(F.col("vec_id").alias("query_id"), "y")
    wrong = ((F.round("score", 9) >= 0.5) != (F.col("y") == 1)).cast("int")
    f = kept(class_scores(spark, d).join(y, "query_id").select(wrong.alias("wrong"), F.round(1 - F.col("nearest"), 9).alias("novelty")), "novelty")
    return f.agg(F.count_if(F.col("wrong") == 1).alias("errors")).crossJoin(M.roc_auc(f, "novelty", "wrong").select(F.col("auc").alias("auroc")))


#: Experts by the rows that they cover; the last one covers too few.
EXPERTS = {"a": "a IS NOT NULL", "b": "b IS NOT NULL", "c": "c IS NOT NULL", "few": "vec_id % 50 = 0"}


def matched_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{n}' AS expert, vec_id, part, y, tags, label, emb AS whole, {'emb' if n == 'few' else n} AS own FROM vectors WHERE {w}" for n, w in EXPERTS.items())
    unit = lambda v: f"list_transform({v}, lambda x: x / greatest(sqrt(list_sum(list_transform({v}, lambda z: z * z))), 1e-12))"
    return f"""WITH {X.VECTORS}, cover AS ({rows}),
enough AS (SELECT expert FROM cover GROUP BY 1 HAVING least(count_if(part = 'train'), count_if(part = 'val'), count_if(part = 'test')) >= 10),
cu AS (SELECT * EXCLUDE (whole, own), {unit("whole")} AS w, {unit("own")} AS o FROM cover SEMI JOIN enough USING (expert)),
alls AS (SELECT vec_id, label, y, tags, {unit("emb")} AS w FROM vectors WHERE part <> 'test'),
e1 AS (SELECT q.expert, q.vec_id, q.y = i.y AS hit, len(q.tags) > 0 AND q.y = 1 AS tagged, len(list_intersect(q.tags, i.tags)) > 0 AS shares FROM cu q JOIN cu i ON q.expert = i.expert AND q.part = 'test' AND i.part <> 'test'
  QUALIFY row_number() OVER (PARTITION BY q.expert, q.vec_id ORDER BY round(list_dot_product(q.o, i.o), 9) DESC, i.vec_id) = 1),
f1 AS (SELECT q.expert, q.vec_id, q.y = i.y AS hit, len(q.tags) > 0 AND q.y = 1 AS tagged, len(list_intersect(q.tags, i.tags)) > 0 AS shares FROM cu q JOIN alls i ON q.part = 'test'
  QUALIFY row_number() OVER (PARTITION BY q.expert, q.vec_id ORDER BY round(list_dot_product(q.w, i.w), 9) DESC, i.vec_id) = 1)
SELECT e.expert, e.n_queries, e.acc AS expert_acc, f.acc AS fused_acc, e.tag_p AS expert_tag_p, f.tag_p AS fused_tag_p
FROM (SELECT expert, count(*) AS n_queries, round(avg(hit::INTEGER), 6) AS acc, round(avg(shares::INTEGER) FILTER (tagged), 6) AS tag_p FROM e1 GROUP BY 1) e
JOIN (SELECT expert, round(avg(hit::INTEGER), 6) AS acc, round(avg(shares::INTEGER) FILTER (tagged), 6) AS tag_p FROM f1 GROUP BY 1) f USING (expert)"""


@query(matched_sql())
def matched_experts(spark: S, d: str) -> DataFrame:
    """Each expert on the test rows that it covers, against the fused vector on the same rows; experts with under 10 rows in a part are left out."""
    v, out = X.vectors(spark, d), None
    seen = v.where("part <> 'test'")
    counts = v.agg(*(F.count_if(F.expr(w) & (F.col("part") == p)).alias(f"{n}_{p}") for n, w in EXPERTS.items() for p in ("train", "val", "test"))).first()
    facts = v.select("vec_id", "y", "tags")

    def first(queries: DataFrame, index: DataFrame) -> DataFrame:
        near = knn(queries, index, 1).select("query_id", "idx_id").join(facts.toDF("idx_id", "iy", "itags"), "idx_id").join(facts.toDF("query_id", "qy", "qtags"), "query_id")
        tagged = (F.size("qtags") > 0) & (F.col("qy") == 1)
        return near.agg(F.count("*").alias("n_queries"), F.round(F.avg((F.col("qy") == F.col("iy")).cast("int")), 6).alias("acc"), F.round(F.avg(F.when(tagged, F.arrays_overlap("qtags", "itags").cast("int"))), 6).alias("tag_p"))

    for n, w in EXPERTS.items():  # a short list of experts
        if min(counts[f"{n}_{p}"] for p in ("train", "val", "test")) < 10:
            continue
        own = "emb" if n == "few" else n
        q = v.where("part = 'test'").where(w)
        expert = first(q.select("vec_id", own), seen.where(w).select("vec_id", own)).toDF("n_queries", "expert_acc", "expert_tag_p")
        fused = first(q.select("vec_id", "emb"), seen.select("vec_id", "emb")).toDF("__n", "fused_acc", "fused_tag_p").drop("__n")
        row = expert.crossJoin(fused).withColumn("expert", F.lit(n))  # a row each
        out = row if out is None else out.unionByName(row)
    return out.select("expert", "n_queries", "expert_acc", "fused_acc", "expert_tag_p", "fused_tag_p")


@query(f"""WITH {SCORED}, f AS (SELECT query_id, y, round(score, 9) AS score, round(1 - nearest, 9) AS novelty FROM cls JOIN vectors ON vec_id = query_id), r AS (SELECT *, row_number() OVER (ORDER BY novelty, query_id) AS rank, count(*) OVER () AS n FROM f),
s AS (SELECT share, score >= 0.5 AS hit, y = 1 AS pos FROM r, (SELECT unnest([1.0, 0.95, 0.9, 0.8])::DOUBLE AS share) WHERE rank <= round_even(share * n, 0))
SELECT share, count(*) AS n, round(avg((hit = pos)::INTEGER), 6) AS accuracy, round(avg(hit::INTEGER) FILTER (pos), 6) AS recall, round(avg(hit::INTEGER) FILTER (NOT pos), 6) AS fpr FROM s GROUP BY 1""")
def risk_coverage(spark: S, d: str) -> DataFrame:
    y = X.vectors(spark, d).select(F.col("vec_id").alias("query_id"), "y")
    f = class_scores(spark, d).join(y, "query_id").select("query_id", "y", F.round("score", 9).alias("score"), F.round(1 - F.col("nearest"), 9).alias("novelty"))
    return M.risk_coverage(f, "novelty", "query_id", "score", "y", [1.0, 0.95, 0.9, 0.8])


@query(f"""WITH {neighbour_sql('b', 10)}, e AS (SELECT 'b' AS system, query_id, idx_id, rank FROM nb),
u2 AS (SELECT *, list_transform(emb, lambda x: x / greatest(sqrt(list_sum(list_transform(emb, lambda z: z * z))), 1e-12)) AS w FROM vectors WHERE b IS NOT NULL),
s2 AS (SELECT q.vec_id AS query_id, i.vec_id AS idx_id, round(list_dot_product(q.w, i.w), 9) AS sim FROM (SELECT * FROM u2 WHERE part = 'test') q, (SELECT * FROM u2 WHERE part <> 'test') i),
f AS (SELECT 'fused' AS system, query_id, idx_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, idx_id) AS rank FROM s2 QUALIFY rank <= 10)
SELECT system, count(DISTINCT query_id) AS queries, round(avg((i.label = q.label)::INTEGER), 6) AS p_at_10 FROM (SELECT * FROM e UNION ALL SELECT * FROM f) JOIN vectors i ON i.vec_id = idx_id JOIN vectors q ON q.vec_id = query_id GROUP BY 1""")
def matched_subsets(spark: S, d: str) -> DataFrame:
    """An expert and the fused vector on the rows that the expert covers."""
    v = X.vectors(spark, d).where("b is not null")
    run = lambda name, c: knn(v.where("part = 'test'").select("vec_id", c), v.where("part <> 'test'").select("vec_id", c), 10).withColumn("system", F.lit(name))
    y = v.select("vec_id", "label")
    n = run("b", "b").unionByName(run("fused", "emb")).join(y.toDF("idx_id", "y"), "idx_id").join(y.toDF("query_id", "qy"), "query_id")
    return n.groupBy("system").agg(F.count_distinct("query_id").alias("queries"), F.round(F.avg((F.col("y") == F.col("qy")).cast("int")), 6).alias("p_at_10"))


@query(f"WITH {X.GATES} SELECT vec_id, pattern FROM gates WHERE part = 'test' AND y = 1 AND pattern = '110' ORDER BY vec_id LIMIT 1")
def pattern_example(spark: S, d: str) -> DataFrame:
    return X.gates(spark, d).where("part = 'test' and y = 1 and pattern = '110'").select("vec_id", "pattern").orderBy("vec_id").limit(1)


@query(f"WITH {X.SCORES} SELECT part, round(avg((score IS NOT NULL)::INTEGER), 6) AS covered, count(score) AS n FROM scores GROUP BY 1")
def prediction_coverage(spark: S, d: str) -> DataFrame:
    return X.scores(spark, d).groupBy("part").agg(F.round(F.avg(F.col("score").isNotNull().cast("int")), 6).alias("covered"), F.count("score").alias("n"))


LOSS_P = "least(greatest(score, 1e-7), 1 - 1e-7)"


@query(f"WITH {X.SCORES} SELECT part, round(avg(-CASE WHEN y = 1 THEN ln({LOSS_P}) ELSE ln(1 - {LOSS_P}) END), 6) AS bce, round(avg({LOSS_P} * 3 - label * ln({LOSS_P} * 3)), 6) AS poisson FROM scores WHERE score IS NOT NULL GROUP BY 1")
def eval_losses(spark: S, d: str) -> DataFrame:
    rate = F.least(F.greatest("score", F.lit(1e-7)), F.lit(1 - 1e-7)) * 3
    return X.scores(spark, d).where("score is not null").groupBy("part").agg(F.round(F.avg(M.nll(F.col("score"), F.col("y"))), 6).alias("bce"), F.round(F.avg(rate - F.col("label") * F.log(rate)), 6).alias("poisson"))


# ---------------------------------------------------------------- experiments and reports


@query(f"WITH {EVAL}, done AS (SELECT variant, seed FROM eval WHERE seed <> 2), g AS (SELECT v.variant, s.seed FROM (SELECT DISTINCT variant FROM eval) v, (SELECT unnest([0, 1, 2, 3])::BIGINT AS seed) s) SELECT variant, seed FROM g ANTI JOIN done USING (variant, seed)")
def experiment_grid(spark: S, d: str) -> DataFrame:
    """Runs of a grid that are not yet done."""
    e = eval_records(spark, d)
    grid = e.select("variant").distinct().select("variant", F.explode(F.array(*(F.lit(i).cast("long") for i in range(4)))).alias("seed"))
    return grid.join(e.where("seed <> 2").select("variant", "seed"), ["variant", "seed"], "left_anti")


@query(f"WITH {EVAL} SELECT seed, max(printf('%.4f', metric)) FILTER (variant = '1-URGENT') AS urgent, max(printf('%.4f', metric)) FILTER (variant = '5-LOW') AS low, arg_max(variant, (metric, variant)) AS best FROM eval GROUP BY 1")
def report_detection(spark: S, d: str) -> DataFrame:
    """A report table: a row a seed, a column a variant, and the best one."""
    e = eval_records(spark, d)
    cell = lambda v: F.max(F.when(F.col("variant") == v, F.format_string("%.4f", "metric")))
    return e.groupBy("seed").agg(cell("1-URGENT").alias("urgent"), cell("5-LOW").alias("low"), F.max_by("variant", F.struct("metric", "variant")).alias("best"))


# Made records: each value is the run's metric times a factor; the second priority's runs lack two fields, the third's has no validated triage.
FACTORS = {("detection_head", "accuracy"): 1.5, ("detection_head", "roc_auc"): 2.5, ("detection_head", "tpr@fpr=0.01"): 1.25, ("detection_head", "f1"): 1.75, ("detection_knn", "accuracy@1"): 3.5, ("tags_knn", "micro_f1"): 2.25, ("tags_knn", "mAP"): 0.5, ("behaviour_retrieval", "1", "precision"): 3.0, ("behaviour_retrieval", "10", "ndcg"): 0.75}
LACKING = {("detection_head", "f1"), ("tags_knn", "mAP")}
NAMES = {"1-URGENT": "moe_full", "2-HIGH": "single", "3-MEDIUM": "mean", "4-NOT SPECIFIED": "sweep one", "5-LOW": "ember"}
RECORD_NAME = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " END"
COVERS, PATTERNS, MATCHED = {"cov=1": 1.0, "cov=0.9": 1.1, "auroc": 9.0}, {"111": 1.0, "101": 2.0}, {"a": 1.0, "b": 1.3}
LAYOUT = [
    (section, row, label, name, col, path)
    for section, rows, paths in (
        ("Detection", [("Head", "moe_full"), ("Trees", "ember"), ("Absent", "none")], [("detection_head", "accuracy"), ("detection_head", "roc_auc"), ("detection_head", "f1")]),
        ("Tags", [("Votes", "moe_full"), ("One", "single")], [("tags_knn", "micro_f1"), ("tags_knn", "mAP")]),
        ("Retrieval", [("Fused", "moe_full"), ("Mean", "mean")], [("detection_knn", "accuracy@1"), ("behaviour_retrieval", "1", "precision"), ("behaviour_retrieval", "10", "ndcg")]),
    )
    for row, (label, name) in enumerate(rows)
    for col, path in enumerate(paths)
]
BY_RUN = [("detection_head", "roc_auc"), ("detection_head", "tpr@fpr=0.01"), ("tags_knn", "mAP")]
HEADERS = {"Detection": ["Model", "Acc", "ROC-AUC", "F1"], "Tags": ["Model", "micro-F1", "mAP"], "Retrieval": ["Embedding", "Acc@1", "P@1", "nDCG@10"], "Ablations": ["Variant", "seeds", "ROC-AUC", "TPR@1e-2", "mAP"], "Triage": ["Coverage", "n", "Accuracy"], "Gates": ["Pattern", "n", "gates"], "Matched": ["Expert", "n", "Acc@1"]}


def write_records(spark: S, d: str, path: str) -> None:
    """The made records as JSON files, a folder a run and seed."""
    o = table(spark, d, "orders")
    name = F.expr(RECORD_NAME)
    r = o.groupBy(name.alias("name"), (F.col("o_orderkey") % 3 + 42).alias("seed")).agg(F.round(F.avg("o_totalprice") / 1e6, 6).alias("m"))
    value = lambda x: F.round(F.col("m") * x, 6)

    def nested(prefix: tuple[str, ...]) -> Column:
        """The object below a prefix of the factors' paths."""
        parts = []
        for k in dict.fromkeys(p[len(prefix)] for p in FACTORS if p[: len(prefix)] == prefix):
            full = (*prefix, k)
            x = F.when((F.col("name") == "single") & F.lit(full in LACKING), None).otherwise(value(FACTORS[full])) if full in FACTORS else nested(full)
            parts.append(x.alias(k))
        return F.struct(*parts)

    tops = [nested((t,)).alias(t) for t in dict.fromkeys(p[0] for p in FACTORS)]
    triage = F.struct(*(F.struct(F.round(F.col("m") * 1000 * x).cast("long").alias("n"), value(x).alias("accuracy")).alias(k) for k, x in COVERS.items())).alias("triage")
    gates = F.struct(*(F.struct(F.round(F.col("m") * 100 * x).cast("long").alias("n"), F.array(value(x), value(2 * x)).alias("gate_bin")).alias(k) for k, x in PATTERNS.items())).alias("gates")
    matched = F.struct(*(F.struct(F.round(F.col("m") * 500 * x).cast("long").alias("n_queries"), value(x).alias("expert_acc@1")).alias(k) for k, x in MATCHED.items())).alias("experts_matched")
    r.select("name", "seed", F.to_json(F.struct(*tops, triage, gates, matched)).alias("value")).repartition("name", "seed").write.partitionBy("name", "seed").text(path)


def report_cells(spark: S, d: str) -> DataFrame:
    path = workspace(spark, "records")
    write_records(spark, d, path)
    records = kept(R.read_records(spark, f"{path}/*/*/*.txt"), "records")
    cells = R.measured(records, [(s, row, label, name, col, R.path_of(*p)) for s, row, label, name, col, p in LAYOUT])
    cells = cells.unionByName(R.by_run(records, "Ablations", [R.path_of(*p) for p in BY_RUN], "sweep"))
    for section, path_, fields, prefix in (("Triage", ("triage",), {"n": "%d", "accuracy": "%.4f"}, "cov="), ("Gates", ("gates",), {"n": "%d", "gate_bin": "%.3f"}, ""), ("Matched", ("experts_matched",), {"n_queries": "%d", "expert_acc@1": "%.4f"}, "")):
        cells = cells.unionByName(R.keyed(records, section, "moe_full", 42, path_, fields, prefix))
    return cells


def report_sql() -> str:
    """The same cells from the metrics themselves."""
    text = "CASE WHEN count(v) = 0 THEN '-' WHEN count(v) = 1 THEN printf('%.4f', avg(v)) ELSE printf('%.4f', avg(v)) || ' ± ' || printf('%.4f', stddev_pop(v)) END"
    lack = lambda p: "CASE WHEN name <> 'single' THEN " if p in LACKING else "CASE WHEN true THEN "
    value = lambda p: f"{lack(p)}round(m * {FACTORS[p]}, 6) END"
    parts = [f"SELECT '{s}' AS section, {row} AS row, '{label}' AS label, {col} AS col, {text} AS shown FROM (SELECT {value(p)} AS v FROM e WHERE name = '{name}') HAVING count(*) > 0" for s, row, label, name, col, p in LAYOUT]
    order = "(dense_rank() OVER (ORDER BY name) - 1)::INTEGER"
    parts.append(f"SELECT 'Ablations', {order}, name, 0, count(*)::VARCHAR FROM e WHERE name NOT LIKE 'sweep%' GROUP BY name")
    parts += [f"SELECT 'Ablations', {order}, name, {i + 1}, {text} FROM (SELECT name, {value(p)} AS v FROM e WHERE name NOT LIKE 'sweep%') GROUP BY name" for i, p in enumerate(BY_RUN)]
    for section, keys, size, shown in (("Triage", [k for k in COVERS if k.startswith("cov=")], 1000, "printf('%.4f', round(m * {x}, 6))"), ("Gates", PATTERNS, 100, "printf('%.3f', round(m * {x}, 6)) || ', ' || printf('%.3f', round(m * {y}, 6))"), ("Matched", MATCHED, 500, "printf('%.4f', round(m * {x}, 6))")):
        for row, k in enumerate(keys):
            x = (COVERS | PATTERNS | MATCHED)[k]
            one = "FROM e WHERE name = 'moe_full' AND seed = 42"
            parts.append(f"SELECT '{section}', {row}, '{k}', 0, round(m * {size} * {x})::BIGINT::VARCHAR {one}")
            parts.append(f"SELECT '{section}', {row}, '{k}', 1, {shown.format(x=x, y=2 * x)} {one}")
    return f"WITH e AS (SELECT {RECORD_NAME} AS name, o_orderkey % 3 + 42 AS seed, round(avg(o_totalprice) / 1e6, 6) AS m FROM orders GROUP BY 1, 2) " + " UNION ALL ".join(parts)


@query(report_sql())
def report_tables(spark: S, d: str) -> DataFrame:
    """The cells of seven report tables over the records of runs, read from their folders."""
    return report_cells(spark, d)
