"""Queries: call graphs, models, streams."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import models as L
from ..sources.tables import kept, workspace
from ..streaming import chunks as T
from . import fixtures as X
from .corpus import fusable
from .registry import query, table

S = SparkSession
CATS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

GRAPH = f"""{X.CALL_EDGES}, {X.FUNCTIONS}, nodes AS (SELECT graph_id, node, (node NOT IN (SELECT node FROM functions))::INTEGER AS external FROM (SELECT graph_id, src AS node FROM call_edges UNION SELECT graph_id, dst FROM call_edges UNION SELECT graph_id, node FROM functions)),
edges AS (SELECT DISTINCT * FROM call_edges WHERE src <> dst), both_ways AS (SELECT graph_id, src, dst FROM edges UNION ALL SELECT graph_id, dst, src FROM edges), deg AS (SELECT graph_id, src AS node, count(*) AS d FROM both_ways GROUP BY ALL)"""


def graph(spark: S, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = X.functions_of(spark, d)
    return *G.build(kept(X.call_edges(spark, d), "calls"), f), f


@query(f"WITH {X.CALL_EDGES}, first AS (SELECT * FROM call_edges WHERE graph_id % 2 = 0), other AS (SELECT c_nationkey::BIGINT AS graph_id, 'c' || c_custkey AS src, 'o' || o_orderkey AS dst FROM customer LEFT JOIN orders ON c_custkey = o_custkey) SELECT * FROM first UNION ALL SELECT * FROM other WHERE dst IS NOT NULL AND graph_id NOT IN (SELECT graph_id FROM first)")
def call_edges(spark: S, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    other = c.join(o, c.c_custkey == o.o_custkey, "left").select(F.col("c_nationkey").cast("long").alias("graph_id"), F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    return G.with_fallback(X.call_edges(spark, d).where("graph_id % 2 = 0"), other)


@query(f"WITH {GRAPH} SELECT graph_id, count(*) AS n_nodes, sum(external)::BIGINT AS n_external, any_value(e) AS n_edges FROM nodes JOIN (SELECT graph_id, count(*) AS e FROM edges GROUP BY 1) USING (graph_id) GROUP BY 1")
def graph_build(spark: S, d: str) -> DataFrame:
    nodes, edges, _ = graph(spark, d)
    e = edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    return nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"), F.sum("external").cast("long").alias("n_external")).join(e, "graph_id")


@query(f"""WITH {GRAPH}, o AS (SELECT graph_id, src AS node, count(*) AS n FROM edges GROUP BY ALL), i AS (SELECT graph_id, dst AS node, count(*) AS n FROM edges GROUP BY ALL)
SELECT nodes.graph_id, nodes.node, round(ln(1 + coalesce(ninstr, 0)), 6) AS log_ninstr, round(ln(1 + coalesce(size, 0)), 6) AS log_size, {", ".join(f"coalesce((cat = '{c}')::INTEGER::DOUBLE, 0.0) AS cat_{i}" for i, c in enumerate(CATS))},
round(ln(1 + coalesce(i.n, 0)), 6) AS log_in_deg, round(ln(1 + coalesce(o.n, 0)), 6) AS log_out_deg, external FROM nodes LEFT JOIN functions f USING (graph_id, node) LEFT JOIN o USING (graph_id, node) LEFT JOIN i USING (graph_id, node)""")
def node_attributes(spark: S, d: str) -> DataFrame:
    nodes, edges, f = graph(spark, d)
    return G.attributes(nodes, edges, f, CATS)


PROFILE = GRAPH + """, prof AS (SELECT graph_id, node, coalesce(deg, 0) AS deg, coalesce(nb_min, 0) AS nb_min, coalesce(nb_max, 0) AS nb_max, coalesce(nb_mean, 0.0) AS nb_mean, coalesce(nb_std, 0.0) AS nb_std FROM nodes LEFT JOIN (
  SELECT b.graph_id, src AS node, count(*) AS deg, min(d) AS nb_min, max(d) AS nb_max, avg(d) AS nb_mean, sqrt(greatest(avg(d * d) - avg(d) * avg(d), 0)) AS nb_std FROM both_ways b JOIN deg ON deg.graph_id = b.graph_id AND deg.node = b.dst GROUP BY ALL) USING (graph_id, node))"""


@query(f"WITH {PROFILE} SELECT graph_id, node, deg, nb_min, nb_max, round(nb_mean, 6) AS nb_mean, round(nb_std, 4) AS nb_std FROM prof")
def degree_profile(spark: S, d: str) -> DataFrame:
    nodes, edges, _ = graph(spark, d)
    return G.degree_profile(nodes, edges).select("graph_id", "node", "deg", "nb_min", "nb_max", F.round("nb_mean", 6).alias("nb_mean"), F.round("nb_std", 4).alias("nb_std"))


@query(f"""WITH {PROFILE}, l AS (SELECT graph_id, unnest(['deg', 'nb_min', 'nb_max', 'nb_mean', 'nb_std']) AS stat, unnest([deg::DOUBLE, nb_min::DOUBLE, nb_max::DOUBLE, nb_mean, nb_std]) AS x FROM prof), n AS (SELECT graph_id, count(*) AS n FROM prof GROUP BY 1),
c AS (SELECT graph_id, stat, least(floor(ln(1 + x) / ln(10001) * 16), 15)::BIGINT AS bin, count(*) AS c FROM l WHERE ln(1 + x) <= ln(10001) GROUP BY ALL)
SELECT graph_id, stat, bin, round(coalesce(c, 0) / n, 6) AS share FROM (SELECT * FROM n, (SELECT unnest(['deg', 'nb_min', 'nb_max', 'nb_mean', 'nb_std']) AS stat), (SELECT unnest(range(16)) AS bin)) LEFT JOIN c USING (graph_id, stat, bin)""")
def ldp_histogram(spark: S, d: str) -> DataFrame:
    nodes, edges, _ = graph(spark, d)
    return G.profile_histogram(G.degree_profile(nodes, edges), ["deg", "nb_min", "nb_max", "nb_mean", "nb_std"])


@query(f"""WITH {GRAPH}, n AS (SELECT graph_id, count(*) AS n, avg(external) AS external FROM nodes GROUP BY 1), e AS (SELECT graph_id, count(*) AS e FROM edges GROUP BY 1), t AS (SELECT graph_id, max(d) AS top FROM deg GROUP BY 1), f AS (SELECT graph_id, avg(ln(1 + ninstr)) AS log_len, {", ".join(f"avg((cat = '{c}')::INTEGER) AS mix_{i}" for i, c in enumerate(CATS))} FROM functions GROUP BY 1)
SELECT graph_id, {", ".join(f"round(mix_{i}, 6) AS mix_{i}" for i in range(len(CATS)))}, round(ln(1 + n), 6) AS log_n, round(ln(1 + e), 6) AS log_e, round(e / greatest(n * (n - 1), 1), 6) AS density, round(external, 6) AS external, round(log_len, 6) AS log_len, round(top / n, 6) AS top_degree FROM n JOIN e USING (graph_id) JOIN t USING (graph_id) JOIN f USING (graph_id)""")
def graph_stats(spark: S, d: str) -> DataFrame:
    return G.statistics(*graph(spark, d), CATS)


@query(f"WITH {GRAPH}, keep AS (SELECT graph_id, node FROM deg QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY d DESC, node) <= 30) SELECT e.* FROM edges e SEMI JOIN keep a ON e.graph_id = a.graph_id AND e.src = a.node SEMI JOIN keep b ON e.graph_id = b.graph_id AND e.dst = b.node")
def topdegree_subgraph(spark: S, d: str) -> DataFrame:
    _, edges, _ = graph(spark, d)
    return G.top_degree(edges, 30).select("graph_id", "src", "dst")


def walk_sql(steps: int) -> str:
    """The graph and the numbered neighbours are made once; each step looks up one of them."""
    parts = ["""near AS MATERIALIZED (SELECT graph_id, src AS "at", dst AS "to", row_number() OVER (PARTITION BY graph_id, src ORDER BY dst) - 1 AS no, count(*) OVER (PARTITION BY graph_id, src) AS d FROM (SELECT DISTINCT * FROM both_ways)),
w0 AS MATERIALIZED (SELECT graph_id, "at" || '#' || k AS walk, "at", d, "at" AS path FROM (SELECT DISTINCT graph_id, "at", d FROM near), range(2) r(k))"""]
    for i in range(steps):
        parts.append(f"""s{i} AS MATERIALIZED (SELECT graph_id, walk, "at", path, ('0x' || left(sha256('3:' || graph_id || ':' || walk || ':{i}'), 8))::BIGINT % d AS no FROM w{i}),
w{i + 1} AS MATERIALIZED (SELECT s.graph_id, walk, n."to" AS "at", m.d, path || ' ' || n."to" AS path FROM s{i} s JOIN near n ON n.graph_id = s.graph_id AND n."at" = s."at" AND n.no = s.no JOIN near m ON m.graph_id = n.graph_id AND m."at" = n."to" AND m.no = 0)""")
    return ", ".join(parts)


@query(f"WITH {GRAPH.replace('both_ways AS (', 'both_ways AS MATERIALIZED (')}, {walk_sql(4)} SELECT graph_id, walk, path FROM w4")
def random_walks(spark: S, d: str) -> DataFrame:
    _, edges, _ = graph(spark, d)
    return G.random_walks(edges, 5, 2, "3").select("graph_id", "walk", F.array_join("path", " ").alias("path"))


@query()
def walk_embedding(spark: S, d: str) -> DataFrame:
    """Each graph's vector of length 1, and how many nodes it is the mean of."""
    _, edges, _ = graph(spark, d)
    return G.walk_embedding(edges).groupBy("graph_id").agg(F.count("*").alias("n"), F.first("graph_vector").alias("vector"))


MESSAGE = GRAPH + """, v AS (SELECT graph_id, node, ln(1 + coalesce(ninstr, 0)) AS x FROM nodes LEFT JOIN functions USING (graph_id, node)),
g AS (SELECT b.graph_id, b.src AS node, sum(x) AS s FROM both_ways b JOIN v ON v.graph_id = b.graph_id AND v.node = b.dst GROUP BY ALL), m AS (SELECT graph_id, node, 1.1 * x + coalesce(s, 0) AS x FROM v LEFT JOIN g USING (graph_id, node))"""


def passed(spark: S, d: str) -> DataFrame:
    nodes, edges, f = graph(spark, d)
    v = nodes.join(f, ["graph_id", "node"], "left").select("graph_id", "node", F.log1p(F.coalesce("ninstr", F.lit(0))).alias("x"))
    return G.message_pass(edges, v, 0.1)


@query(f"WITH {MESSAGE} SELECT graph_id, node, round(x, 6) AS x FROM m")
def message_pass(spark: S, d: str) -> DataFrame:
    return passed(spark, d).select("graph_id", "node", F.round("x", 6).alias("x"))


@query(f'WITH {MESSAGE} SELECT graph_id, round(avg(x), 6) AS mean, round(max(x), 6) AS "max" FROM m GROUP BY 1')
def graph_readout(spark: S, d: str) -> DataFrame:
    return G.readout(passed(spark, d)).select("graph_id", F.round("mean", 6).alias("mean"), F.round("max", 6).alias("max"))


FEATURES = ["log_ninstr", "log_size", *(f"cat_{i}" for i in range(len(CATS))), "log_in_deg", "log_out_deg", "external"]
NODE_CAP = 60


def sent_sql(most_nodes: int | None = None) -> str:
    """Vectors after one round, of each graph's first ``most_nodes`` nodes by name or of all."""
    return f"""{GRAPH}, o AS (SELECT graph_id, src AS node, count(*) AS n FROM edges GROUP BY ALL), i AS (SELECT graph_id, dst AS node, count(*) AS n FROM edges GROUP BY ALL),
attr AS (SELECT nodes.graph_id, nodes.node, [round(ln(1 + coalesce(ninstr, 0)), 6), round(ln(1 + coalesce(size, 0)), 6), {", ".join(f"coalesce((cat = '{c}')::INTEGER::DOUBLE, 0.0)" for c in CATS)}, round(ln(1 + coalesce(i.n, 0)), 6), round(ln(1 + coalesce(o.n, 0)), 6), external::DOUBLE] AS x{"" if most_nodes is None else """,
  row_number() OVER (PARTITION BY nodes.graph_id ORDER BY nodes.node) AS no"""} FROM nodes LEFT JOIN functions f USING (graph_id, node) LEFT JOIN o USING (graph_id, node) LEFT JOIN i USING (graph_id, node)),
flat AS (SELECT graph_id, node, unnest(x) AS x, unnest(range(len(x))) AS pos FROM attr{"" if most_nodes is None else f" WHERE no <= {most_nodes}"}),
st AS (SELECT pos, avg(x) AS m, stddev_pop(x) + 1e-6 AS s FROM flat WHERE graph_id % 10 < 7 GROUP BY 1),
sc AS (SELECT graph_id, node, pos, (x - m) / s AS x FROM flat JOIN st USING (pos)),
sg AS (SELECT b.graph_id, b.src AS node, pos, sum(x) AS s FROM both_ways b JOIN sc ON sc.graph_id = b.graph_id AND sc.node = b.dst GROUP BY ALL),
sent AS (SELECT graph_id, node, pos, 1.1 * x + coalesce(s, 0) AS x FROM sc LEFT JOIN sg USING (graph_id, node, pos))"""


def sent(spark: S, d: str, most_nodes: int | None = None) -> DataFrame:
    """Scaled vectors after one round, of each graph's first ``most_nodes`` nodes by name or of all."""
    nodes, edges, f = graph(spark, d)
    if most_nodes is None:
        near = kept(edges, "edges")
    else:
        nodes = kept(G.first_nodes(nodes, most_nodes), "first")
        near = kept(G.edges_at(edges, nodes), "near")
    x = kept(G.scaled_features(G.attributes(nodes, near, f, CATS), FEATURES, F.col("graph_id") % 10 < 7, most_nodes), "scaled")
    return G.message_pass_vectors(near, x, len(FEATURES), 0.1)


@query(f"WITH {sent_sql(NODE_CAP)} SELECT graph_id, node, pos::INTEGER AS pos, round(x, 5) AS x FROM sent")
def message_pass_vectors(spark: S, d: str) -> DataFrame:
    """Of each graph's first ``NODE_CAP`` nodes, as its SQL."""
    return sent(spark, d, NODE_CAP).select("graph_id", "node", F.posexplode("x").alias("pos", "x")).withColumn("x", F.round("x", 5))


@query(f'WITH {sent_sql()} SELECT graph_id, pos::INTEGER AS pos, round(avg(x), 5) AS mean, round(max(x), 5) AS "max" FROM sent GROUP BY 1, 2')
def graph_readout_vectors(spark: S, d: str) -> DataFrame:
    """Over all nodes of each graph."""
    r = G.readout_vectors(sent(spark, d), len(FEATURES))
    return r.select("graph_id", F.posexplode(F.arrays_zip("mean", "max")).alias("pos", "v")).select("graph_id", "pos", F.round("v.mean", 5).alias("mean"), F.round("v.max", 5).alias("max"))


# ---------------------------------------------------------------- models



@query()
def gbt_detector(spark: S, d: str) -> DataFrame:
    v = L.prepared(X.vectors(spark, d), "emb")
    model = L.boosted(v, "y", F.col("part") == "train", F.col("part") == "val")
    return M.roc_auc(L.predict(model, v.where("part = 'test'"), "y"), "score", "y")


@query()
def gbt_per_tag(spark: S, d: str) -> DataFrame:
    v = L.prepared(X.vectors(spark, d).where("y = 1"), "emb")
    out = None
    for tag, model in L.boosted_per_tag(v, "tags", ["t1", "t2", "t3"], F.col("part") == "train", F.col("part") == "val").items():
        p = L.predict(model, v.where("part = 'test'"), "tags").select(F.lit(tag).alias("tag"), F.array_contains("tags", tag).cast("int").alias("truth"), "score")
        out = p if out is None else out.unionByName(p)
    return M.multilabel(out, 0.5)


@query()
def mlp_detector(spark: S, d: str) -> DataFrame:
    v = L.prepared(X.vectors(spark, d), "emb")
    return M.roc_auc(L.predict(L.feed_forward(v, "y", F.col("part") == "train", [64, 16, 2]), v.where("part = 'test'"), "y"), "score", "y")


FOLDS = 5


@query()
def kfold_auc(spark: S, d: str) -> DataFrame:
    """Five folds' areas under the curve and their mean, of a label that the vectors tell but for some seeded noise."""
    noise = A.uniform("noise", F.col("vec_id")) < 0.1
    v = X.vectors(spark, d).select("vec_id", "emb", F.when(noise, F.col("emb")[1] < 0).otherwise(F.col("emb")[1] >= 0).cast("int").alias("told"), F.floor(A.uniform("k", F.col("vec_id")) * FOLDS).cast("long").alias("fold"))
    means = L.fold_means(L.cross_validated(L.prepared(v, "emb"), "told", "fold", FOLDS, [0.001, 0.1]))
    return means.select("fold", F.round("auc", 6).alias("auc"))


@query()
def fused_head(spark: S, d: str) -> DataFrame:
    from ..operators.vectors import fuse

    f = L.prepared(fusable(spark, d).withColumn("fused", fuse("gated", F.col("experts"), F.col("mask"), F.col("q"))), "fused")
    return M.roc_auc(L.predict(L.linear_head(f, "y", F.col("part") == "train"), f.where("part = 'test'"), "y"), "score", "y")


@query()
def dropout_sweep(spark: S, d: str) -> DataFrame:
    """Average precision on val for each rate of expert dropout in training."""
    from ..operators.corpus import expert_dropout
    from ..operators.vectors import fuse

    base, out = kept(fusable(spark, d).select("vec_id", "y", "part", "experts", "mask", "q"), "fusable"), None
    for p in (0.1, 0.3, 0.5):
        m = F.when(F.col("part") == "train", expert_dropout(F.col("mask"), F.col("vec_id"), p, "d")).otherwise(F.col("mask"))
        masked = base.withColumn("mask", m)
        # digests and fusion are worked out once for the fit's passes, not in each
        f = L.prepared(kept(kept(masked, "masked").select("y", "part", fuse("mean", F.col("experts"), F.col("mask"), F.col("q")).alias("fused")), "fused"), "fused")
        ap = M.average_precision(L.predict(L.linear_head(f, "y", F.col("part") == "train"), f.where("part = 'val'"), "y"), "score", "y").select(F.lit(p).alias("rate"), F.round("ap", 4).alias("ap"))
        out = ap if out is None else out.unionByName(ap)
    return out


# ---------------------------------------------------------------- streams


ROW = "sample_id long, first_seen timestamp, label int, detections long, grp string"


def stream_in(spark: S, d: str, where: str) -> str:
    """The samples as files of a folder, several a day."""
    path = f"{where}/in"
    X.samples(spark, d).select("sample_id", "first_seen", "label", F.col("detections").cast("long"), "grp").repartition(6, "sample_id").write.parquet(path)
    return path


@query(f"WITH {X.SAMPLES} SELECT sample_id, label, round(ln(1 + detections), 6) AS log_detections, sha256(sample_id::VARCHAR) AS digest FROM samples")
def stream_features(spark: S, d: str) -> DataFrame:
    w = workspace(spark, "features")
    T.drain(T.source(spark, stream_in(spark, d, w), ROW, 2), f"{w}/out", f"{w}/state", T.features)
    return T.read_drained(spark, f"{w}/out").select("sample_id", "label", "log_detections", "digest")


@query(f"WITH {X.SAMPLES} SELECT grp, count(*) AS n, round(sum(round(ln(1 + detections), 6)), 2) AS total FROM samples GROUP BY 1")
def stream_stage_b(spark: S, d: str) -> DataFrame:
    """A second stream reads what the first one has finished."""
    w = workspace(spark, "stages")
    T.drain(T.source(spark, stream_in(spark, d, w), ROW, 3), f"{w}/a", f"{w}/state-a", T.features)
    T.drain(T.source(spark, f"{w}/a/*", ROW + ", log_detections double, digest string", 2), f"{w}/b", f"{w}/state-b")
    return T.read_drained(spark, f"{w}/b").groupBy("grp").agg(F.count("*").alias("n"), F.round(F.sum("log_detections"), 2).alias("total"))


@query(f"WITH {X.CHUNKS}, g AS (SELECT chunk FROM chunks GROUP BY 1 HAVING NOT (count_if(ok_pe) > 0 AND count_if(ok_ember) < 0.8 * count_if(ok_pe))) SELECT chunk, count(*) AS n FROM chunks SEMI JOIN g USING (chunk) GROUP BY 1")
def stream_gate(spark: S, d: str) -> DataFrame:
    """Chunks arrive whole, a file each, and pass the gate in their micro-batch."""
    w = workspace(spark, "gate")
    X.chunks(spark, d).repartition(4, "chunk").write.parquet(f"{w}/in")
    T.drain(T.source(spark, f"{w}/in", "o_orderkey long, chunk long, ok_pe boolean, ok_ember boolean, secs double", 1), f"{w}/out", f"{w}/state", lambda b: T.gate(b, 0.8))
    return T.read_drained(spark, f"{w}/out").groupBy("chunk").agg(F.count("*").alias("n"))


@query(f"""WITH {X.CHUNKS}, c AS (SELECT chunk, count(*) AS n, count_if(ok_pe) AS p, count_if(ok_ember) AS e, sum(secs) AS s FROM chunks GROUP BY 1)
SELECT count(*) AS chunks, count(*) AS done, count_if(NOT (p > 0 AND e < 0.8 * p))::BIGINT AS passed, sum(n)::BIGINT AS rows, round(sum(s), 4) AS secs FROM c""")
def stream_gate_progress(spark: S, d: str) -> DataFrame:
    """The last state of a stream whose chunks come in pieces over several micro-batches."""
    w = workspace(spark, "progress")
    chunks = X.chunks(spark, d)
    chunks.repartition(6, "o_orderkey").write.parquet(f"{w}/in")
    sizes = chunks.groupBy("chunk").agg(F.count("*").alias("size"))
    T.gate_with_progress(T.source(spark, f"{w}/in", "o_orderkey long, chunk long, ok_pe boolean, ok_ember boolean, secs double", 1), sizes, 0.8, f"{w}/out", f"{w}/state")
    last = T.progress(T.updates(spark, f"{w}/out")).orderBy(F.col("batch").desc()).limit(1)
    return last.select("chunks", "done", "passed", "rows", F.round("secs", 4).alias("secs"))


@query(f"WITH {X.SAMPLES} SELECT DISTINCT grp FROM samples")
def stream_dedup(spark: S, d: str) -> DataFrame:
    w = workspace(spark, "dedup")
    T.drain(T.first_seen(T.source(spark, stream_in(spark, d, w), ROW, 3), "grp", "first_seen", "400 days").select("grp"), f"{w}/out", f"{w}/state")
    return T.read_drained(spark, f"{w}/out")
