"""Stand-in tables for a labelled corpus, derived from the benchmark tables, with the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import doubles, sigmoid
from .registry import table

TAG_OF_LABEL = {0: ["t1"], 1: ["t1", "t2"], 2: ["t2", "t3"], 3: ["t3"]}


def samples(spark: SparkSession, d: str) -> DataFrame:
    """One row a user and day: the sample manifest."""
    e = table(spark, d, "events")
    error = F.max((F.col("event_type") == "error").cast("int"))
    other = F.array_sort(F.collect_set(F.when(F.col("event_type") != "error", F.col("event_type"))))
    g = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("first_seen"), error.alias("label"), other.alias("kinds"), F.count("*").alias("detections"))
    return g.select(
        (F.col("user_id") * 1000 + F.dayofyear("day")).alias("sample_id"),
        "first_seen",
        "day",
        "label",
        F.when(F.col("label") == 1, F.col("kinds")).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.concat(F.lit("u"), F.col("user_id")).alias("grp"),
        F.concat(F.lit("src"), F.col("user_id") % 4).alias("source"),
        "detections",
    )


SAMPLES = """samples AS (
  SELECT user_id * 1000 + dayofyear(day) AS sample_id, first_seen, day, label,
         CASE WHEN label = 1 THEN kinds ELSE [] END AS tags, 'u' || user_id AS grp, 'src' || (user_id % 4) AS source, detections
  FROM (SELECT user_id, ts::DATE AS day, min(ts) AS first_seen, max((event_type = 'error')::INTEGER) AS label,
               coalesce(list_sort(list_distinct(list(event_type) FILTER (event_type <> 'error'))), []) AS kinds, count(*) AS detections
        FROM events GROUP BY 1, 2))"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Three partial embeddings of each item, its tags and its part."""
    e = table(spark, d, "embeddings")
    v, i = doubles(F.col("embedding")), F.col("vec_id")
    tags = F.array().cast("array<string>")
    for k, names in TAG_OF_LABEL.items():
        tags = F.when(F.col("label") == k, F.array(*map(F.lit, names))).otherwise(tags)
    return e.select(
        i,
        F.col("label").cast("long").alias("label"),
        (F.col("label") < 4).cast("int").alias("y"),
        v.alias("emb"),
        tags.alias("tags"),
        F.when(i % 50 != 0, F.slice(v, 1, 32)).alias("a"),
        F.when(i % 5 != 0, F.slice(v, 33, 32)).alias("b"),
        F.when(i % 3 != 0, F.slice(v, 1, 16)).alias("c"),
        F.when(i % 20 < 14, "train").when(i % 20 < 17, "val").otherwise("test").alias("part"),
    )


VECTORS = """vectors AS (
  SELECT vec_id, label::BIGINT AS label, (label < 4)::INTEGER AS y, embedding::DOUBLE[] AS emb,
         CASE label WHEN 0 THEN ['t1'] WHEN 1 THEN ['t1', 't2'] WHEN 2 THEN ['t2', 't3'] WHEN 3 THEN ['t3'] ELSE [] END AS tags,
         CASE WHEN vec_id % 50 <> 0 THEN embedding[1:32]::DOUBLE[] END AS a,
         CASE WHEN vec_id % 5 <> 0 THEN embedding[33:64]::DOUBLE[] END AS b,
         CASE WHEN vec_id % 3 <> 0 THEN embedding[1:16]::DOUBLE[] END AS c,
         CASE WHEN vec_id % 20 < 14 THEN 'train' WHEN vec_id % 20 < 17 THEN 'val' ELSE 'test' END AS part
  FROM embeddings)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with ties; null where embedding b is lacking."""
    s = F.round(sigmoid(8 * F.col("emb")[0]), 3)
    return vectors(spark, d).select("vec_id", "label", "y", "part", "tags", F.when(F.col("b").isNotNull(), s).alias("score"))


SCORES = VECTORS + """, scores AS (
  SELECT vec_id, label, y, part, tags, CASE WHEN b IS NOT NULL THEN round(1 / (1 + exp(-(8 * emb[1]))), 3) END AS score FROM vectors)"""


def gates(spark: SparkSession, d: str) -> DataFrame:
    """Gate logits and availability of the three embeddings."""
    z = F.array(*(F.round(F.col("emb")[k] * 10, 4) for k in range(3)))
    m = F.array(*(F.col(c).isNotNull().cast("double") for c in "abc"))
    return vectors(spark, d).select("vec_id", "y", "part", "label", z.alias("z"), m.alias("mask"), F.concat(*(F.col(c).isNotNull().cast("int").cast("string") for c in "abc")).alias("pattern"))


GATES = VECTORS + """, gates AS (
  SELECT vec_id, y, part, label, [round(emb[1] * 10, 4), round(emb[2] * 10, 4), round(emb[3] * 10, 4)] AS z,
         [(a IS NOT NULL)::INTEGER::DOUBLE, (b IS NOT NULL)::INTEGER::DOUBLE, (c IS NOT NULL)::INTEGER::DOUBLE] AS mask,
         (a IS NOT NULL)::INTEGER::VARCHAR || (b IS NOT NULL)::INTEGER::VARCHAR || (c IS NOT NULL)::INTEGER::VARCHAR AS pattern
  FROM vectors)"""

#: Softmax of the squashed logits, and the same over what is available.
GATE_P = GATES + """, gate_e AS (
  SELECT *, list_transform(z, lambda x: exp((exp(2 * x / 5) - 1) / (exp(2 * x / 5) + 1) * 5)) AS e FROM gates),
gate_p AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM gate_e),
gate_m AS (SELECT *, [p[1] * mask[1], p[2] * mask[2], p[3] * mask[3]] AS pm FROM gate_p),
gate_q AS (SELECT *, list_transform(pm, lambda x: x / greatest(list_sum(pm), 1e-9)) AS q FROM gate_m)"""


def tag_scores(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, tag, truth, score, part) of the tagged positives."""
    names = F.array(*(F.struct(F.lit(f"t{k}").alias("tag"), F.round(sigmoid(8 * F.col("emb")[k]), 3).alias("score")) for k in (1, 2, 3)))
    v = vectors(spark, d).where((F.col("y") == 1) & (F.size("tags") > 0)).select("vec_id", "part", "tags", F.explode(names).alias("t"))
    return v.select("vec_id", "part", F.col("t.tag").alias("tag"), F.array_contains("tags", F.col("t.tag")).cast("int").alias("truth"), F.col("t.score").alias("score"))


TAG_SCORES = VECTORS + """, tag_scores AS (
  SELECT vec_id, part, 't' || k AS tag, list_contains(tags, 't' || k)::INTEGER AS truth, round(1 / (1 + exp(-(8 * emb[k + 1]))), 3) AS score
  FROM vectors, range(1, 4) r(k) WHERE y = 1 AND len(tags) > 0)"""


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    """(graph_id, src, dst): customers call the suppliers of their orders; some call themselves."""
    c, o, li = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    src = F.concat(F.lit("c"), F.col("c_custkey"))
    used = c.join(o, c.c_custkey == o.o_custkey).join(li, o.o_orderkey == li.l_orderkey).select(F.col("c_nationkey").cast("long").alias("graph_id"), src.alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst")).distinct()
    own = c.where("c_custkey % 97 = 0").select(F.col("c_nationkey").cast("long").alias("graph_id"), src.alias("src"), src.alias("dst"))
    return used.unionByName(own)


CALL_EDGES = """call_edges AS (
  SELECT DISTINCT c_nationkey::BIGINT AS graph_id, 'c' || c_custkey AS src, 's' || l_suppkey AS dst
  FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
  UNION ALL SELECT c_nationkey::BIGINT, 'c' || c_custkey, 'c' || c_custkey FROM customer WHERE c_custkey % 97 = 0)"""


def functions_of(spark: SparkSession, d: str) -> DataFrame:
    """(graph_id, node, ninstr, size, cat): the internal nodes."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("ninstr"))
    return c.join(n, c.c_custkey == n.o_custkey, "left").select(F.col("c_nationkey").cast("long").alias("graph_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.coalesce("ninstr", F.lit(0)).cast("long").alias("ninstr"), F.floor(F.abs("c_acctbal")).cast("long").alias("size"), F.col("c_mktsegment").alias("cat"))


FUNCTIONS = """functions AS (
  SELECT c_nationkey::BIGINT AS graph_id, 'c' || c_custkey AS node, coalesce(n, 0)::BIGINT AS ninstr, floor(abs(c_acctbal))::BIGINT AS size, c_mktsegment AS cat
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""


def chunks(spark: SparkSession, d: str, size: int = 500) -> DataFrame:
    """Orders dealt to chunks by seeded hash, with the flags of a work ledger."""
    from ..sources.manifest import numbered

    o = numbered(table(spark, d, "orders"), "42", "o_orderkey", "rn")
    return o.select("o_orderkey", F.floor(F.col("rn") / size).cast("long").alias("chunk"), (F.col("o_orderstatus") != "P").alias("ok_pe"), ((F.col("o_orderstatus") != "P") & (F.col("o_orderpriority") != "5-LOW")).alias("ok_ember"), (F.col("o_totalprice") / 1e4).alias("secs"))


CHUNKS = """chunks AS (
  SELECT o_orderkey, ((row_number() OVER (ORDER BY sha256('42:' || o_orderkey), o_orderkey) - 1) // 500)::BIGINT AS chunk,
         o_orderstatus <> 'P' AS ok_pe, o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AS ok_ember, o_totalprice / 1e4 AS secs
  FROM orders)"""
