"""Queries: dedup, sampling, splits, aggregations, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import account as G
from ..operators import joins as J
from ..operators import split as P
from ..operators import windows as W
from . import corpus as Q
from . import fixtures as X
from .registry import query, table

S = SparkSession
SPLIT = {"train": 0.7, "val": 0.15, "test": 0.15}


def u_sql(seed: str, key: str) -> str:
    return f"('0x' || left(sha256('{seed}:' || {key}), 12))::BIGINT / 281474976710656.0"


@query(f"WITH {X.SAMPLES} SELECT grp, arg_max(sample_id, (label, -sample_id)) AS sample_id, max(label) AS label FROM samples GROUP BY 1")
def dedup_prefer(spark: S, d: str) -> DataFrame:
    return J.first_per_key(X.samples(spark, d), ["grp"], F.col("label").desc(), "sample_id").select("grp", "sample_id", "label")


@query(f"WITH {X.SAMPLES} SELECT sample_id, grp FROM samples QUALIFY row_number() OVER (PARTITION BY grp ORDER BY sha256('42:' || sample_id), sample_id) <= 20")
def group_cap(spark: S, d: str) -> DataFrame:
    return P.group_cap(X.samples(spark, d), "grp", "sample_id", 20, "42").select("sample_id", "grp")


@query(f"""WITH {X.SAMPLES}, n AS (SELECT source, count(*) AS n FROM samples GROUP BY 1), t AS (SELECT count(*) AS t FROM samples),
q AS (SELECT source, CASE WHEN t <= 500 THEN n ELSE greatest(1, round_even(500 * n / t, 0)) END AS quota FROM n, t)
SELECT sample_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || sample_id), sample_id) AS rn FROM samples) JOIN q USING (source) WHERE rn <= quota""")
def proportional_sample(spark: S, d: str) -> DataFrame:
    return P.proportional_sample(X.samples(spark, d), "source", "sample_id", 500, "42").select("sample_id", "source")


def quota_sql(tags: int, least: int, budget: int) -> str:
    """One step a tag, rarest first, then the budget."""
    steps = [f"""WITH {X.SAMPLES}, q0 AS (SELECT sample_id, tags, CASE WHEN first_seen < TIMESTAMP '2024-01-15' THEN 'train' WHEN first_seen < TIMESTAMP '2024-01-22' THEN 'val' ELSE 'test' END AS part,
  sample_id % 1000 = 7 AS picked, sha256('42:' || sample_id) AS o FROM samples WHERE label = 1),
names AS (SELECT tag, row_number() OVER (ORDER BY count(*), tag) AS k FROM (SELECT unnest(tags) AS tag FROM q0) GROUP BY 1)"""]
    for k in range(1, tags + 1):
        steps.append(f"""h{k} AS (SELECT q.*, list_contains(tags, tag) AS has FROM q{k - 1} q, (SELECT tag FROM names WHERE k = {k})),
r{k} AS (SELECT *, count_if(has AND picked) OVER (PARTITION BY part) AS have, row_number() OVER (PARTITION BY part, picked, has ORDER BY o, sample_id) AS rn FROM h{k}),
q{k} AS (SELECT sample_id, tags, part, picked OR (has AND NOT picked AND rn <= {least} - have) AS picked, o FROM r{k})""")
    steps.append(f"last AS (SELECT *, count_if(picked) OVER (PARTITION BY part) AS have, row_number() OVER (PARTITION BY part, picked ORDER BY o, sample_id) AS rn FROM q{tags})")
    return ", ".join(steps) + f" SELECT sample_id, part, array_to_string(tags, ',') AS tags FROM last WHERE picked OR rn <= {budget} - have"


@query(quota_sql(4, 40, 150))
def quota_sample(spark: S, d: str) -> DataFrame:
    """One order of tags for all parts, and the same quota and budget for each."""
    s = X.samples(spark, d).where("label = 1").withColumn("part", P.temporal_split(F.col("first_seen"), "2024-01-15", "2024-01-22"))
    return P.quota_sample(s, "sample_id", "tags", "part", 40, 150, "42", F.col("sample_id") % 1000 == 7, by_part=False).select("sample_id", "part", F.array_join("tags", ",").alias("tags"))


def part_quota_sql(tags: int, least: int, budget: int) -> str:
    """One step a rank of rarity within the part, then the budget."""
    steps = [f"""WITH {X.SAMPLES}, q0 AS (SELECT sample_id, tags, CASE WHEN first_seen < TIMESTAMP '2024-01-15' THEN 'train' WHEN first_seen < TIMESTAMP '2024-01-22' THEN 'val' ELSE 'test' END AS part,
  sample_id % 1000 = 7 AS picked, sha256('42:' || sample_id) AS o FROM samples WHERE label = 1),
shares(part, share) AS (VALUES ('train', 0.7), ('val', 0.15), ('test', 0.15)),
every AS (SELECT p.part, t.tag FROM (SELECT DISTINCT part FROM q0) p, (SELECT DISTINCT unnest(tags) AS tag FROM q0) t),
names AS (SELECT part, tag, row_number() OVER (PARTITION BY part ORDER BY count(sample_id), tag) AS k FROM every LEFT JOIN (SELECT part, sample_id, unnest(tags) AS tag FROM q0) USING (part, tag) GROUP BY 1, 2)"""]
    for k in range(1, tags + 1):
        steps.append(f"""h{k} AS (SELECT q.*, list_contains(tags, tag) AS has FROM q{k - 1} q JOIN names n ON n.part = q.part AND n.k = {k}),
r{k} AS (SELECT *, count_if(has AND picked) OVER (PARTITION BY part) AS have, row_number() OVER (PARTITION BY part, picked, has ORDER BY o, sample_id) AS rn FROM h{k}),
q{k} AS (SELECT sample_id, tags, part, picked OR (has AND NOT picked AND rn <= round_even({least} * share, 0) - have) AS picked, o FROM r{k} JOIN shares USING (part))""")
    steps.append(f"last AS (SELECT *, count_if(picked) OVER (PARTITION BY part) AS have, row_number() OVER (PARTITION BY part, picked ORDER BY o, sample_id) AS rn FROM q{tags})")
    return ", ".join(steps) + f" SELECT sample_id, part, array_to_string(tags, ',') AS tags FROM last JOIN shares USING (part) WHERE picked OR rn <= round_even({budget} * share, 0) - have"


@query(part_quota_sql(4, 90, 400))
def quota_sample_by_part(spark: S, d: str) -> DataFrame:
    """Rarity by part; quota and budget in proportion to the part's share."""
    s = X.samples(spark, d).where("label = 1").withColumn("part", P.temporal_split(F.col("first_seen"), "2024-01-15", "2024-01-22"))
    return P.quota_sample(s, "sample_id", "tags", "part", 90, 400, "42", F.col("sample_id") % 1000 == 7, SPLIT).select("sample_id", "part", F.array_join("tags", ",").alias("tags"))


SPLIT_SQL = f"CASE WHEN {u_sql('42', 'grp')} < 0.7 THEN 'train' WHEN {u_sql('42', 'grp')} < 0.7 + 0.15 THEN 'val' ELSE 'test' END"


@query(f"WITH {X.SAMPLES} SELECT sample_id, grp, {SPLIT_SQL} AS part FROM samples")
def group_split(spark: S, d: str) -> DataFrame:
    return X.samples(spark, d).select("sample_id", "grp", P.group_split(F.col("grp"), SPLIT, "42").alias("part"))


@query("SELECT c_custkey, round((c_acctbal - m) / s, 6) AS c_acctbal FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) + 1e-6 AS s FROM customer WHERE c_custkey % 10 < 7)")
def standardise_scalar(spark: S, d: str) -> DataFrame:
    out = P.standardise(table(spark, d, "customer").select("c_custkey", "c_acctbal"), F.col("c_custkey") % 10 < 7, "c_acctbal")
    return out.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query(f"""WITH {X.VECTORS}, st AS (SELECT avg(a[1]) AS m1, stddev_pop(a[1]) + 1e-6 AS s1, avg(a[32]) AS m2, stddev_pop(a[32]) + 1e-6 AS s2 FROM vectors WHERE part = 'train' AND a IS NOT NULL)
SELECT vec_id, round((a[1] - m1) / s1, 6) AS first, round((a[32] - m2) / s2, 6) AS last FROM vectors, st""")
def standardise_vector(spark: S, d: str) -> DataFrame:
    v = P.standardise_vectors(X.vectors(spark, d).select("vec_id", "a", "part"), F.col("part") == "train", "a")
    return v.select("vec_id", F.round(F.col("a")[0], 6).alias("first"), F.round(F.col("a")[31], 6).alias("last"))


@query(f"WITH {X.SAMPLES} SELECT sample_id, CASE WHEN first_seen < TIMESTAMP '2024-01-15' THEN 'train' WHEN first_seen < TIMESTAMP '2024-01-22' THEN 'val' ELSE 'test' END AS part FROM samples")
def temporal_split(spark: S, d: str) -> DataFrame:
    return X.samples(spark, d).select("sample_id", P.temporal_split(F.col("first_seen"), "2024-01-15", "2024-01-22").alias("part"))


STRAT = f"""WITH {X.SAMPLES}, r AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || sample_id), sample_id) AS rn, floor(count(*) OVER (PARTITION BY label) * 0.15) AS n FROM samples)"""


@query(STRAT + " SELECT sample_id, label, CASE WHEN rn <= n THEN 'test' WHEN rn <= 2 * n THEN 'val' ELSE 'train' END AS part FROM r")
def stratified_split(spark: S, d: str) -> DataFrame:
    return P.stratified_split(X.samples(spark, d).select("sample_id", "label"), "label", "sample_id", 0.15, "42")


@query(f"WITH {X.SAMPLES}, s AS (SELECT grp, CASE WHEN first_seen < TIMESTAMP '2024-01-15' THEN 'train' ELSE 'test' END AS part FROM samples) SELECT grp, count(DISTINCT part) AS n_parts FROM s GROUP BY 1 HAVING count(DISTINCT part) > 1")
def leakage_check(spark: S, d: str) -> DataFrame:
    s = X.samples(spark, d).withColumn("part", F.when(F.col("first_seen") < F.lit("2024-01-15").cast("timestamp"), "train").otherwise("test"))
    return P.leaks(s, "grp", "part")


@query("""WITH b AS (SELECT left(sha256(o_orderkey::VARCHAR), 3) AS block, sha256(string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey::VARCHAR)) AS h FROM orders GROUP BY 1)
SELECT sha256(string_agg(h, chr(10) ORDER BY block)) AS fingerprint FROM b""")
def fingerprint(spark: S, d: str) -> DataFrame:
    return P.ordered_fingerprint(table(spark, d, "orders"), "o_orderkey")


@query()
def fingerprint_unordered(spark: S, d: str) -> DataFrame:
    return P.fingerprint(table(spark, d, "orders"), "o_orderkey")


@query(f"SELECT doc_id FROM documents WHERE {u_sql('9', 'doc_id')} < 0.4")
def bernoulli_keep(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").where(A.uniform("9", F.col("doc_id")) < 0.4)


@query(f"""WITH {X.SAMPLES}, t AS (SELECT sample_id, unnest(tags) AS tag FROM samples), f AS (SELECT tag, count(*) AS n FROM t GROUP BY 1),
raw AS (SELECT sample_id, avg(1 / n) AS w FROM t JOIN f USING (tag) GROUP BY 1), r AS (SELECT s.sample_id, label, CASE WHEN label = 0 THEN 1.0 ELSE coalesce(w, 0.1) END::DOUBLE AS w FROM samples s LEFT JOIN raw USING (sample_id)),
z AS (SELECT sum(w) FILTER (label = 0) AS neg, sum(w) FILTER (label = 1) AS pos FROM r) SELECT sample_id, label, round(CASE WHEN label = 1 THEN w * neg / pos ELSE w END, 6) AS weight FROM r, z""")
def sampler_weights(spark: S, d: str) -> DataFrame:
    return P.sampler_weights(X.samples(spark, d), "sample_id", "label", "tags").select("sample_id", "label", F.round("weight", 6).alias("weight"))


WEIGHTS = f"""{X.SAMPLES}, t AS (SELECT sample_id, unnest(tags) AS tag FROM samples), f AS (SELECT tag, count(*) AS n FROM t GROUP BY 1),
raw AS (SELECT sample_id, avg(1 / n) AS w FROM t JOIN f USING (tag) GROUP BY 1), r AS (SELECT s.sample_id, label, CASE WHEN label = 0 THEN 1.0 ELSE coalesce(w, 0.1) END::DOUBLE AS w FROM samples s LEFT JOIN raw USING (sample_id)),
z AS (SELECT sum(w) FILTER (label = 0) AS neg, sum(w) FILTER (label = 1) AS pos FROM r),
weights AS (SELECT sample_id, round(CASE WHEN label = 1 THEN w * neg / pos ELSE w END, 6) AS weight FROM r, z)"""


@query(f"""WITH {WEIGHTS}, units AS (SELECT sample_id, round_even(weight / 1e-6, 0)::BIGINT AS u FROM weights),
line AS (SELECT sample_id, u, sum(u) OVER (ORDER BY sample_id) AS stop FROM units WHERE u > 0),
draws AS (SELECT floor({u_sql('5', 'i')} * (SELECT sum(u) FROM line))::BIGINT AS place FROM range(2000) r(i))
SELECT sample_id, count(*) AS copies FROM line JOIN draws ON place >= stop - u AND place < stop GROUP BY 1""")
def weighted_resample(spark: S, d: str) -> DataFrame:
    w = P.sampler_weights(X.samples(spark, d), "sample_id", "label", "tags").withColumn("weight", F.round("weight", 6))
    return P.weighted_resample(w, "sample_id", "weight", 2000, "5").select("sample_id", "copies")


@query("""WITH r AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 32 AS block FROM documents)
SELECT block::BIGINT AS block, count(*) AS n, max(n_chars) AS padded, sha256('3:' || block) AS "order" FROM r GROUP BY block""")
def size_batches(spark: S, d: str) -> DataFrame:
    return P.size_batches(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 32, "3")


@query("""WITH v AS (SELECT p_brand AS package, (p_size % 12)::VARCHAR || '.' || (p_partkey % 30)::VARCHAR || CASE WHEN p_partkey % 4 = 0 THEN '-rc' ELSE '' END AS version, p_partkey FROM part),
k AS (SELECT *, array_to_string(list_transform(regexp_split_to_array(version, '[.+-]'), lambda c: CASE WHEN regexp_matches(c, '^[0-9]+$') THEN '0' || lpad(c, 12, '0') ELSE '1' || c END), '.') AS key FROM v)
SELECT package, version, p_partkey FROM k QUALIFY row_number() OVER (PARTITION BY package ORDER BY key DESC, p_partkey) = 1""")
def latest_version(spark: S, d: str) -> DataFrame:
    v = F.concat((F.col("p_size") % 12).cast("string"), F.lit("."), (F.col("p_partkey") % 30).cast("string"), F.when(F.col("p_partkey") % 4 == 0, "-rc").otherwise(""))
    p = table(spark, d, "part").select(F.col("p_brand").alias("package"), v.alias("version"), "p_partkey")
    return J.first_per_key(p, ["package"], P.version_key(F.col("version")).desc(), "p_partkey")


@query(f"WITH {X.VECTORS}, f AS (SELECT y, emb[1] AS x, floor({u_sql('k', 'vec_id')} * 5)::BIGINT AS fold FROM vectors) SELECT fold, count(*) AS n, round(avg(y), 6) AS rate FROM f GROUP BY 1")
def kfold_assign(spark: S, d: str) -> DataFrame:
    v = X.vectors(spark, d).withColumn("fold", F.floor(A.uniform("k", F.col("vec_id")) * 5).cast("long"))
    return v.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("rate"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2) SELECT * FROM o ORDER BY o_orderkey LIMIT 300""")
def capped_take(spark: S, d: str) -> DataFrame:
    o = W.first_n(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 2, "o_orderkey")
    return o.orderBy("o_orderkey").limit(300)


# ---------------------------------------------------------------- aggregations


@query(f"""WITH {X.SAMPLES}, s AS (SELECT label, source, {SPLIT_SQL} AS part FROM samples)
SELECT label, source, count_if(part = 'train')::BIGINT AS train, count_if(part = 'val')::BIGINT AS val, count_if(part = 'test')::BIGINT AS test FROM s GROUP BY ALL""")
def class_part_crosstab(spark: S, d: str) -> DataFrame:
    s = X.samples(spark, d).withColumn("part", P.group_split(F.col("grp"), SPLIT, "42"))
    return s.groupBy("label", "source").pivot("part", list(SPLIT)).count().na.fill(0)


@query(f"""WITH {X.VECTORS}, l AS (SELECT y, part, unnest(['a', 'b', 'c']) AS expert, unnest([a IS NOT NULL, b IS NOT NULL, c IS NOT NULL]) AS m FROM vectors)
SELECT expert, round(avg(m::INTEGER), 6) AS "all", round(avg(m::INTEGER) FILTER (y = 1), 6) AS pos, round(avg(m::INTEGER) FILTER (y = 0), 6) AS neg, round(avg(m::INTEGER) FILTER (part = 'test'), 6) AS test FROM l GROUP BY 1""")
def coverage_table(spark: S, d: str) -> DataFrame:
    return G.coverage(X.vectors(spark, d), ["a", "b", "c"], {"all": F.lit(True), "pos": F.col("y") == 1, "neg": F.col("y") == 0, "test": F.col("part") == "test"})


@query(f"WITH {X.CHUNKS} SELECT chunk, count(*) AS n, round(avg(ok_pe::INTEGER), 6) AS pe_rate, round(avg(ok_ember::INTEGER), 6) AS ember_rate, round(avg(secs), 6) AS secs, round(avg(secs) FILTER (ok_pe), 6) AS secs_ok FROM chunks GROUP BY 1")
def chunk_summary(spark: S, d: str) -> DataFrame:
    return X.chunks(spark, d).groupBy("chunk").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ok_pe").cast("int")), 6).alias("pe_rate"), F.round(F.avg(F.col("ok_ember").cast("int")), 6).alias("ember_rate"), F.round(F.avg("secs"), 6).alias("secs"), F.round(F.avg(F.when(F.col("ok_pe"), F.col("secs"))), 6).alias("secs_ok"))


@query(f"WITH {X.CHUNKS}, g AS (SELECT chunk FROM chunks GROUP BY 1 HAVING NOT (count_if(ok_pe) > 0 AND count_if(ok_ember) < 0.8 * count_if(ok_pe))) SELECT chunk, o_orderkey FROM chunks WHERE chunk IN (SELECT chunk FROM g)")
def chunk_gate(spark: S, d: str) -> DataFrame:
    return G.gate_chunks(X.chunks(spark, d), 0.8).select("chunk", "o_orderkey")


@query(f"""WITH {X.CHUNKS} SELECT count(DISTINCT chunk) AS total, count(DISTINCT chunk) FILTER (chunk % 3 = 0) AS done, count(DISTINCT chunk) FILTER (chunk % 3 <> 0) AS left_,
round(count(DISTINCT chunk) FILTER (chunk % 3 <> 0) * 500 * avg(secs) FILTER (chunk % 3 = 0) / 3600, 6) AS cpu_hours FROM chunks""")
def progress_eta(spark: S, d: str) -> DataFrame:
    return G.progress(X.chunks(spark, d), F.col("chunk") % 3 == 0, 500)


@query(f"WITH {X.SAMPLES}, p AS (SELECT * FROM samples WHERE label = 1), t AS (SELECT unnest(tags) AS tag FROM p) SELECT tag, count(*) AS n, round(count(*) / (SELECT count(*) FROM p), 6) AS share FROM t GROUP BY 1")
def tag_prevalence(spark: S, d: str) -> DataFrame:
    p = X.samples(spark, d).where("label = 1")
    n = p.agg(F.count("*").alias("n_all"))
    return p.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("tag", "n", F.round(F.col("n") / F.col("n_all"), 6).alias("share"))


@query("SELECT label::BIGINT AS label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS first, round(avg(embedding[64]::DOUBLE), 6) AS last FROM embeddings GROUP BY 1")
def mean_pool(spark: S, d: str) -> DataFrame:
    out = G.mean_pool(X.vectors(spark, d).select("label", "emb"), "label", "emb")
    return out.select("label", "n", F.round(F.col("mean")[0], 6).alias("first"), F.round(F.col("mean")[63], 6).alias("last"))


@query(f"WITH {X.GATE_P} SELECT pattern, count(*) AS n, round(avg(q[1]), 6) AS a, round(avg(q[2]), 6) AS b, round(avg(q[3]), 6) AS c FROM gate_q GROUP BY 1")
def gate_by_pattern(spark: S, d: str) -> DataFrame:
    return Q.gate_table(spark, d).groupBy("pattern").agg(F.count("*").alias("n"), *(F.round(F.avg(F.col("q")[k]), 6).alias(c) for k, c in enumerate("abc")))


@query(f"WITH {X.GATE_P} SELECT list_position(p, list_max(p))::BIGINT AS expert, count(*) AS n, round(avg(list_max(p)), 6) AS raw, round(avg(list_max(q)), 6) AS renormalised FROM gate_q GROUP BY 1")
def gate_argmax(spark: S, d: str) -> DataFrame:
    g = Q.gate_table(spark, d)
    return g.groupBy(F.array_position("p", F.array_max("p")).cast("long").alias("expert")).agg(F.count("*").alias("n"), F.round(F.avg(F.array_max("p")), 6).alias("raw"), F.round(F.avg(F.array_max("q")), 6).alias("renormalised"))


@query(f"""WITH {X.GATE_P}, m AS (SELECT avg(p[1]) AS p1, avg(p[2]) AS p2, avg(p[3]) AS p3, avg(mask[1]) AS m1, avg(mask[2]) AS m2, avg(mask[3]) AS m3 FROM gate_q)
SELECT round((p1 - m1 / (m1 + m2 + m3)) ** 2 + (p2 - m2 / (m1 + m2 + m3)) ** 2 + (p3 - m3 / (m1 + m2 + m3)) ** 2, 6) AS penalty FROM m""")
def load_balance(spark: S, d: str) -> DataFrame:
    return G.load_balance(Q.gate_table(spark, d), "p", "mask", 3)


EVAL = "eval AS (SELECT o_orderpriority AS variant, o_orderkey % 3 AS seed, avg(o_totalprice) / 1e6 AS metric FROM orders GROUP BY 1, 2)"


def eval_records(spark: S, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("variant"), (F.col("o_orderkey") % 3).alias("seed")).agg((F.avg("o_totalprice") / 1e6).alias("metric"))


@query(f"WITH {EVAL} SELECT variant, count(*) AS n, round(avg(metric), 4) AS mean, round(stddev_pop(metric), 4) AS std, printf('%.4f', avg(metric)) || ' ± ' || printf('%.4f', stddev_pop(metric)) AS shown FROM eval GROUP BY 1")
def mean_std_table(spark: S, d: str) -> DataFrame:
    return G.mean_std(eval_records(spark, d), ["variant"], "metric")


@query(f"""WITH {EVAL}, w AS (SELECT seed, max(metric) FILTER (variant = '1-URGENT') AS urgent, max(metric) FILTER (variant = '2-HIGH') AS high, max(metric) FILTER (variant = '5-LOW') AS low FROM eval GROUP BY 1)
SELECT seed, CASE greatest(urgent, high, low) WHEN urgent THEN 'urgent' WHEN high THEN 'high' ELSE 'low' END AS best FROM w""")
def best_marker(spark: S, d: str) -> DataFrame:
    w = eval_records(spark, d).groupBy("seed").pivot("variant", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.max("metric")).toDF("seed", "urgent", "high", "low")
    return w.select("seed", G.best_of("urgent", "high", "low").alias("best"))


@query(f"WITH {Q.TOKENS}, f AS (SELECT DISTINCT ON (h) doc_id, sha256(text) AS h FROM documents ORDER BY h, doc_id) SELECT doc_id, count(*) + 5 AS n_tokens, string_agg(token, ' ' ORDER BY pos) || ' END END END END END' AS line FROM tokens JOIN f USING (doc_id) GROUP BY doc_id")
def token_corpus(spark: S, d: str) -> DataFrame:
    first = table(spark, d, "documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    ws = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    out = table(spark, d, "documents").join(first, "doc_id", "left_semi").select("doc_id", F.concat(ws, F.array_repeat(F.lit("END"), 5)).alias("t"))
    return out.where("size(t) > 5").select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("line"))


@query(f"""WITH {X.VECTORS}, v AS (SELECT vec_id, vec_id // 32 AS batch, tags, list_transform(emb, lambda x: x / sqrt(list_sum(list_transform(emb, lambda z: z * z)))) AS u FROM vectors WHERE y = 1),
p AS (SELECT a.batch, a.vec_id, exp(list_dot_product(a.u, b.u) / 0.2) AS e, len(list_intersect(a.tags, b.tags)) > 0 AS pos FROM v a JOIN v b ON a.batch = b.batch AND a.vec_id <> b.vec_id),
s AS (SELECT batch, vec_id, sum(e) AS den, sum(e) FILTER (pos) AS num FROM p GROUP BY ALL)
SELECT batch, count(*) AS anchors, round(avg(-ln(num / den)), 6) AS loss FROM s WHERE num IS NOT NULL GROUP BY 1""")
def infonce_loss(spark: S, d: str) -> DataFrame:
    v = X.vectors(spark, d).where("y = 1").withColumn("batch", F.floor(F.col("vec_id") / 32).cast("long"))
    return G.infonce(v, "batch", "vec_id", "emb", "tags", 0.2)


@query(f"""WITH {X.VECTORS}, v AS (SELECT vec_id, vec_id // 32 AS batch, y, tags, list_transform(emb, lambda x: x / sqrt(list_sum(list_transform(emb, lambda z: z * z)))) AS u FROM vectors),
p AS (SELECT a.batch, a.vec_id, exp(list_dot_product(a.u, b.u) / 0.2) AS e, len(list_intersect(a.tags, b.tags)) > 0 OR (a.y = 0 AND b.y = 0) AS pos FROM v a JOIN v b ON a.batch = b.batch AND a.vec_id <> b.vec_id),
s AS (SELECT batch, vec_id, sum(e) AS den, sum(e) FILTER (pos) AS num FROM p GROUP BY ALL)
SELECT batch, count(*) AS anchors, round(avg(-ln(num / den)), 6) AS loss FROM s WHERE num IS NOT NULL GROUP BY 1""")
def infonce_loss_all(spark: S, d: str) -> DataFrame:
    v = X.vectors(spark, d).withColumn("batch", F.floor(F.col("vec_id") / 32).cast("long"))
    return G.infonce(v, "batch", "vec_id", "emb", "tags", 0.2, "y")


@query(f"""WITH {X.SAMPLES}, p AS (SELECT sample_id, tags FROM samples WHERE label = 1), t AS (SELECT sample_id, unnest(tags) AS tag FROM p), c AS (SELECT tag FROM t GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS n, round(avg((sample_id IN (SELECT sample_id FROM t JOIN c USING (tag)))::INTEGER), 6) AS rate FROM p""")
def anchor_valid_rate(spark: S, d: str) -> DataFrame:
    return G.anchor_rate(X.samples(spark, d).where("label = 1"), "sample_id", "tags")


# ---------------------------------------------------------------- windows


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) <= 3")
def cap_by_order(spark: S, d: str) -> DataFrame:
    return W.first_n(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_orderkey"], 3, "l_linenumber", "l_quantity", "l_extendedprice").drop("l_extendedprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_rows(spark: S, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)
