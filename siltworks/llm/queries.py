"""The registered queries of the corpus operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, line_dedup, mcd_quality, packing, pii, substring_dedup, token_alignment, token_planes, unigram_counts, url_cascade, vector_codes, vector_neardup
from .common import scratch

END_ID = 2


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_planes.write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary(), END_ID)
    return token_planes.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcd_quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The contract's rules: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op4_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosts listed by themselves are an eighth of the table's, spread over it by their digests."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = url_cascade.split_url(F.col("url"))[0]
    listed = pages.select(host.alias("host")).where((F.col("host") != "") & F.substring(F.md5(F.col("host").cast("binary")), 1, 1).isin("0", "1")).distinct()
    return url_cascade.judge(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"), listed)


def op5_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), unigram_counts.zipf_vocabulary(vocabulary("piece_bpe_32k.model")))


def op7_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with each place."""
    return decontaminate.find_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that a similar earlier line replaces."""
    return line_dedup.removed_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "line_no").distinct()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    by_label = found.rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    rows = found.rows.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.sha256()).alias("codebooks_sha256"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_neardup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.Alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).documents()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bit_planes, op2_mcd_quality, op3_jaccard_join, op4_url_cascade, op5_difference_cover, op6_unigram_counts, op7_window_packing, op8_benchmark_passages, op9_pii, op10_line_dedup, op11_vector_codes, op12_near_vectors, op13_token_alignment)
}

#: DuckDB SQL by query, where SQL can express it.
ORACLE_SQL: dict[str, str] = {}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL["op3_jaccard_join"] = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b USING (x) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, e.b FROM reach JOIN edges e ON e.a = reach.r)
SELECT doc_id, any_value(len(s))::BIGINT AS n_shingles, min(r) AS component_id FROM sets JOIN reach USING (doc_id) GROUP BY doc_id
"""

ORACLE_SQL["op5_difference_cover"] = """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS place FROM (SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE least < doc_id), range(50) r(k)),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM words),
marked AS (SELECT p.*, g.place IS NOT NULL AS gone FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.place = p.place),
done AS (SELECT doc_id, count_if(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM words LEFT JOIN done USING (doc_id)
"""

ORACLE_SQL["op10_line_dedup"] = """
WITH doc_lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL),
numbered AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM doc_lines),
sets AS (
  SELECT doc_id, line_no::INTEGER AS line_no, list_distinct(regexp_extract_all(lower(line), '[^\\x20\\x09-\\x0D]+')) AS s FROM numbered),
kept AS (SELECT doc_id, line_no, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) >= 1),
firsts AS (SELECT s, n, min({'d': doc_id, 'l': line_no}) AS f FROM kept GROUP BY s, n),
repeats AS (SELECT k.doc_id, k.line_no FROM kept k JOIN firsts f USING (s) WHERE (f.f.d, f.f.l) < (k.doc_id, k.line_no)),
words AS (SELECT f, n, unnest(s) AS w FROM firsts),
pairs AS (
  SELECT b.f AS b, a.n AS an, b.n AS bn, count(*) AS shared
  FROM words a JOIN words b ON a.w = b.w AND a.f < b.f AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.f, b.f, a.n, b.n)
SELECT doc_id, line_no FROM repeats
UNION SELECT b.d, b.l FROM pairs WHERE 100 * shared >= 90 * (an + bn - shared)
"""

ORACLE_SQL["op4_url_cascade"] = """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, r FROM rest),
urls AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM parts),
rules(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
hits AS (
  SELECT page_id, host, path, max({'n': length(rh || rp), 'k': rh || rp, 'v': v}) AS b
  FROM urls LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY ALL),
listed AS (SELECT DISTINCT host AS lh FROM urls WHERE host <> '' AND left(md5(host), 1) IN ('0', '1')),
spoiled AS (SELECT host, bool_or(lh IS NOT NULL) AS bad FROM (SELECT DISTINCT host FROM urls) LEFT JOIN listed ON host = lh OR ends_with(host, '.' || lh) GROUP BY host)
SELECT page_id, host, path, CASE WHEN b.n IS NULL THEN NULL ELSE b.k END AS rule,
  CASE WHEN b.n IS NOT NULL THEN b.v WHEN bad THEN 'block' ELSE 'allow' END AS verdict
FROM hits JOIN spoiled USING (host)
"""

_ROUNDS = 4
ORACLE_SQL["op11_vector_codes"] = (
    """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS (SELECT vec_id, part, x[part * len(x) // 4 + 1:(part + 1) * len(x) // 4] AS x FROM v, range(4) t(part)),
n AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM p),
least AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v ORDER BY vec_id LIMIT 256),
book0 AS MATERIALIZED (SELECT part, k, x AS c, xx AS cc FROM n JOIN least USING (vec_id)),
"""
    + "".join(
        f"""
at{r} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := (xx - 2 * list_inner_product(x, c) + cc)::BIGINT, k := k)) AS best FROM n JOIN book{r} USING (part) GROUP BY ALL),
"""
        + (
            ""
            if r == _ROUNDS
            else f"""
sums{r} AS (
  SELECT part, k, i, floor(sum(e) / count(*)) AS m
  FROM (SELECT part, best.k AS k, unnest(x) AS e, unnest(range(len(x))) AS i FROM at{r} JOIN n USING (vec_id, part)) GROUP BY ALL),
lists{r} AS (SELECT part, k, list(m ORDER BY i) AS c FROM sums{r} GROUP BY ALL),
book{r + 1} AS MATERIALIZED (SELECT part, k, coalesce(l.c, b.c) AS c, list_inner_product(coalesce(l.c, b.c), coalesce(l.c, b.c)) AS cc FROM book{r} b LEFT JOIN lists{r} l USING (part, k)),
"""
        )
        for r in range(_ROUNDS + 1)
    )
    + f"""
coded AS (SELECT vec_id, string_agg(lower(printf('%02x', best.k::INTEGER)), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM at{_ROUNDS} GROUP BY vec_id),
whole AS (
  SELECT sha256(string_agg(e::BIGINT::VARCHAR, ',' ORDER BY part, k, i)) AS codebooks_sha256
  FROM (SELECT part, k, unnest(c) AS e, unnest(range(len(c))) AS i FROM book{_ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN v USING (vec_id), whole
"""
)

ORACLE_SQL["op12_near_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
pairs AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, p.b FROM reach JOIN pairs p ON p.a = reach.r),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(r) AS component_id, vec_id = min(r) AS kept FROM reach LEFT JOIN links ON a = vec_id GROUP BY vec_id
"""
