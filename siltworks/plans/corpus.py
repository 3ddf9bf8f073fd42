"""Queries: sources, filters, scalar functions, joins, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import corpus as C
from ..operators import joins as J
from ..sources import manifest as M
from ..sources.tables import workspace
from . import fixtures as X
from .registry import query, table

S = SparkSession


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def scan_features(spark: S, d: str) -> DataFrame:
    return M.read_columns(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])


@query("""SELECT key, min(source) AS source FROM (
  SELECT lower(trim(c_name)) AS key, 'customer' AS source FROM customer UNION ALL SELECT lower(trim(s_name)), 'supplier' FROM supplier) GROUP BY key""")
def source_index_union(spark: S, d: str) -> DataFrame:
    parts = {"customer": table(spark, d, "customer").select(F.col("c_name").alias("key")), "supplier": table(spark, d, "supplier").select(F.col("s_name").alias("key"))}
    return M.union_indexes(parts, "key").select("key", "source")


@query("SELECT event_id, user_id, value, props FROM events WHERE event_type = 'error'")
def meta_scan(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'")
    return M.with_required(e, ["event_id", "user_id", "value"], ["props", "not_there"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def meta_profile(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT page_id, sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS size FROM pages WHERE html LIKE '<!DOCTYPE%'")
def binary_ingest(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return M.ingest(p, b"<!DOCTYPE")


@query("""SELECT id, min(list)::BIGINT AS first_list FROM (SELECT c_custkey::VARCHAR AS id, 0 AS list FROM customer UNION ALL SELECT o_custkey::VARCHAR, 1 FROM orders) GROUP BY 1""")
def id_union(spark: S, d: str) -> DataFrame:
    return M.ordered_union([table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))], "k")


@query(f"WITH {X.CHUNKS} SELECT chunk, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM chunks GROUP BY 1")
def manifest_chunks(spark: S, d: str) -> DataFrame:
    return X.chunks(spark, d).groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def sink_roundtrip(spark: S, d: str) -> DataFrame:
    out = M.round_trip(table(spark, d, "orders"), workspace(spark, "roundtrip"))
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT kind, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders, (VALUES ('csv'), ('json'), ('parquet')) k(kind) GROUP BY 1, 2")
def sink_formats(spark: S, d: str) -> DataFrame:
    """Each sink's rows as they are read back."""
    out, orders = None, table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    for kind in ("csv", "json", "parquet"):
        back = M.round_trip_as(orders, workspace(spark, kind), kind).withColumn("kind", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out.groupBy("kind", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT event_id, (props->>'$.k')::BIGINT AS k, props->>'$.absent.deeper' AS missing FROM events""")
def nested_json_get(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.absent.deeper").alias("missing"))


LINES = """lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
flagged AS (SELECT *, regexp_matches(line, '^[^ ]+\\.?$') AS header FROM lines),
sections AS (SELECT *, sum(header::INTEGER) OVER (PARTITION BY doc_id ORDER BY no) AS section FROM flagged)"""


def sectioned(spark: S, d: str) -> DataFrame:
    from ..operators.windows import sections

    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return sections(lines.withColumn("header", F.col("line").rlike(r"^[^ ]+\.?$")), "doc_id", "no", "header")


@query(f"WITH {LINES} SELECT doc_id, section::BIGINT AS section, count(*) AS n_lines, min(no)::BIGINT AS first_line FROM sections WHERE section > 0 GROUP BY ALL HAVING count(*) <= 500")
def section_lines(spark: S, d: str) -> DataFrame:
    g = sectioned(spark, d).where("section > 0").groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.min("no").cast("long").alias("first_line"))
    return g.where("n_lines <= 500")


@query(f"WITH {LINES} SELECT doc_id, section::BIGINT AS section, max(CASE WHEN header THEN line END) AS run, count(*) FILTER (NOT header AND line LIKE 'The%') AS n_rows FROM sections WHERE section > 0 GROUP BY ALL")
def log_sections(spark: S, d: str) -> DataFrame:
    return sectioned(spark, d).where("section > 0").groupBy("doc_id", "section").agg(F.max(F.when(F.col("header"), F.col("line"))).alias("run"), F.count_if(~F.col("header") & F.col("line").startswith("The")).alias("n_rows"))


@query("""WITH o AS (SELECT o_orderkey % 7 AS log, o_orderkey AS k, o_custkey AS run, floor(o_totalprice) AS x, floor(o_totalprice / 2) AS y FROM orders),
m AS (SELECT log, run::VARCHAR AS run, CASE WHEN k % 3 = 0 THEN y WHEN k % 5 <> 0 THEN x WHEN k % 11 <> 0 THEN 7.0 END::DOUBLE AS metric FROM o)
SELECT log, run, count(*) AS n, round(avg(metric), 6) AS mean, round(stddev_pop(metric), 6) AS std FROM m WHERE metric IS NOT NULL GROUP BY 1, 2""")
def log_metrics(spark: S, d: str) -> DataFrame:
    """The metric of each run of made logs, by the row that begins with 10 below the last title; mean and deviation by run."""
    from ..operators.windows import scraped_metric

    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    x, y = (F.floor(F.col("o_totalprice") / by).cast("string") for by in (1, 2))
    title = F.lit("== Gated fusion ==")
    text = [F.concat(F.lit("### RUN = "), F.col("o_custkey"), F.lit(" begins")), F.lit("10 9.9 9.9"), title, F.lit("  1 0.1 0.2"), F.when(k % 5 == 0, "5 0.3 0.3").otherwise(F.concat(F.lit("  10 0.3 "), x)), F.when(k % 3 == 0, title).otherwise("other"), F.when(k % 3 == 0, F.concat(F.lit("10  0.5 "), y)).when(k % 11 == 0, "end").otherwise("100 0.1 7.0")]
    lines = o.select((k % 7).alias("log"), k.alias("k"), F.posexplode(F.array(*text)).alias("pos", "line")).select("log", (F.col("k") * 10 + F.col("pos")).alias("no"), "line")
    found = scraped_metric(lines, "log", "no", "line", "### RUN = ", "Gated fusion", "10", 3)
    return found.groupBy("log", "run").agg(F.count("*").alias("n"), F.round(F.avg("metric"), 6).alias("mean"), F.round(F.stddev_pop("metric"), 6).alias("std"))


# ---------------------------------------------------------------- filters and scalar functions


@query(f"WITH {X.CHUNKS} SELECT count(*) AS n_before, count_if(ok_pe AND ok_ember)::BIGINT AS n_after FROM chunks")
def usable_rows(spark: S, d: str) -> DataFrame:
    return C.before_after(X.chunks(spark, d), "ok_pe", "ok_ember")


@query("""SELECT user_id, day::VARCHAR AS day, (click > 0)::INTEGER AS click, (view > 0)::INTEGER AS view, (signup > 0)::INTEGER AS signup, (purchase > 0)::INTEGER AS purchase FROM (
  SELECT user_id, ts::DATE AS day, count_if(event_type = 'click') AS click, count_if(event_type = 'view') AS view, count_if(event_type = 'signup') AS signup, count_if(event_type = 'purchase') AS purchase FROM events GROUP BY 1, 2)""")
def tag_multihot(spark: S, d: str) -> DataFrame:
    kinds = ["click", "view", "signup", "purchase"]
    counts = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).pivot("event_type", kinds).count()
    return counts.select("user_id", F.col("day").cast("string").alias("day"), *C.binarised(*kinds))


@query(f"WITH {X.SAMPLES} SELECT sample_id, array_to_string(tags, ',') AS tags FROM samples WHERE label = 1 AND len(tags) > 0")
def tagged_positives(spark: S, d: str) -> DataFrame:
    return X.samples(spark, d).where((F.col("label") == 1) & (F.size("tags") > 0)).select("sample_id", F.array_join("tags", ",").alias("tags"))


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path, length(html) AS size FROM pages)
SELECT page_id, path, size::BIGINT AS size FROM p WHERE regexp_matches(lower(path), '\\.(html|htm)$') AND size > 500 AND size < 20000""")
def admission_filter(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"), F.length("html").cast("long").alias("size"))
    return C.admitted(p, "path", "size", ["html", "htm"], 500, 20000)


@query("""SELECT doc_id, lang FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_matches(x, '^(heed|ndas).*$'))) = 0""")
def regex_exclusion(spark: S, d: str) -> DataFrame:
    return C.without_matching(table(spark, d, "documents"), F.split("text", r"\s+"), "^(heed|ndas).*$").select("doc_id", "lang")


@query("""SELECT page_id, 'web:' || replace(regexp_replace(regexp_replace(lower(split_part(url, '/', -1)), '\\.(z|gz)$', ''), '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}_?', ''), ',', '_') AS grp FROM pages""")
def group_key(spark: S, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", C.group_key(F.col("url"), F.lit("web")).alias("grp"))


@query("""WITH k AS (SELECT CASE WHEN doc_id % 7 = 0 THEN left(sha256(doc_id::VARCHAR), 60) WHEN doc_id % 11 = 0 THEN upper(sha256(doc_id::VARCHAR)) ELSE sha256(doc_id::VARCHAR) END AS key FROM documents)
SELECT count(*) AS n, count_if(regexp_matches(key, '^[0-9a-f]{64}$'))::BIGINT AS n_good, round(avg(regexp_matches(key, '^[0-9a-f]{64}$')::INTEGER), 6) AS ratio FROM k""")
def key_shape_stats(spark: S, d: str) -> DataFrame:
    sha = F.sha2(F.col("doc_id").cast("string"), 256)
    keys = table(spark, d, "documents").select(F.when(F.col("doc_id") % 7 == 0, F.substring(sha, 1, 60)).when(F.col("doc_id") % 11 == 0, F.upper(sha)).otherwise(sha).alias("key"))
    return C.key_shape(keys, "key")


@query("""SELECT doc_id, upper(hex(sha256(CASE WHEN length(t) >= 9 THEN left(t, 3) || chr(0) || chr(0) || substr(t, 6, 2) || chr(0) || chr(0) || substr(t, 10) WHEN length(t) >= 5 THEN left(t, 3) || chr(0) || chr(0) || substr(t, 6) ELSE t END))) AS h
FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM documents)""")
def field_mask(spark: S, d: str) -> DataFrame:
    raw = F.encode(F.regexp_replace("text", "[^ -~]", ""), "UTF-8")
    return table(spark, d, "documents").select("doc_id", F.upper(F.hex(F.sha2(C.masked_bytes(raw, (3, 2), (7, 2)), 256))).alias("h"))


# Made executables: an offset of its own for each row, both magics, zeroed and other machines; some without a signature, some cut short, some with an offset beyond their end.
LE = "substr(printf('%08X', {0}), 7, 2) || substr(printf('%08X', {0}), 5, 2) || substr(printf('%08X', {0}), 3, 2) || substr(printf('%08X', {0}), 1, 2)"
HEADERS = f"""made AS (SELECT doc_id, 64 + doc_id % 32 AS e, CASE doc_id % 3 WHEN 0 THEN '0B01' WHEN 1 THEN '0B02' ELSE '0701' END AS magic, CASE WHEN doc_id % 2 = 0 THEN '0000' ELSE '64AA' END AS machine, upper(hex(encode(left(text, 40)))) AS tail FROM documents),
whole AS (SELECT doc_id, e, CASE WHEN doc_id % 11 = 0 THEN '5A4D' ELSE '4D5A' END || repeat('00', 58) || {LE.format("CASE WHEN doc_id % 7 = 0 THEN 4000000000 ELSE e END")} || repeat('CC', (e - 64)::INTEGER)
  || CASE WHEN doc_id % 13 = 0 THEN '50454500' ELSE '50450000' END || machine || repeat('11', 18) || magic || repeat('22', 66) || '0300' || tail AS h FROM made),
headers AS (SELECT doc_id, e, CASE WHEN doc_id % 5 = 0 THEN left(h, (2 * (e + 20))::INTEGER) ELSE h END AS h FROM whole),
judged AS (SELECT *, doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 13 <> 0 AND length(h) >= 2 * (e + 94) AS ok FROM headers)"""


def headers(spark: S, d: str) -> DataFrame:
    """(doc_id, content): the same in Spark."""
    e, n = 64 + F.col("doc_id") % 32, F.col("doc_id")
    shown = F.when(n % 7 == 0, F.lit("EE6B2800")).otherwise(F.lpad(F.hex(e), 8, "0"))
    little = F.concat(*(F.substring(shown, k, 2) for k in (7, 5, 3, 1)))
    magic = F.when(n % 3 == 0, "0B01").when(n % 3 == 1, "0B02").otherwise("0701")
    parts = [F.when(n % 11 == 0, "5A4D").otherwise("4D5A"), F.lit("00" * 58), little, F.repeat(F.lit("CC"), (e - 64).cast("int")), F.when(n % 13 == 0, "50454500").otherwise("50450000"), F.when(n % 2 == 0, "0000").otherwise("64AA"), F.lit("11" * 18), magic, F.lit("22" * 66), F.lit("0300"), F.hex(F.encode(F.left("text", F.lit(40)), "UTF-8"))]
    whole = F.concat(*parts)
    return table(spark, d, "documents").select("doc_id", F.unhex(F.when(n % 5 == 0, F.left(whole, (2 * (e + 20)).cast("int"))).otherwise(whole)).alias("content"))


@query(f"""WITH {HEADERS}, v AS (SELECT doc_id, ok, substr(h, (2 * e + 49)::BIGINT, 4) AS magic, substr(h, (2 * e + 9)::BIGINT, 4) AS machine,
  left(h, (2 * e + 8)::BIGINT) || '0000' || substr(h, (2 * e + 13)::BIGINT, (2 * (24 + 68 - 6))::BIGINT) || '0000' || substr(h, (2 * (e + 94) + 1)::BIGINT) AS model,
  left(h, (2 * e + 8)::BIGINT) AS before, substr(h, (2 * e + 13)::BIGINT) AS after FROM judged)
SELECT doc_id, CASE WHEN ok THEN sha256(model) END AS model, CASE WHEN ok THEN sha256(before || CASE WHEN machine = '0000' AND magic = '0B01' THEN '4C01' WHEN machine = '0000' AND magic = '0B02' THEN '6486' ELSE machine END || after) END AS analysis FROM v""")
def header_views(spark: S, d: str) -> DataFrame:
    """Both views of made executables, as digests of their hex; null without a whole header."""
    shown = lambda view: F.sha2(F.hex(view), 256)
    return headers(spark, d).select("doc_id", shown(C.model_view(F.col("content"))).alias("model"), shown(C.analysis_view(F.col("content"))).alias("analysis"))


TOKENS = """tokens AS (SELECT doc_id, unnest(ws) AS token, unnest(range(len(ws)))::BIGINT AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents))"""


def tokens(spark: S, d: str) -> DataFrame:
    ws = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return table(spark, d, "documents").select("doc_id", F.posexplode(ws).alias("pos", "token")).select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


@query(f"""WITH {TOKENS}, n AS (SELECT doc_id, CASE WHEN regexp_matches(token, '^[0-9]+$') THEN CASE WHEN length(token) <= 4 AND try_cast(token AS INTEGER) <= 5000 THEN token ELSE 'HIMM' END ELSE lower(token) END AS t FROM tokens)
SELECT t AS token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM n WHERE regexp_matches(t, '^[0-9]+$') OR t = 'HIMM' GROUP BY 1""")
def token_normalise(spark: S, d: str) -> DataFrame:
    t = tokens(spark, d).select("doc_id", C.bucketed_number(F.col("token")).alias("token"))
    return t.where(F.col("token").rlike("^[0-9]+$") | (F.col("token") == "HIMM")).groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


# Made instructions: one a line item, with up to two operands of each kind.
INSTRUCTIONS = """raw AS (SELECT l_orderkey AS ok, l_linenumber AS no, ['mov', 'xor', 'lea', 'push', 'ret'][(l_partkey % 5) + 1] AS m, ['eax', 'ebx', 'esp', 'r8d'][(l_suppkey % 4) + 1] AS reg,
  (l_partkey - 700) * (l_linenumber * l_linenumber * l_linenumber) AS imm, CASE l_suppkey % 3 WHEN 0 THEN '0' WHEN 1 THEN 'rbx' END AS base, CASE WHEN l_partkey % 2 = 0 THEN 4 END AS scale, l_partkey % 9000 AS disp, l_partkey % 5 AS k FROM lineitem),
ops AS (SELECT *, reg AS r, CASE WHEN imm BETWEEN -5000 AND 5000 THEN CASE WHEN imm < 0 THEN '-' ELSE '' END || '0x' || lower(printf('%x', abs(imm)::BIGINT)) ELSE 'HIMM' END AS i,
  CASE WHEN base IS NULL OR base = '0' THEN '[MEM]' ELSE '[' || base || '*' || coalesce(scale, 1) || '+' || disp || ']' END AS d FROM raw)"""


@query(f"""WITH {INSTRUCTIONS}, t AS (SELECT ok, 'X_' || m || CASE k WHEN 0 THEN '_' || r || ',_' || i WHEN 1 THEN '_' || r || ',_' || r WHEN 2 THEN '_' || r || ',_' || d WHEN 3 THEN '_' || i ELSE '' END AS token FROM ops)
SELECT token, count(*) AS n, count(DISTINCT ok) AS n_orders FROM t GROUP BY 1""")
def instruction_tokens(spark: S, d: str) -> DataFrame:
    """How often each normalised instruction occurs."""
    raw = table(spark, d, "lineitem")
    k, reg = F.col("l_partkey") % 5, F.element_at(F.array(*map(F.lit, ("eax", "ebx", "esp", "r8d"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    imm = ((F.col("l_partkey") - 700) * F.col("l_linenumber") * F.col("l_linenumber") * F.col("l_linenumber")).cast("long")
    base = F.when(F.col("l_suppkey") % 3 == 0, "0").when(F.col("l_suppkey") % 3 == 1, "rbx")
    null = lambda t: F.lit(None).cast(t)
    make = lambda kind, value, b, s, x: F.struct(F.lit(kind).alias("type"), value.alias("value"), b.alias("base"), s.alias("scale"), x.alias("disp"))
    r = make("reg", reg, null("string"), null("int"), null("long"))
    i = make("imm", imm.cast("string"), null("string"), null("int"), null("long"))
    m = make("mem", null("string"), base, F.when(F.col("l_partkey") % 2 == 0, 4), (F.col("l_partkey") % 9000).cast("long"))
    operands = F.when(k == 0, F.array(r, i)).when(k == 1, F.array(r, r)).when(k == 2, F.array(r, m)).when(k == 3, F.array(i)).otherwise(F.slice(F.array(r), 1, 0))
    name = F.element_at(F.array(*map(F.lit, ("mov", "xor", "lea", "push", "ret"))), (k + 1).cast("int"))
    t = raw.select(F.col("l_orderkey").alias("ok"), C.normal_instruction(name, operands).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("ok").alias("n_orders"))


CATEGORIES = [("STANDARD", "plain"), ("SMALL", "size"), ("MEDIUM", "size"), ("LARGE", "size"), ("ECONOMY", "plain"), ("ECONOMY", "cheap"), ("PROMO", "cheap")]


@query("""WITH dim(word, cat) AS (VALUES ('STANDARD', 'plain'), ('SMALL', 'size'), ('MEDIUM', 'size'), ('LARGE', 'size'), ('ECONOMY', 'plain'), ('ECONOMY', 'cheap'), ('PROMO', 'cheap')),
w AS (SELECT p_brand, coalesce(cat, 'other') AS cat FROM (SELECT p_brand, split_part(p_type, ' ', 1) AS word FROM part) LEFT JOIN dim USING (word))
SELECT p_brand, count_if(cat = 'plain')::BIGINT AS plain, count_if(cat = 'size')::BIGINT AS size, count_if(cat = 'cheap')::BIGINT AS cheap, count_if(cat = 'other')::BIGINT AS other FROM w GROUP BY 1""")
def category_counts(spark: S, d: str) -> DataFrame:
    dim = spark.createDataFrame(CATEGORIES, "word string, cat string")
    words = table(spark, d, "part").select("p_brand", F.substring_index("p_type", " ", 1).alias("word")).join(F.broadcast(dim), "word", "left")
    return words.withColumn("c", F.coalesce("cat", F.lit("other"))).groupBy("p_brand").pivot("c", ["plain", "size", "cheap", "other"]).count().na.fill(0)


VOCAB = TOKENS + """, vocab AS (SELECT token, (row_number() OVER (ORDER BY n DESC, token) - 1)::BIGINT AS id FROM (SELECT token, count(*) AS n FROM tokens GROUP BY 1) QUALIFY id < 500)"""


def vocab(spark: S, d: str) -> DataFrame:
    from ..operators.windows import top_rows

    counts = tokens(spark, d).groupBy("token").agg(F.count("*").alias("n"))
    return top_rows(counts, 500, F.col("n").desc(), F.col("token")).select("token", (F.col("rank") - 1).alias("id"))


@query(f"""WITH {VOCAB}, coded AS (SELECT doc_id, pos, coalesce(id + 1, 501) AS id FROM tokens LEFT JOIN vocab USING (token))
SELECT doc_id, array_to_string(list(id ORDER BY pos), ' ') AS ids, count(*) AS n_tokens, count_if(id = 501)::BIGINT AS n_unknown, round(count_if(id = 501) / count(*), 6) AS unknown_rate FROM coded GROUP BY 1""")
def vocab_encode(spark: S, d: str) -> DataFrame:
    v = vocab(spark, d).select("token", (F.col("id") + 1).alias("id"))
    out = C.encode(tokens(spark, d), v, 501)
    return out.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), "n_tokens", "n_unknown", F.round(F.col("n_unknown") / F.col("n_tokens"), 6).alias("unknown_rate"))


@query("""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda x: length(x)) AS v FROM documents)
SELECT doc_id, array_to_string(list_resize(v[1:150], 150, 0), ' ') AS ids, least(len(v), 150)::BIGINT AS n FROM w""")
def truncate_pad(spark: S, d: str) -> DataFrame:
    v = F.transform(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.length(w).cast("long"))
    ids, n = C.padded(v, 150)
    return table(spark, d, "documents").select("doc_id", F.array_join(ids.cast("array<string>"), " ").alias("ids"), n.cast("long").alias("n"))


@query("SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS v FROM customer")
def signed_log(spark: S, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.round(A.signed_log(F.col("c_acctbal")), 6).alias("v"))


@query(f"""WITH {X.VECTORS}, u AS (SELECT vec_id, emb, greatest(sqrt(list_sum(list_transform(emb, lambda x: x * x))), 1e-12) AS n FROM vectors)
SELECT vec_id, round(n, 6) AS norm, round(emb[1] / n, 6) AS first, round(emb[64] / n, 6) AS last FROM u""")
def l2_normalise(spark: S, d: str) -> DataFrame:
    u = A.unit(F.col("emb"))
    return X.vectors(spark, d).select("vec_id", F.round(A.norm(F.col("emb")), 6).alias("norm"), F.round(u[0], 6).alias("first"), F.round(u[63], 6).alias("last"))


def gate_table(spark: S, d: str) -> DataFrame:
    g = X.gates(spark, d).withColumn("p", A.bounded_softmax(F.col("z")))
    return g.withColumn("q", A.renormalise(F.col("p"), F.col("mask")))


@query(f"WITH {X.GATE_P} SELECT vec_id, round(p[1], 6) AS p1, round(p[2], 6) AS p2, round(p[3], 6) AS p3 FROM gate_p")
def bounded_softmax(spark: S, d: str) -> DataFrame:
    return gate_table(spark, d).select("vec_id", *(F.round(F.col("p")[k], 6).alias(f"p{k + 1}") for k in range(3)))


@query(f"WITH {X.GATE_P} SELECT vec_id, pattern, round(q[1], 6) AS q1, round(q[2], 6) AS q2, round(q[3], 6) AS q3 FROM gate_q")
def gate_renorm(spark: S, d: str) -> DataFrame:
    return gate_table(spark, d).select("vec_id", "pattern", *(F.round(F.col("q")[k], 6).alias(f"q{k + 1}") for k in range(3)))


FUSE = X.GATE_P + """, fuse AS (SELECT g.vec_id, q, mask, emb[1:16] AS e1, emb[33:48] AS e2, emb[17:32] AS e3 FROM gate_q g JOIN vectors USING (vec_id))"""


def fusable(spark: S, d: str) -> DataFrame:
    v = X.vectors(spark, d).select("vec_id", F.array(F.slice("emb", 1, 16), F.slice("emb", 33, 16), F.slice("emb", 17, 16)).alias("experts"))
    return gate_table(spark, d).join(v, "vec_id")


def fused_places(spark: S, d: str, how: str) -> DataFrame:
    """(vec_id, pos, x): every place of the fused vectors."""
    from ..operators.vectors import fuse

    fused = fusable(spark, d).select("vec_id", F.posexplode(fuse(how, F.col("experts"), F.col("mask"), F.col("q"))).alias("pos", "x"))
    return fused.select("vec_id", "pos", (F.round("x", 6) + 0.0).alias("x"))


@query(f"WITH {FUSE} SELECT vec_id, i::INTEGER AS pos, round(q[1] * e1[i + 1] + q[2] * e2[i + 1] + q[3] * e3[i + 1], 6) + 0.0 AS x FROM fuse, range(16) r(i)")
def fuse_gated(spark: S, d: str) -> DataFrame:
    return fused_places(spark, d, "gated")


@query(f"WITH {FUSE} SELECT vec_id, i::INTEGER AS pos, round((mask[1] * e1[i + 1] + mask[2] * e2[i + 1] + mask[3] * e3[i + 1]) / greatest(mask[1] + mask[2] + mask[3], 1), 6) + 0.0 AS x FROM fuse, range(16) r(i)")
def fuse_mean(spark: S, d: str) -> DataFrame:
    return fused_places(spark, d, "mean")


@query(f"WITH {FUSE} SELECT vec_id, i::INTEGER AS pos, round(CASE WHEN i < 48 THEN mask[i // 16 + 1] * list_concat(e1, e2, e3)[i + 1] ELSE mask[i - 47] END, 6) + 0.0 AS x FROM fuse, range(51) r(i)")
def fuse_concat(spark: S, d: str) -> DataFrame:
    return fused_places(spark, d, "concat")


@query(f"WITH {FUSE} SELECT vec_id, i::INTEGER AS pos, round(mask[2] * e2[i + 1], 6) + 0.0 AS x FROM fuse, range(16) r(i)")
def fuse_single(spark: S, d: str) -> DataFrame:
    return fused_places(spark, d, "single:1")


@query(f"WITH {X.VECTORS} SELECT vec_id, CASE WHEN b IS NOT NULL THEN round(1 / (1 + exp(-b[1] * 8)), 6) END AS score FROM vectors")
def zero_shot_score(spark: S, d: str) -> DataFrame:
    return X.vectors(spark, d).select("vec_id", F.when(F.col("b").isNotNull(), F.round(A.sigmoid(F.col("b")[0] * 8), 6)).alias("score"))


@query(f"WITH {X.SCORES}, l AS (SELECT vec_id, ln(least(greatest(score, 1e-7), 1 - 1e-7) / (1 - least(greatest(score, 1e-7), 1 - 1e-7))) / 1.7 AS z FROM scores WHERE score IS NOT NULL) SELECT vec_id, round(1 / (1 + exp(-least(greatest(z, -50), 50))), 6) AS p FROM l")
def apply_temperature(spark: S, d: str) -> DataFrame:
    return X.scores(spark, d).where("score is not null").select("vec_id", F.round(A.at_temperature(F.col("score"), 1.7), 6).alias("p"))


U = "('0x' || left(sha256('7:' || vec_id || ':{k}'), 12))::BIGINT / 281474976710656.0"


@query(f"WITH {X.GATES}, k AS (SELECT vec_id, mask, [CASE WHEN {U.format(k=0)} < 0.3 THEN 0 ELSE mask[1] END, CASE WHEN {U.format(k=1)} < 0.3 THEN 0 ELSE mask[2] END, CASE WHEN {U.format(k=2)} < 0.3 THEN 0 ELSE mask[3] END] AS d FROM gates), r AS (SELECT vec_id, CASE WHEN list_sum(d) > 0 THEN d ELSE mask END AS d FROM k) SELECT vec_id, d[1]::BIGINT AS a, d[2]::BIGINT AS b, d[3]::BIGINT AS c FROM r")
def expert_dropout(spark: S, d: str) -> DataFrame:
    m = C.expert_dropout(F.col("mask"), F.col("vec_id"), 0.3, "7")
    return X.gates(spark, d).withColumn("m", m).select("vec_id", *(F.col("m")[k].cast("long").alias(c) for k, c in enumerate("abc")))


# ---------------------------------------------------------------- joins


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, c_mktsegment FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def assemble_dataset(spark: S, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), "o_orderstatus")
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("c"), "c_mktsegment")
    return J.assemble(li, o, c, "k", "c").select(F.col("k").alias("l_orderkey"), "l_linenumber", "o_orderstatus", "c_mktsegment")


@query("SELECT d.doc_id AS id, (e.vec_id IS NOT NULL)::INTEGER AS mask, round(e.embedding[1]::DOUBLE, 6) AS first FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 4 <> 0) e ON d.doc_id = e.vec_id")
def align_vectors(spark: S, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 4 != 0, F.col("embedding")).otherwise(F.slice("embedding", 1, 5)).alias("v"))
    out = J.align(table(spark, d, "documents").select(F.col("doc_id").alias("id")), v, "id", "v", 64)
    return out.select("id", "mask", F.round(F.col("v")[0].cast("double"), 6).alias("first"))


KEY_NAMES = """files AS (SELECT lower(s_name) || '.exe' AS name, s_suppkey AS value, s_suppkey AS ord FROM supplier UNION ALL SELECT lower(c_name), c_custkey + 1000000, c_custkey + 1000000 FROM customer),
key_names AS (SELECT CASE k % 4 WHEN 0 THEN n WHEN 1 THEN 'dir/' || n || '.dll' WHEN 2 THEN upper(n) ELSE n || '.exe' END || CASE WHEN k % 11 = 0 THEN 'zz' ELSE '' END AS name
  FROM (SELECT s_name AS n, s_suppkey AS k FROM supplier UNION ALL SELECT c_name, c_custkey FROM customer)),
base_names AS (SELECT name, value, ord, lower(split_part(name, '/', -1)) AS base FROM files),
dim AS (SELECT candidate, max({'o': ord, 'v': value}) AS m FROM (SELECT base AS candidate, value, ord FROM base_names UNION ALL SELECT regexp_replace(base, '\\.[^.]*$', ''), value, ord FROM base_names) GROUP BY 1)"""


def key_dimension(spark: S, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.concat(F.lower("s_name"), F.lit(".exe")).alias("name"), F.col("s_suppkey").alias("value"))
    c = table(spark, d, "customer").select(F.lower("c_name").alias("name"), (F.col("c_custkey") + 1000000).alias("value"))
    return J.name_dimension(s.unionByName(c).withColumn("ord", F.col("value")), "name", "value", "ord")


@query(f"WITH {KEY_NAMES} SELECT candidate, m.v AS value FROM dim")
def filename_dim(spark: S, d: str) -> DataFrame:
    return key_dimension(spark, d)


@query(f"""WITH {KEY_NAMES}, n AS (SELECT DISTINCT name, lower(split_part(name, '/', -1)) AS base, regexp_replace(lower(split_part(name, '/', -1)), '\\.[^.]*$', '') AS stem FROM key_names),
tries AS (SELECT name, unnest([base, stem, stem || '.exe', stem || '.dll', base || '.exe', base || '.dll']) AS candidate, unnest(range(6)) AS priority FROM n),
hit AS (SELECT name, min({{'p': priority, 'v': m.v}}) AS h FROM tries JOIN dim USING (candidate) GROUP BY 1)
SELECT name, h.v::VARCHAR AS value FROM n LEFT JOIN hit USING (name)""")
def key_cascade(spark: S, d: str) -> DataFrame:
    base = table(spark, d, "supplier").select(F.col("s_name").alias("n"), F.col("s_suppkey").alias("k")).unionByName(table(spark, d, "customer").select(F.col("c_name").alias("n"), F.col("c_custkey").alias("k")))
    m = F.col("k") % 4
    name = F.when(m == 0, F.col("n")).when(m == 1, F.concat(F.lit("dir/"), "n", F.lit(".dll"))).when(m == 2, F.upper("n")).otherwise(F.concat("n", F.lit(".exe")))
    names = base.select(F.concat(name, F.when(F.col("k") % 11 == 0, "zz").otherwise("")).alias("name")).distinct()
    return J.reconcile(names, "name", key_dimension(spark, d)).select("name", F.col("value").cast("string").alias("value"))


@query("SELECT k, coalesce(a.v, b.v) AS v FROM (SELECT c_custkey AS k, 'c' || c_nationkey AS v FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT o_custkey AS k, 'o' || count(*) AS v FROM orders GROUP BY 1) b USING (k)")
def prefer_merge(spark: S, d: str) -> DataFrame:
    a = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.concat(F.lit("c"), "c_nationkey").alias("v"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.concat(F.lit("o"), F.count("*")).alias("v"))
    return J.prefer(a, b, "k", "v")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def cross_class_anti(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query(f"WITH {X.SAMPLES}, m AS (SELECT label, sample_id IN (SELECT user_id * 1000 + dayofyear(ts::DATE) FROM events WHERE event_type = 'purchase') AS known FROM samples) SELECT label, count_if(known)::BIGINT AS kept, count_if(NOT known)::BIGINT AS dropped FROM m GROUP BY 1")
def reindex_drop(spark: S, d: str) -> DataFrame:
    master = table(spark, d, "events").where("event_type = 'purchase'").select((F.col("user_id") * 1000 + F.dayofyear("ts")).alias("sample_id")).distinct().withColumn("known", F.lit(True))
    return X.samples(spark, d).join(master, "sample_id", "left").groupBy("label").agg(F.count("known").alias("kept"), (F.count("*") - F.count("known")).alias("dropped"))


@query(f"WITH {X.CHUNKS} SELECT DISTINCT chunk FROM chunks WHERE chunk % 3 <> 0")
def pending_work(spark: S, d: str) -> DataFrame:
    every = X.chunks(spark, d).select("chunk").distinct()
    return every.join(every.where("chunk % 3 = 0"), "chunk", "left_anti")


@query("""WITH l AS (SELECT p_partkey::VARCHAR AS path, p_size AS size FROM part), r AS (SELECT p_partkey::VARCHAR AS path, p_size + (p_partkey % 5 = 0)::INTEGER AS size FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT 'x' || p_partkey, p_size FROM part WHERE p_partkey <= 50)
SELECT path, CASE WHEN l.size IS NULL THEN 'down' ELSE 'up' END AS direction FROM l FULL JOIN r USING (path) WHERE l.size IS DISTINCT FROM r.size""")
def inventory_diff(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "part")
    local = p.select(F.col("p_partkey").cast("string"), "p_size")
    remote = p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").cast("string"), F.col("p_size") + (F.col("p_partkey") % 5 == 0).cast("int"))
    return J.inventory_diff(local, remote.union(p.where("p_partkey <= 50").select(F.concat(F.lit("x"), "p_partkey"), "p_size")))


@query(f"WITH {X.VECTORS}, t AS (SELECT vec_id, unnest(tags) AS tag FROM vectors WHERE part = 'test') SELECT DISTINCT x.vec_id AS a, y.vec_id AS b FROM t x JOIN t y USING (tag) WHERE x.vec_id < y.vec_id")
def positive_pairs(spark: S, d: str) -> DataFrame:
    return J.overlap_pairs(X.vectors(spark, d).where("part = 'test'"), "vec_id", "tags")


@query("SELECT page_id FROM (SELECT page_id, html, CASE WHEN page_id % 6 = 0 THEN sha256('x') ELSE sha256(html) END AS want FROM pages) WHERE sha256(html) = want AND length(html) <= 15000")
def verify_checksum(spark: S, d: str) -> DataFrame:
    got = table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha"), F.length("html").alias("size"))
    want = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 6 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("html", 256)).alias("want"))
    return got.join(want, "page_id").where("sha = want and size <= 15000").select("page_id")


@query(f"""WITH {X.VECTORS}, t AS (SELECT vec_id, unnest(tags) AS tag FROM vectors WHERE part = 'test'),
pos AS (SELECT DISTINCT x.vec_id AS a, y.vec_id AS b, 1 AS label FROM t x JOIN t y USING (tag) WHERE x.vec_id < y.vec_id),
v AS (SELECT vec_id AS id, round(emb[1], 6) AS x FROM vectors), drawn AS (SELECT DISTINCT a, b + 1 AS b FROM pos WHERE b + 1 <> a), neg AS (SELECT a, b, -1 AS label FROM drawn n WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE (p.a = n.a AND p.b = n.b) OR (p.a = n.b AND p.b = n.a)))
SELECT a, b, label, p.x AS a_x, q.x AS b_x FROM (SELECT * FROM pos UNION ALL SELECT * FROM neg) JOIN v p ON p.id = a JOIN v q ON q.id = b""")
def pair_expand(spark: S, d: str) -> DataFrame:
    v = X.vectors(spark, d)
    return J.expanded_overlaps(v.where("part = 'test'"), "vec_id", "tags", v.select(F.col("vec_id").alias("id"), F.round(F.col("emb")[0], 6).alias("x")), "id", "x")


@query(f"""WITH {X.VECTORS}, c AS (SELECT vec_id, array_to_string(list_sort(tags), ',') AS c, tags FROM vectors WHERE len(tags) > 0)
SELECT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, count(*) AS pairs FROM c x JOIN c y ON x.vec_id < y.vec_id AND len(list_intersect(x.tags, y.tags)) > 0 GROUP BY 1, 2""")
def positive_pair_classes(spark: S, d: str) -> DataFrame:
    """Positive pairs of all rows by their classes of tags, counted without listing them."""
    return J.overlap_classes(X.vectors(spark, d), "tags").where("pairs > 0")


def batch_positives(spark: S, d: str) -> DataFrame:
    """The reference's positive pairs: over all rows of a batch."""
    v = X.vectors(spark, d).withColumn("batch", F.floor(F.col("vec_id") / 32).cast("long"))
    return J.batch_pairs(v, "batch", "vec_id", "tags", "y")


BATCH_POSITIVES = "SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.vec_id // 32 = y.vec_id // 32 AND x.vec_id < y.vec_id WHERE len(list_intersect(x.tags, y.tags)) > 0 OR (x.y = 0 AND y.y = 0)"


@query(f"WITH {X.VECTORS} {BATCH_POSITIVES}")
def positive_pairs_all(spark: S, d: str) -> DataFrame:
    return batch_positives(spark, d)


@query(f"""WITH {X.VECTORS}, pos AS ({BATCH_POSITIVES}),
v AS (SELECT vec_id AS id, round(emb[1], 6) AS x FROM vectors), drawn AS (SELECT DISTINCT a, b + 1 AS b FROM pos WHERE b + 1 <> a), neg AS (SELECT a, b, -1 AS label FROM drawn n WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE (p.a = n.a AND p.b = n.b) OR (p.a = n.b AND p.b = n.a)))
SELECT a, b, label, p.x AS a_x, q.x AS b_x FROM (SELECT a, b, 1 AS label FROM pos UNION ALL SELECT * FROM neg) JOIN v p ON p.id = a JOIN v q ON q.id = b""")
def pair_expand_all(spark: S, d: str) -> DataFrame:
    v = X.vectors(spark, d)
    pos = batch_positives(spark, d).withColumn("label", F.lit(1))
    neg = J.shifted_negatives(pos).withColumn("label", F.lit(-1))
    return J.expand_pairs(pos.unionByName(neg), v.select(F.col("vec_id").alias("id"), F.round(F.col("emb")[0], 6).alias("x")), "id", "x")


# ---------------------------------------------------------------- set operations


@query("""SELECT 'c' || c_custkey AS key, 1 AS label, 0::BIGINT AS detections FROM customer UNION ALL SELECT 's' || s_suppkey, 0, n FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def manifest_union(spark: S, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("key"), F.lit(1).alias("label"))
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("detections"))
    s = table(spark, d, "supplier").join(n, "s_suppkey").select(F.concat(F.lit("s"), "s_suppkey").alias("key"), F.lit(0).alias("label"), "detections")
    return c.unionByName(s, allowMissingColumns=True).na.fill({"detections": 0})


@query("""WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_b', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def key_set_overlap(spark: S, d: str) -> DataFrame:
    a, b = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    count = lambda name, df: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count("both", a.intersect(b)).unionByName(count("only_a", a.subtract(b))).unionByName(count("only_b", b.subtract(a)))


@query(f"WITH {X.SAMPLES}, forced AS (SELECT DISTINCT user_id * 1000 + 7 AS sample_id FROM events) SELECT sample_id, (sample_id IN (SELECT sample_id FROM forced))::INTEGER AS is_forced FROM samples WHERE sample_id IN (SELECT sample_id FROM forced) OR detections >= 6")
def forced_include(spark: S, d: str) -> DataFrame:
    forced = table(spark, d, "events").select((F.col("user_id") * 1000 + 7).alias("sample_id")).distinct()
    s = X.samples(spark, d)
    inside = s.join(forced, "sample_id", "left_semi").select("sample_id", F.lit(1).alias("is_forced"))
    return inside.unionByName(s.join(forced, "sample_id", "left_anti").where("detections >= 6").select("sample_id", F.lit(0).alias("is_forced")))
