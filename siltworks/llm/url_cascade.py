"""URL rules by Bloom filter cascades: exact membership of listed keys without joins.

A cascade is built for a set of listed keys within a universe of keys, both known.
Level 1 is a Bloom filter of the listed keys; level 2 of the other keys that
pass level 1; level 3 of the listed keys that pass level 2; and so on until no
key passes wrongly.  A key of the universe then is listed exactly if the first
level that it fails is an even one (or, passing all, their number is odd).

The universe here is every key of the corpus that could match: for each URL the
host's suffixes by label, each with the path prefixes of the lengths that rules
have.  The levels' bits are set by aggregations over the distinct keys.  Filters are
split into shards by key, so that each keeps a bounded size; all shards together
are broadcast while they are under ``BROADCAST_BYTES`` and else dealt to the keys
by shard.

Cases: a null URL, or one without ``://``, has an empty host and path and
matches no rule and no listed host; a null ``page_id`` stays; repeated rows each
give a row; an empty table gives no rows; an empty list blocks nothing; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Listed keys in a shard, and the bytes of filters that may be broadcast.
SHARD_KEYS, BROADCAST_BYTES = 1 << 20, 32 << 20
#: Level 1 lets one in RATE of the other keys pass; later levels one in two.
FIRST_RATE, RATE = 1 / 8, 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.substring_index(F.substring_index(tail, "?", 1), "#", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys ``suffix`` + path prefix of the given lengths, longest suffix first, longest prefix first."""
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths), reverse=True))), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes(host), lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


# ---------------------------------------------------------------- cascades


def _level_hashes(key: Column, level: int) -> list[Column]:
    """Two hashes of a key for a level, of 62 and 40 bits: neither they nor their sums overflow."""
    return [F.shiftrightunsigned(F.xxhash64(key, F.lit(2 * level)), 2), F.shiftrightunsigned(F.xxhash64(key, F.lit(2 * level + 1)), 24)]


def _positions(key: Column, level: int, k: int, bits: Column) -> Column:
    """The k bit positions of a key at a level, by double hashing."""
    a, b = _level_hashes(key, level)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (a + i.cast("long") * b) % bits)


def _filter(keys: DataFrame, level: int, rate: float) -> DataFrame:
    """(shard, level, k, bits, words) of the keys (key, shard); ``words`` has the set 64-bit words by number."""
    k = max(1, round(-math.log2(rate)))
    size = keys.groupBy("shard").agg(F.count("*").alias("n")).select("shard", (F.ceil(F.col("n") * (k / math.log(2)) / 64) * 64 + 64).cast("long").alias("bits"))
    set_bits = keys.join(size, "shard").select("shard", "bits", F.explode(_positions(F.col("key"), level, k, F.col("bits"))).alias("p"))
    words = set_bits.groupBy("shard", "bits", F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("value"))
    packed = words.groupBy("shard", "bits").agg(F.collect_list(F.struct("word", "value")).alias("words"))
    return packed.select("shard", F.lit(level).alias("level"), F.lit(k).alias("k"), "bits", "words")


class Cascade:
    """Filters by shard and level; ``levels`` is a small table of one row each."""

    def __init__(self, levels: DataFrame, depth: int, shards: int):
        self.levels, self.depth, self.shards = levels, depth, shards


def build(universe: DataFrame, listed: DataFrame, name: str = "cascade") -> Cascade:
    """A cascade of the keys of ``listed`` (key) that occur in ``universe`` (distinct key)."""
    listed = listed.select("key").distinct()
    n = listed.count()
    shards = max(1, -(-n // SHARD_KEYS))
    numbered = cut(universe.join(listed.withColumn("listed", F.lit(True)), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"), F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(shards)).cast("int").alias("shard")), name)
    inside, outside = numbered.where("listed"), numbered.where("not listed")
    levels, depth = None, 0
    while True:
        made = cut(_filter(inside, depth + 1, FIRST_RATE if depth == 0 else RATE), name)
        if made.limit(1).count() == 0:
            return Cascade(levels if levels is not None else made, depth, shards)
        levels = made if levels is None else levels.unionByName(made)
        depth += 1
        # what passes the new level wrongly is encoded by the next one
        passing = cut(_lookup(outside, made, [depth], "passes").where("passes").select("key", "shard"), name)
        inside, outside = passing, inside


def _load(rows: list) -> dict[tuple[int, int], tuple[int, int, np.ndarray]]:
    out = {}
    for r in rows:
        bits = np.zeros(r["bits"] // 64 + 1, np.uint64)
        if len(r["words"]):
            bits[[w["word"] for w in r["words"]]] = np.array([w["value"] for w in r["words"]], np.int64).view(np.uint64)
        out[r["shard"], r["level"]] = (r["k"], r["bits"], bits)
    return out


def _pass(filters: dict, shard: np.ndarray, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether keys, by their hashes, pass a level; a shard without that level lets none pass."""
    ok = np.zeros(len(shard), bool)
    for s in np.unique(shard):
        if (int(s), level) not in filters:
            continue
        at = np.flatnonzero(shard == s)
        k, bits, words = filters[int(s), level]
        good = np.ones(len(at), bool)
        for i in range(k):
            p = (a[at] + i * b[at]) % bits
            good &= (words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
        ok[at] = good
    return ok


def _fits(levels: DataFrame) -> bool:
    return (levels.agg(F.sum(F.col("bits") / 8)).first()[0] or 0) <= BROADCAST_BYTES


def _lookup(keys: DataFrame, levels: DataFrame, depths: list[int], result: str) -> DataFrame:
    """``keys`` (key, shard, ...) with a boolean: for one level, whether the key passes it; for a cascade, whether it is listed."""
    spark, names = keys.sparkSession, keys.columns
    hashed = keys.select("*", *(h.alias(f"__h{d}_{i}") for d in depths for i, h in enumerate(_level_hashes(F.col("key"), d))))
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields] + [f"{result} boolean"])

    def decide(frame: pd.DataFrame, filters: dict) -> pd.DataFrame:
        shard = frame["shard"].to_numpy()
        open_, out = np.ones(len(frame), bool), np.zeros(len(frame), bool)
        for no, d in enumerate(depths):
            ok = _pass(filters, shard, d, frame[f"__h{d}_0"].to_numpy(), frame[f"__h{d}_1"].to_numpy())
            out[open_ & ~ok] = no % 2 == 1
            open_ &= ok
        out[open_] = len(depths) % 2 == 1
        return frame[names].assign(**{result: out})

    if _fits(levels):
        # at most BROADCAST_BYTES of bits, checked above
        shared = spark.sparkContext.broadcast(_load(levels.collect()))

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield decide(f, shared.value)

        return hashed.mapInPandas(each, ddl)

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return decide(left, _load(right.to_dict("records")))

    # a shard's filter is small, but its keys are many: they are dealt out by shard and salt
    salts = 64
    salted = hashed.withColumn("__salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    spread = levels.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.groupBy("shard", "__salt").cogroup(spread.groupBy("shard", "__salt")).applyInPandas(both, ddl)


def member(keys: DataFrame, cascade: Cascade, result: str) -> DataFrame:
    """``keys`` (key, ...) of the universe, with whether each is listed."""
    if not cascade.depth:
        return keys.withColumn(result, F.lit(False))
    named = keys.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(cascade.shards)).cast("int"))
    return _lookup(named, cascade.levels, list(range(1, cascade.depth + 1)), result).drop("shard")


# ---------------------------------------------------------------- rules


def judge(pages: DataFrame, rules: DataFrame, blocked_hosts: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of ``pages`` (page_id, url).

    ``rules`` has host, path, verdict (allow or block); the longest that fits
    decides.  Without one, ``blocked_hosts`` (host) blocks its hosts and their
    subdomains, and everything else is allowed.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    keyed = rules.select(F.concat("host", "path").alias("key"), "verdict")
    # each distinct key once: rules' keys by suffix and prefix, hosts' keys by suffix
    sites = urls.groupBy("host", "path").agg(F.count("*").alias("n")).where(F.col("host") != "")
    universe = cut(sites.select(F.explode(candidates(F.col("host"), F.col("path"), lengths or [0])).alias("key")).distinct(), "keys")
    hosts = cut(sites.groupBy("host").agg(F.count("*").alias("n")).select(F.explode(suffixes(F.col("host"))).alias("key")).distinct(), "hosts")
    blocking = build(universe, keyed.where("verdict = 'block'"))
    allowing = build(universe, keyed.where("verdict = 'allow'"))
    listed = build(hosts, blocked_hosts.select(F.col("host").alias("key")))

    filters = []
    for c in (blocking, allowing, listed):
        if c.depth and not _fits(c.levels):
            return _judge_by_join(urls, universe, hosts, lengths, blocking, allowing, listed)
        filters.append((_load(c.levels.collect()) if c.depth else {}, c.depth, c.shards))
    shared = spark.sparkContext.broadcast(filters)
    most = max(c.depth for c in (blocking, allowing, listed))

    def hashes(keys: Column) -> Column:
        one = lambda k: F.array(F.xxhash64(k, F.lit(-1)), *(h for d in range(1, most + 1) for h in _level_hashes(k, d)))
        return F.flatten(F.transform(keys, one))

    wide = 2 * most + 1
    ready = urls.withColumn("__keys", candidates(F.col("host"), F.col("path"), lengths or [0])).withColumn("__hosts", suffixes(F.col("host")))
    ready = ready.select("page_id", "host", "path", "__keys", hashes(F.col("__keys")).alias("__a"), hashes(F.col("__hosts")).alias("__b"))
    key_type = ready.schema["page_id"].dataType.simpleString()

    def listed_in(which: int, table: np.ndarray) -> np.ndarray:
        found, depth, shards = shared.value[which]
        shard = np.mod(table[:, 0], shards)
        open_, out = np.ones(len(table), bool), np.zeros(len(table), bool)
        for d in range(1, depth + 1):
            ok = _pass(found, shard, d, table[:, 2 * d - 1], table[:, 2 * d])
            out[open_ & ~ok] = d % 2 == 0
            open_ &= ok
        out[open_] = depth % 2 == 1
        return out

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            flat = np.concatenate([np.asarray(x, np.int64) for x in f["__a"]] or [np.empty(0, np.int64)]).reshape(-1, wide)
            flat_hosts = np.concatenate([np.asarray(x, np.int64) for x in f["__b"]] or [np.empty(0, np.int64)]).reshape(-1, wide)
            block, allow, bad = listed_in(0, flat), listed_in(1, flat), listed_in(2, flat_hosts)
            rule, verdict, at, at_host = [], [], 0, 0
            for keys, hashed in zip(f["__keys"], f["__b"], strict=True):
                n, m = len(keys), len(hashed) // wide
                hits = [(len(keys[i]), keys[i], "allow" if allow[at + i] else "block") for i in range(n) if block[at + i] or allow[at + i]]
                best = max(hits, default=None)
                rule.append(best[1] if best else None)
                verdict.append(best[2] if best else "block" if bad[at_host : at_host + m].any() else "allow")
                at, at_host = at + n, at_host + m
            yield pd.DataFrame({"page_id": f["page_id"], "host": f["host"], "path": f["path"], "rule": rule, "verdict": verdict})

    return ready.mapInPandas(decide, f"page_id {key_type}, host string, path string, rule string, verdict string")


def _judge_by_join(urls: DataFrame, universe: DataFrame, hosts: DataFrame, lengths: list[int], blocking: Cascade, allowing: Cascade, listed: Cascade) -> DataFrame:
    """The same where the filters are too large to broadcast: keys are judged once each, then meet their URLs."""
    rules = member(member(universe, blocking, "block"), allowing, "allow").where("block or allow").select("key", F.when(F.col("allow"), "allow").otherwise("block").alias("v"))
    bad = member(hosts, listed, "bad").where("bad").select("key")
    sites = cut(urls.select("host", "path").distinct(), "sites")
    best = sites.select("host", "path", F.explode(candidates(F.col("host"), F.col("path"), lengths or [0])).alias("key")).join(rules, "key").groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "key", "v")).alias("b"))
    spoiled = sites.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("key")).join(bad, "key", "left_semi").select("host").distinct().withColumn("bad", F.lit(True))
    out = urls.join(best, ["host", "path"], "left").join(spoiled, "host", "left")
    return out.select("page_id", "host", "path", F.col("b.key").alias("rule"), F.coalesce(F.col("b.v"), F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
