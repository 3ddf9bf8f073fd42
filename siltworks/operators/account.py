"""Coverage, progress and balance as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dot, unit


def coverage(df: DataFrame, experts: list[str], subsets: dict[str, Column]) -> DataFrame:
    """Rate of non-null values of each expert's column, over named subsets; one pass, one row an expert."""
    pairs = F.explode(F.array(*(F.struct(F.lit(e).alias("expert"), F.col(e).isNotNull().cast("int").alias("m")) for e in experts)))
    flat = df.select(*(s.alias(f"__{n}") for n, s in subsets.items()), pairs.alias("p")).select("*", "p.*")
    return flat.groupBy("expert").agg(*(F.round(F.avg(F.when(F.col(f"__{n}"), F.col("m"))), 6).alias(n) for n in subsets))


def gate_chunks(rows: DataFrame, share: float) -> DataFrame:
    """Rows of chunks that pass: enough of the parsed files (ok_pe) have features (ok_ember)."""
    ok, full = F.count_if("ok_pe"), F.count_if("ok_ember")
    good = rows.groupBy("chunk").agg(ok.alias("p"), full.alias("e")).where(~((F.col("p") > 0) & (F.col("e") < share * F.col("p")))).select("chunk")
    return rows.join(good, "chunk", "left_semi")


def progress(rows: DataFrame, done: Column, chunk_size: int) -> DataFrame:
    """Chunks in all, done and left, and the CPU hours that the rest will take."""
    by_chunk = rows.withColumn("__done", done).groupBy("chunk", "__done").agg(F.sum("secs").alias("s"), F.count("*").alias("n"))
    secs = F.sum(F.when(F.col("__done"), F.col("s"))) / F.sum(F.when(F.col("__done"), F.col("n")))
    left = F.count_if(~F.col("__done"))
    return by_chunk.agg(F.count("*").alias("total"), F.count_if("__done").alias("done"), left.alias("left_"), F.round(left * chunk_size * secs / 3600, 6).alias("cpu_hours"))


def mean_pool(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, mean): the mean vector by key; partial sums by position combine before the shuffle."""
    flat = df.select(key, F.posexplode(vector).alias("i", "x"))
    return flat.groupBy(key, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))


def load_balance(df: DataFrame, p: str, mask: str, n: int) -> DataFrame:
    """Squared distance of the mean gate to the mean availability, normalised."""
    m = df.agg(*(F.avg(F.col(p)[k]).alias(f"p{k}") for k in range(n)), *(F.avg(F.col(mask)[k]).alias(f"m{k}") for k in range(n)))
    total = reduce(lambda a, b: a + b, (F.col(f"m{k}") for k in range(n)))
    return m.select(F.round(reduce(lambda a, b: a + b, (F.pow(F.col(f"p{k}") - F.col(f"m{k}") / total, 2) for k in range(n))), 6).alias("penalty"))


def mean_std(df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Mean and population deviation, also as text: no deviation of a single value, a dash for none."""
    m, s, n = F.avg(metric), F.stddev_pop(metric), F.count(metric)
    shown = F.when(n == 0, "-").when(n == 1, F.format_string("%.4f", m)).otherwise(F.concat(F.format_string("%.4f", m), F.lit(" ± "), F.format_string("%.4f", s)))
    return df.groupBy(*keys).agg(n.alias("n"), F.round(m, 4).alias("mean"), F.round(s, 4).alias("std"), shown.alias("shown"))


def best_of(*names: str) -> Column:
    """The first column that has the greatest value."""
    best = F.greatest(*names)
    return reduce(lambda a, n: a.when(F.col(n) == best, n), names[1:], F.when(F.col(names[0]) == best, names[0]))


def infonce(df: DataFrame, batch: str, key: str, vector: str, tags: str, temperature: float, label: str | None = None) -> DataFrame:
    """Multi-label contrastive loss by batch; anchors without a partner count not. Batches are of fixed size.

    With ``label``, rows where it is 0 are partners of each other too.
    """
    v = df.select(batch, key, unit(F.col(vector)).alias("u"), tags, (F.lit(False) if label is None else F.col(label) == 0).alias("clean"))
    other = v.select(batch, F.col(key).alias("__k"), F.col("u").alias("__u"), F.col(tags).alias("__t"), F.col("clean").alias("__clean"))
    pairs = v.join(other, batch).where(F.col(key) != F.col("__k")).select(batch, key, F.exp(dot(F.col("u"), F.col("__u")) / temperature).alias("e"), (F.arrays_overlap(tags, "__t") | (F.col("clean") & F.col("__clean"))).alias("pos"))
    sums = pairs.groupBy(batch, key).agg(F.sum("e").alias("den"), F.sum(F.when(F.col("pos"), F.col("e"))).alias("num")).where("num is not null")
    return sums.groupBy(batch).agg(F.count("*").alias("anchors"), F.round(F.avg(-F.log(F.col("num") / F.col("den"))), 6).alias("loss"))


def anchor_rate(df: DataFrame, key: str, tags: str) -> DataFrame:
    """Share of rows with a partner, from tag counts: no pairs are made."""
    t = df.select(key, F.explode(tags).alias("tag"))
    shared = t.groupBy("tag").agg(F.count("*").alias("n")).where("n > 1").select("tag")
    good = t.join(shared, "tag", "left_semi").select(key).distinct().withColumn("__ok", F.lit(1))
    return df.select(key).join(good, key, "left").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("__ok", F.lit(0))), 6).alias("rate"))
