"""Dedup, sampling and leakage-free splits; every order is by a seeded digest, so partitioning changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import seeded, uniform
from ..sources.tables import kept
from .running import draw, global_rank, rank_within


def group_cap(df: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """At most ``n`` rows of each group."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(seeded(seed, F.col(key)), key))
    return df.withColumn("__rn", rn).where(F.col("__rn") <= n).drop("__rn")


def proportional_sample(df: DataFrame, stratum: str, key: str, target: int, seed: str) -> DataFrame:
    """Each stratum's share of ``target``, at least one row; all rows where there are no more than that."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("__n"))
    total = df.agg(F.count("*").alias("__total"))
    quota = sizes.crossJoin(F.broadcast(total)).select(F.col(stratum).alias("__of"), F.when(F.col("__total") <= target, F.col("__n")).otherwise(F.greatest(F.lit(1), F.bround(target * F.col("__n") / F.col("__total")))).alias("__quota"))
    ranked = rank_within(df.withColumn("__digest", seeded(seed, F.col(key))), [stratum], [F.col("__digest"), F.col(key)], "__rn")
    return ranked.join(quota, F.col(stratum).eqNullSafe(F.col("__of"))).where("__rn <= __quota").select(*df.columns)


def quota_sample(df: DataFrame, key: str, tags: str, part: str, least: int, budget: int, seed: str, forced: Column | None = None, shares: dict[str, float] | None = None, by_part: bool = True) -> DataFrame:
    """By part: forced rows, then each tag, rarest first, filled to ``least`` counting what is in already, then others to ``budget``; drawn by digest.

    A part's ``least`` and ``budget`` are scaled by its share, rounded half to
    even; parts without a share have none.  Tags are ranked by how many rows of
    the part have them, ties by name, or over all parts if ``by_part`` is false.
    Parts and tags are short lists.  What each step takes is the rows below one
    digest a part: counts of digest heads find the head in which the quota is
    reached, and only that head's rows are ordered, so no task holds a part.
    Keys are unique.
    """
    named = df.withColumns({"__part": F.col(part), "__tags": F.coalesce(F.col(tags), F.array().cast("array<string>")), "__forced": F.coalesce(forced if forced is not None else F.lit(False), F.lit(False)), "__digest": seeded(seed, F.col(key))})
    base = kept(named.select("__part", "__tags", "__forced", "__digest", F.substring("__digest", 1, 4).alias("__head")), "quota")
    counts = {(r[0], r[1]): r[2] for r in base.select("__part", F.explode("__tags").alias("tag")).groupBy("__part", "tag").count().collect()}  # a row a part and tag
    parts = [r[0] for r in base.select("__part").distinct().collect()]
    every = {t for _, t in counts}
    rarity = lambda p, t: counts.get((p, t), 0) if by_part else sum(counts.get((q, t), 0) for q in parts)
    order = {p: sorted(every, key=lambda t: (rarity(p, t), t)) for p in parts}  # noqa: B023
    steps: dict[object, list[tuple[str | None, str]]] = {p: [] for p in parts}

    def of_part(values: dict[object, object], kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for p, v in values.items():
            out = F.when(F.col("__part").eqNullSafe(F.lit(p)), F.lit(v).cast(kind)).otherwise(out)
        return out

    def taken() -> Column:
        """Whether a row is in after the steps so far: forced, or with a step's tag and at most its digest."""
        out = F.col("__forced")
        for p, bounds in steps.items():
            for t, digest in bounds:
                has = F.lit(True) if t is None else F.array_contains("__tags", t)
                out = out | (F.col("__part").eqNullSafe(F.lit(p)) & has & (F.col("__digest") <= digest))
        return out

    def step(tag_of: dict[object, str | None], want: dict[object, int]) -> None:
        """Add to each part the bound that fills its tag (None: any row) up to what is wanted."""
        any_row = all(t is None for t in tag_of.values())
        rows = base.withColumn("__in", taken()).where(F.lit(True) if any_row else F.array_contains("__tags", of_part(tag_of, "string")))
        needs = {r[0]: max(0, want[r[0]] - r[1]) for r in rows.groupBy("__part").agg(F.count_if("__in")).collect()}
        heads = rows.where(~F.col("__in")).groupBy("__part", "__head").agg(F.count("*").alias("n"))
        earlier = Window.partitionBy("__part").orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 heads at most
        heads = heads.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("need", of_part(needs, "long"))
        edge = {r[0]: (r[1], r[2]) for r in heads.where("before < need and before + n >= need").select("__part", "__head", F.col("need") - F.col("before")).collect()}
        inside = rows.where(~F.col("__in") & (F.col("__head") == of_part({p: e[0] for p, e in edge.items()}, "string")))
        at = F.row_number().over(Window.partitionBy("__part").orderBy("__digest"))
        last = inside.select("__part", "__digest", at.alias("at")).where(F.col("at") == of_part({p: e[1] for p, e in edge.items()}, "long"))
        found = {r[0]: r[1] for r in last.select("__part", "__digest").collect()}
        for p in parts:
            if needs.get(p):
                steps[p].append((tag_of[p], found.get(p, "g")))  # "g" is above all digests: there are too few rows

    share = {p: 1.0 if shares is None else shares.get(p, 0.0) for p in parts}
    for k in range(len(every)):
        step({p: order[p][k] for p in parts}, {p: round(least * share[p]) for p in parts})
    step(dict.fromkeys(parts), {p: round(budget * share[p]) for p in parts})
    return named.where(taken()).select(*df.columns)


def part_of(u: Column, fractions: dict[str, float]) -> Column:
    """The part whose share of [0, 1) holds ``u``; the last one takes what is left."""
    names, at, out = list(fractions), 0.0, None
    for n in names[:-1]:
        at += fractions[n]
        out = F.when(u < at, n) if out is None else out.when(u < at, n)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[-1])


def group_split(group: Column, fractions: dict[str, float], seed: str) -> Column:
    """The part of a whole group."""
    return part_of(uniform(seed, group), fractions)


def temporal_split(ts: Column, first: str, second: str) -> Column:
    return F.when(ts < F.lit(first).cast("timestamp"), "train").when(ts < F.lit(second).cast("timestamp"), "val").otherwise("test")


def stratified_split(df: DataFrame, stratum: str, key: str, share: float, seed: str) -> DataFrame:
    """Per class ``floor(n * share)`` rows for test, as many for val, the rest train."""
    sizes = df.groupBy(F.col(stratum).alias("__of")).agg(F.floor(F.count("*") * share).alias("__n"))
    ranked = rank_within(df.withColumn("__digest", seeded(seed, F.col(key))), [stratum], [F.col("__digest"), F.col(key)], "__rn")
    rows = ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("__of")))
    return rows.select(*df.columns, F.when(F.col("__rn") <= F.col("__n"), "test").when(F.col("__rn") <= 2 * F.col("__n"), "val").otherwise("train").alias("part"))


def leaks(df: DataFrame, group: str, part: str) -> DataFrame:
    """Groups in more than one part; must be empty."""
    return df.groupBy(group).agg(F.count_distinct(part).alias("n_parts")).where("n_parts > 1")


def fingerprint(df: DataFrame, key: str) -> DataFrame:
    """Order-free: count, xor and wrapped sum of key hashes, by partial aggregates of fixed size."""
    h = F.xxhash64(F.col(key).cast("string"))
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum"))


#: Keys up to which one level of blocks is enough: each then holds some 16,000 ids.
ONE_LEVEL = 1 << 26


def ordered_fingerprint(df: DataFrame, key: str) -> DataFrame:
    """SHA-256 over sorted digests of 4096 blocks of keys, each over its sorted ids: no task holds all of them.

    Beyond ``ONE_LEVEL`` keys a block is the sorted digests of 4096 blocks of its
    own, and so on, so that a row never gathers more than some 16,000 values.
    """
    n, digits = df.count(), 3
    while n > ONE_LEVEL * 16 ** (digits - 3):
        digits += 3
    block = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, digits)
    joined = lambda c: F.sha2(F.array_join(c, "\n"), 256).alias("h")
    parts = df.groupBy(block.alias("block")).agg(joined(F.array_sort(F.collect_list(F.col(key).cast("string")))))
    while digits:
        digits -= 3
        rows = parts.groupBy(F.substring("block", 1, digits).alias("up")) if digits else parts.groupBy()
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda s: s["h"])
        parts = rows.agg(joined(in_order)).select(*([F.col("up").alias("block")] if digits else []), "h")
    return parts.select(F.col("h").alias("fingerprint"))


def standardise(df: DataFrame, fit_on: Column, *names: str) -> DataFrame:
    """Columns scaled by mean and deviation over the rows of ``fit_on``; null stays 0."""
    stats = df.where(fit_on).agg(*(F.avg(c).alias(f"__m_{c}") for c in names), *((F.stddev_pop(c) + 1e-6).alias(f"__s_{c}") for c in names))
    out = df.crossJoin(F.broadcast(stats))
    return out.select(*(F.coalesce((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}"), F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns))


def standardise_vectors(df: DataFrame, fit_on: Column, vector: str) -> DataFrame:
    """The same for an array column, by position."""
    flat = df.where(fit_on & F.col(vector).isNotNull()).select(F.posexplode(vector).alias("i", "x"))
    stats = flat.groupBy("i").agg(F.avg("x").alias("m"), (F.stddev_pop("x") + 1e-6).alias("s"))
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("__st"))
    scaled = F.transform(F.arrays_zip(F.col(vector).alias("x"), F.col("__st").alias("st")), lambda z: (z["x"] - z["st"]["m"]) / z["st"]["s"])
    return df.crossJoin(F.broadcast(packed)).withColumn(vector, F.when(F.col(vector).isNotNull(), scaled)).drop("__st")


def sampler_weights(df: DataFrame, key: str, label: str, tags: str, untagged: float = 0.1) -> DataFrame:
    """Inverse tag frequency, mean over a row's tags; negatives 1; positives scaled so that both classes weigh the same."""
    t = df.select(key, F.explode(tags).alias("tag"))
    freq = t.groupBy("tag").agg(F.count("*").alias("n"))
    raw = t.join(freq, "tag").groupBy(key).agg(F.avg(1 / F.col("n")).alias("w"))
    w = F.when(F.col(label) == 0, 1.0).otherwise(F.coalesce("w", F.lit(untagged)))
    rows = df.select(key, label).join(raw, key, "left").select(key, label, w.alias("w"))
    sums = rows.agg(F.sum(F.when(F.col(label) == 0, F.col("w"))).alias("__neg"), F.sum(F.when(F.col(label) == 1, F.col("w"))).alias("__pos"))
    return rows.crossJoin(F.broadcast(sums)).select(key, label, F.when(F.col(label) == 1, F.col("w") * F.col("__neg") / F.col("__pos")).otherwise(F.col("w")).alias("weight"))


def weighted_resample(df: DataFrame, key: str, weight: str, n: int, seed: str) -> DataFrame:
    """``df`` with ``copies`` of the rows that ``n`` seeded draws with replacement hit, in proportion to ``weight`` (in millionths); keys are unique."""
    return df.join(draw(df, key, weight, n, seed), key)


def size_batches(df: DataFrame, size: str, key: str, n: int, seed: str) -> DataFrame:
    """Rows sorted by size in blocks of ``n``; a block's padded size and its place in the seeded order of blocks."""
    rows = global_rank(df, [F.col(size), F.col(key)], "rank").withColumn("block", F.floor((F.col("rank") - 1) / n).cast("long"))
    blocks = rows.groupBy("block").agg(F.count("*").alias("n"), F.max(size).alias("padded"))
    return blocks.withColumn("order", seeded(seed, F.col("block")))


def version_key(version: Column) -> Column:
    """A sortable text: components by dots, dashes and pluses, numbers padded and before words."""
    return F.array_join(F.transform(F.split(version, "[.+-]"), lambda c: F.when(c.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(c, 12, "0"))).otherwise(F.concat(F.lit("1"), c))), ".")
