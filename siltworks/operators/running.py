"""Running sums and ranks over a whole table, without an order in one task.

Rows go to ranges of the order with sampled bounds and are written with their
range's number; each range is summed in one task, and a table of one row a range
(and key) carries the sums of earlier ranges on.  A range holds about the
``shuffle.partitions``-th part of the rows whatever their values, as long as the
order tells rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept


def running_sums(df: DataFrame, order: list[Column], values: list[str], keys: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with ``<value>_upto``: each value's sum over the rows of the same ``keys`` up to and with this one.

    ``order`` tells all rows of a key apart, or gives rows that don't tell the
    same sum in any order.  A null value counts 0; null keys are a key.
    """
    keys = list(keys or [])
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = kept(df.repartitionByRange(n, *(F.col(k) for k in keys), *order).withColumn("__range", F.spark_partition_id()), "ranges")
    # one row a range and key: as many as ranges and keys together at most
    sums = placed.groupBy("__range", *keys).agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(f"__{v}") for v in values))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("__range", *keys, *(F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0)).alias(f"__{v}") for v in values))
    within = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.select("*", *(F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"{v}_upto") for v in values))
    if keys:
        other = carried.select(F.col("__range").alias("__r"), *(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)), *(f"__{v}" for v in values))
        on = F.col("__range") == F.col("__r")
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"__key{i}"))
        both = own.join(other, on)
    else:
        both = own.join(F.broadcast(carried), "__range")  # a row a range
    return both.select(*df.columns, *((F.col(f"{v}_upto") + F.col(f"__{v}")).alias(f"{v}_upto") for v in values))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's rank from 1 in ``order``, which tells all rows apart."""
    ranked = running_sums(df.withColumn("__one", F.lit(1).cast("long")), order, ["__one"])
    return ranked.withColumnRenamed("__one_upto", name).drop("__one")


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's rank from 1 among the rows of its ``keys``, however many of them one key has."""
    ranked = running_sums(df.withColumn("__one", F.lit(1).cast("long")), order, ["__one"], keys)
    return ranked.withColumnRenamed("__one_upto", name).drop("__one")


def draw(df: DataFrame, key: str, weight: str, n: int, seed: str, unit: float = 1e-6) -> DataFrame:
    """(``key``, copies) of the rows that ``n`` seeded draws with replacement hit, each in proportion to its weight.

    Weights are whole numbers of ``unit``.  Rows lie one after another by key on a
    line as long as their weights together; draws are points on it, drawn by the
    seed and their number, and a row has the draws between its ends.  Lines and
    draws meet in one running count of draws over the points of both, so no row
    is compared with draws that don't hit it.  Rows with a null or no positive
    weight, or a null key, are never drawn; keys are unique.
    """
    from ..functions.arrays import uniform

    spark = df.sparkSession
    units = F.bround(F.col(weight) / unit).cast("long")
    rows = df.select(F.col(key).alias("key"), units.alias("units")).where("key is not null and units > 0")
    line = kept(running_sums(rows, [F.col("key")], ["units"]), "line")
    total = line.agg(F.sum("units").alias("total"))
    ends = line.select("key", F.explode(F.array(F.struct(F.lit(-1).alias("sign"), (F.col("units_upto") - F.col("units")).alias("at")), F.struct(F.lit(1).alias("sign"), F.col("units_upto").alias("at")))).alias("end"))
    ends = ends.select("key", "end.sign", "end.at", F.lit(0).cast("long").alias("drawn"))
    points = spark.range(n).crossJoin(F.broadcast(total)).where("total > 0")  # a row of one number
    points = points.select(F.lit(None).cast(df.schema[key].dataType).alias("key"), F.lit(0).alias("sign"), F.floor(uniform(seed, F.col("id")) * F.col("total")).alias("at"), F.lit(1).cast("long").alias("drawn"))
    # an end counts the draws before it: at one place ends come first; draws at one place give the same counts in any order
    counted = running_sums(ends.unionByName(points), [F.col("at"), F.col("drawn"), F.col("key"), F.col("sign")], ["drawn"])
    copies = counted.where("sign <> 0").groupBy("key").agg(F.sum(F.col("sign") * F.col("drawn_upto")).alias("copies"))
    return copies.where("copies > 0").select(F.col("key").alias(key), "copies")
