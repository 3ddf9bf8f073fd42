"""Sources and sinks of a corpus: manifests, id lists, binaries, chunked output."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import seeded


def read_columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Only the named columns of a Parquet dataset; the scan reads no others."""
    return spark.read.parquet(path).select(*names)


def with_required(df: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """The required columns, which must be there, and those optional ones that are."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*required, *(c for c in optional if c in df.columns))


def read_indexes(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """CSV index files as one table; ``source`` is a file's stem up to the first underscore."""
    df = spark.read.schema(schema).option("header", True).csv(pattern)
    return df.withColumn("source", F.regexp_extract(F.input_file_name(), r"([^/_]+)(?:_[^/]*)?\.csv", 1))


def union_indexes(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Sources by name as one table, keys lower-cased, the first source of a key kept (by name)."""
    all_rows = None
    for source, df in sorted(parts.items()):
        part = df.withColumn(key, F.lower(F.trim(key))).withColumn("source", F.lit(source))
        all_rows = part if all_rows is None else all_rows.unionByName(part, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(key).orderBy("source"))
    return all_rows.withColumn("__rn", first).where("__rn = 1").drop("__rn")


def ordered_union(lists: list[DataFrame], key: str) -> DataFrame:
    """Ids of several lists, trimmed and lower-cased, each with the first list that has it."""
    tagged = [df.select(F.lower(F.trim(F.col(key).cast("string"))).alias("id"), F.lit(i).cast("long").alias("list")) for i, df in enumerate(lists)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy("id").agg(F.min("list").alias("first_list"))


def numbered(df: DataFrame, seed: str, key: str, name: str) -> DataFrame:
    """Rows numbered from 0 in seeded order, without bringing them together.

    Rows are range-partitioned by their digest's head, numbered within each head and
    shifted by the heads before: the only global step is over a few thousand counts.
    """
    digest = seeded(seed, F.col(key))
    rows = df.withColumn("__digest", digest).withColumn("__head", F.substring("__digest", 1, 3))
    sizes = rows.groupBy("__head").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__head")) - F.col("__n")).select("__head", "__before")
    own = F.row_number().over(Window.partitionBy("__head").orderBy("__digest", key)) - 1
    return rows.withColumn("__own", own).join(F.broadcast(before), "__head").withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__digest", "__head", "__own", "__before")


def write_chunks(df: DataFrame, path: str, chunk: str = "chunk") -> None:
    """One directory of zstd Parquet a chunk."""
    df.repartition(chunk).write.option("compression", "zstd").partitionBy(chunk).parquet(path)


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Write as zstd Parquet and read back."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def round_trip_as(df: DataFrame, path: str, kind: str) -> DataFrame:
    """Write as ``parquet``, ``json`` or ``csv`` (zstd where the format allows it) and read back with the same schema."""
    out = df.write.mode("overwrite")
    if kind == "csv":
        out.option("header", True).csv(path)
        return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)
    out.format(kind).option("compression", "zstd" if kind == "parquet" else "gzip").save(path)
    return df.sparkSession.read.schema(df.schema).format(kind).load(path)


def inflate(df: DataFrame, column: str = "content") -> DataFrame:
    """zlib-compressed values inflated; others as they are."""

    def one(x: bytes | None) -> bytes | None:
        try:
            return None if x is None else zlib.decompress(x)
        except zlib.error:
            return x

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{column: f[column].map(one)})

    return df.mapInPandas(run, df.schema)


def ingest(df: DataFrame, magic: bytes, column: str = "content") -> DataFrame:
    """Files that start with ``magic``: their SHA-256 and size."""
    head = F.substring(F.col(column), 1, len(magic))
    return df.where(head == F.lit(bytearray(magic))).withColumn("sha256", F.sha2(column, 256)).withColumn("size", F.octet_length(column).cast("long")).drop(column)


def ingest_files(spark: SparkSession, pattern: str, magic: bytes) -> DataFrame:
    """:func:`ingest` of files, inflated where compressed."""
    return ingest(inflate(spark.read.format("binaryFile").load(pattern).select("path", "content")), magic)
