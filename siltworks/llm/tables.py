"""Scratch tables in the shared folder that are dropped once a later one replaces them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import scratch


class Tables:
    """Named tables below one new folder of ``spark.checkpoint.dir``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, scratch(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: a lineage cut that outlives executors."""
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
