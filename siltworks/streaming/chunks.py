"""Resumable chunk work as Structured Streaming over file sources, drained with ``availableNow``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def drain(stream: DataFrame, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process what is there, once, and stop; each micro-batch overwrites its own folder, so a repeat after a crash changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (work(batch) if work else batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_drained(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch")


def source(spark: SparkSession, path: str, schema: str, files: int = 8) -> DataFrame:
    """Parquet files of a folder as they come, a bounded number a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def gate(batch: DataFrame, share: float) -> DataFrame:
    """Rows of a micro-batch's chunks that pass the acceptance gate."""
    from ..operators.account import gate_chunks

    return gate_chunks(batch, share)


def first_seen(stream: DataFrame, key: str, time: str, horizon: str) -> DataFrame:
    """The first row of each key within ``horizon`` of event time; the bound on state is ours, older repeats pass."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def features(batch: DataFrame) -> DataFrame:
    """A stage's work on a chunk: scaled size and the digest of the id."""
    return batch.withColumn("log_detections", F.round(F.log1p("detections"), 6)).withColumn("digest", F.sha2(F.col("sample_id").cast("string"), 256))


def gate_with_progress(stream: DataFrame, sizes: DataFrame, share: float, out: str, checkpoint: str) -> None:
    """Judge chunks that come in pieces: a state by chunk holds what has come of it, over all micro-batches.

    ``sizes`` is (chunk, size), the rows that a chunk has in all.  Each micro-batch
    writes the chunks that it changed, as they stand then, with ``done`` once a chunk
    is whole and ``passed`` where it also passes the gate; a repeat after a crash
    overwrites the same folder.  The state is a row of four numbers a chunk.
    """
    held = stream.groupBy("chunk").agg(F.count("*").alias("n"), F.count_if("ok_pe").alias("p"), F.count_if("ok_ember").alias("e"), F.sum("secs").alias("secs"))

    def write(batch: DataFrame, batch_id: int) -> None:
        whole = F.col("n") >= F.col("size")
        good = ~((F.col("p") > 0) & (F.col("e") < share * F.col("p")))
        known = batch.join(sizes, "chunk", "left").withColumns({"done": F.coalesce(whole, F.lit(False)), "passed": F.coalesce(whole & good, F.lit(False))})
        known.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    held.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def updates(spark: SparkSession, out: str) -> DataFrame:
    """(batch, chunk, n, p, e, secs, size, done, passed) as the micro-batches wrote them."""
    return spark.read.parquet(out).withColumn("batch", F.col("batch").cast("long"))


def verdicts(written: DataFrame) -> DataFrame:
    """(chunk, batch, passed): each whole chunk once, with the micro-batch that made it whole."""
    return written.where("done").groupBy("chunk").agg(F.min("batch").alias("batch"), F.min_by("passed", "batch").alias("passed"))


def progress(written: DataFrame) -> DataFrame:
    """(batch, chunks, done, passed, rows, secs): how far the work is after each micro-batch.

    A chunk adds to a batch what has changed since the one before that touched it; sums
    run over the batches, which are few.
    """
    before = Window.partitionBy("chunk").orderBy("batch")
    was = lambda c: F.coalesce(F.lag(F.col(c).cast("double" if c == "secs" else "long")).over(before), F.lit(0))
    steps = written.select("batch", F.when(F.lag("chunk").over(before).isNull(), 1).otherwise(0).alias("chunks"), *((F.col(c).cast("double" if c == "secs" else "long") - was(c)).alias(f) for c, f in (("done", "done"), ("passed", "passed"), ("n", "rows"), ("secs", "secs"))))
    names = ["chunks", "done", "passed", "rows", "secs"]
    by_batch = steps.groupBy("batch").agg(*(F.sum(c).alias(c) for c in names))
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # a row a micro-batch
    return by_batch.select("batch", *(F.sum(c).over(upto).alias(c) for c in names))
