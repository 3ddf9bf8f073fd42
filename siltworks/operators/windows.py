"""Sectioning and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sections(rows: DataFrame, key: str, order: str, header: str) -> DataFrame:
    """``section``: the number of header rows up to and with each row, by key; 0 before the first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.sum(F.col(header).cast("long")).over(w))


def first_n(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of each key."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).where(F.col("__rn") <= n).drop("__rn")


def top_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of all, with their rank from 1: a report of fixed length, so one task may number it."""
    best = df.orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def scraped_metric(lines: DataFrame, key: str, order: str, line: str, header: str, title: str, row: str, column: int) -> DataFrame:
    """(``key``, section, run, metric) of log lines: a section a header line, with the word after ``header`` as its run.

    The metric is the ``column``-th word of the first line that begins with ``row``
    after the section's last line that holds ``title`` (after its header, if there
    is none), as a number; sections without such a line have none.  Other lines are
    left out at first; what is left of a section meets in one task.
    """
    from .running import running_sums

    text = F.trim(F.col(line))
    head, titled = F.col(line).startswith(header), F.contains(F.col(line), F.lit(title))
    told = lines.withColumn("__head", head.cast("long")).where(head | titled | text.startswith(row))
    # headers are counted over ranges of the order, so no task holds a log
    marked = running_sums(told, [F.col(order)], ["__head"], [key]).withColumnRenamed("__head_upto", "section").where("section > 0")
    own = Window.partitionBy(key, "section")
    from_title = F.col(order) > F.coalesce(F.max(F.when(titled, F.col(order))).over(own), F.min(order).over(own))
    found = marked.withColumn("__hit", from_title & text.startswith(row))
    word = F.try_element_at(F.split(F.min_by(text, F.when(F.col("__hit"), F.col(order))), r"\s+"), F.lit(column))
    run = F.max(F.when(F.col("__head") == 1, F.element_at(F.split(F.trim(F.substring(line, len(header) + 1, 1 << 20)), r"\s+"), 1)))
    return found.groupBy(key, "section").agg(run.alias("run"), word.try_cast("double").alias("metric")).where("metric is not null")
