"""A corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage reads the Parquet table that its predecessor wrote; all but the last
return the columns of documents.

Cases: a null or empty text fails the base rules and goes in the first stage; a
null lang or source is a value like others; rows of a null ``doc_id`` are judged
by their text alone, neither lose lines nor are near copies of others, and stay
null; rows of one ``doc_id`` are one document to the near-duplicate stage, which
keeps the first by text; an empty table gives an empty one; further columns, of
whatever name, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltworks.llm import decontaminate, jaccard_join, line_dedup, mcd_quality, packing
from siltworks.llm.common import cut
from siltworks.llm.queries import END_ID, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or are outliers of their language and source."""
    return mcd_quality.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that a similar earlier line replaces; a document that loses all of them goes."""
    return line_dedup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return jaccard_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, as pieces of documents."""
    return packing.pack(docs, vocabulary(), END_ID)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminated), ("packing", packed)]

#: The quality verdict is an iterative estimate, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
