"""Evaluation records of runs, read from their folders, and report tables over them.

A cell is (section, row, label, col, shown): the text of one place of one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CELLS = ["section", "row", "label", "col", "shown"]


def read_records(spark: SparkSession, pattern: str) -> DataFrame:
    """(name, seed, record) of JSON files, one a run; a run's name and seed come from its folders ``<name>/seed<k>`` (or ``name=``, ``seed=``)."""
    df = spark.read.text(pattern, wholetext=True).select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("path"))
    part = lambda k: F.regexp_extract("path", r"/(?:name=)?([^/]+)/seed=?([0-9]+)/[^/]+$", k)
    return df.where(part(2) != "").select(F.url_decode(part(1)).alias("name"), part(2).cast("long").alias("seed"), "record")


def path_of(*keys: str) -> str:
    """A JSON path whose keys may hold any character but a quote."""
    return "$" + "".join(f"['{k}']" for k in keys)


def field(record: Column, path: Column | str) -> Column:
    """A record's value as text; null where any part of the path is missing."""
    return F.call_function("get_json_object", record, F.lit(path) if isinstance(path, str) else path)


def _finite(text: Column) -> Column:
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def mean_text(value: Column) -> Column:
    """Mean and population deviation as text: no deviation of one value, a dash for none; missing and non-finite values don't count."""
    m, s, n = F.avg(value), F.stddev_pop(value), F.count(value)
    return F.when(n == 0, "-").when(n == 1, F.format_string("%.4f", m)).otherwise(F.concat(F.format_string("%.4f", m), F.lit(" ± "), F.format_string("%.4f", s)))


def measured(records: DataFrame, spec: list[tuple[str, int, str, str, int, str]]) -> DataFrame:
    """Cells over the seeds of named runs, by a short list of (section, row, label, name, col, path); runs that aren't there have no row."""
    wanted = records.sparkSession.createDataFrame(spec, "section string, row int, label string, of string, col int, path string")
    hit = records.join(F.broadcast(wanted), F.col("name") == F.col("of"))  # the report's own layout
    return hit.groupBy("section", "row", "label", "col").agg(mean_text(_finite(field(F.col("record"), F.col("path")))).alias("shown"))


def by_run(records: DataFrame, section: str, paths: list[str], skip: str) -> DataFrame:
    """Cells of a row a run, by name, without those whose name starts with ``skip``: its seeds, then each path's mean."""
    kept = records.where(~F.col("name").startswith(skip))
    rows = kept.groupBy("name").agg(F.count("*").cast("string").alias("c0"), *(mean_text(_finite(field(F.col("record"), p))).alias(f"c{i + 1}") for i, p in enumerate(paths)))
    numbered = rows.withColumn("row", F.row_number().over(Window.orderBy("name")) - 1)  # a row a run
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("col"), F.col(f"c{i}").alias("shown")) for i in range(len(paths) + 1))))
    return numbered.select("row", F.col("name").alias("label"), cells.alias("c")).select(F.lit(section).alias("section"), "row", "label", "c.col", "c.shown")


def keyed(records: DataFrame, section: str, name: str, seed: int, path: tuple[str, ...], fields: dict[str, str], prefix: str = "") -> DataFrame:
    """Cells of one run's nested object: a row for each key that starts with ``prefix``, as the record orders them; ``fields`` are (name, format), lists joined by commas."""
    one = records.where((F.col("name") == name) & (F.col("seed") == seed)).select(field(F.col("record"), path_of(*path)).alias("object"))
    keys = F.filter(F.json_object_keys("object"), lambda k: k.startswith(prefix))
    rows = one.select("object", F.posexplode(keys).alias("row", "label"))

    def shown(name: str, form: str) -> Column:
        value = field(F.col("object"), F.concat(F.lit("$['"), F.col("label"), F.lit(f"']['{name}']")))
        many = F.array_join(F.transform(F.from_json(value, "array<double>"), lambda x: F.format_string(form, x)), ", ")
        single = F.format_string(form, value.cast("bigint" if form == "%d" else "double"))
        return F.when(value.isNull(), "-").when(value.startswith("["), many).otherwise(single)

    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("col"), shown(n, f).alias("shown")) for i, (n, f) in enumerate(fields.items()))))
    return rows.select("row", "label", cells.alias("c")).select(F.lit(section).alias("section"), "row", "label", "c.col", "c.shown")


def markdown(cells: DataFrame, headers: dict[str, list[str]]) -> DataFrame:
    """(no, line): the tables of ``headers`` in that order, each with its section's name, header and rows."""
    spark = cells.sparkSession
    rows = cells.groupBy("section", "row", "label").agg(F.array_sort(F.collect_list(F.struct("col", "shown"))).alias("c"))
    line = F.concat(F.lit("| "), F.array_join(F.concat(F.array("label"), F.transform("c", lambda x: x["shown"])), " | "), F.lit(" |"))
    place = F.lit(None).cast("long")
    for k, s in enumerate(headers):
        place = F.when(F.col("section") == s, F.lit(k).cast("long")).otherwise(place)
    body = rows.select((place * 1_000_000 + 10 + F.col("row")).alias("no"), line.alias("line")).where("no is not null")
    heads = [(k * 1_000_000 + i, t) for k, (s, h) in enumerate(headers.items()) for i, t in enumerate((f"## {s}", "", "| " + " | ".join(h) + " |", "|" + "---|" * len(h)))]
    return body.unionByName(spark.createDataFrame(heads, "no long, line string"))


def write_markdown(lines: DataFrame, path: str) -> None:
    """The lines as one text file: a report's length, not the data's."""
    lines.coalesce(1).sortWithinPartitions("no").select("line").write.text(path)
