import json

from pyspark.sql import functions as F

from siltworks.operators import report as R
from siltworks.sources import manifest
from siltworks.streaming import chunks as T


def write(root, name, seed, record):
    path = root / name / f"seed{seed}"
    path.mkdir(parents=True)
    (path / "eval.json").write_text(record if isinstance(record, str) else json.dumps(record, indent=1))


def test_records_of_folders_and_tables(spark, tmp_path):
    for seed, x in ((42, 0.5), (43, 0.7)):
        write(tmp_path, "full run", seed, {"d": {"acc": x, "tpr@fpr=0.01": 0.25}, "triage": {"auroc": 0.5, "cov=1": {"n": 10, "acc": x}, "cov=0.9": {"n": 9, "g": [0.5, 0.26]}}})
    write(tmp_path, "bare", 42, {"d": {"acc": None, "tpr@fpr=0.01": "NaN"}})
    write(tmp_path, "sweep1", 1, {"d": {"acc": 1.0}})
    write(tmp_path, "broken", 42, "{not json")
    (tmp_path / "full run" / "seed42" / "log.json").write_text("{}")
    records = R.read_records(spark, f"{tmp_path}/*/seed*/eval.json")
    assert {(r.name, r.seed) for r in records.collect()} == {("full run", 42), ("full run", 43), ("bare", 42), ("sweep1", 1), ("broken", 42)}

    acc, tpr = R.path_of("d", "acc"), R.path_of("d", "tpr@fpr=0.01")
    spec = [("D", 0, "Full", "full run", 0, acc), ("D", 0, "Full", "full run", 1, tpr), ("D", 1, "Bare", "bare", 0, acc), ("D", 1, "Bare", "bare", 1, tpr), ("D", 2, "None", "none", 0, acc)]
    cells = R.measured(records, spec)
    assert {(r.label, r.col): r.shown for r in cells.collect()} == {("Full", 0): "0.6000 ± 0.1000", ("Full", 1): "0.2500 ± 0.0000", ("Bare", 0): "-", ("Bare", 1): "-"}
    runs = R.by_run(records, "A", [acc], "sweep")
    assert sorted((r.row, r.label, r.col, r.shown) for r in runs.collect()) == [(0, "bare", 0, "1"), (0, "bare", 1, "-"), (1, "broken", 0, "1"), (1, "broken", 1, "-"), (2, "full run", 0, "2"), (2, "full run", 1, "0.6000 ± 0.1000")]
    triage = R.keyed(records, "T", "full run", 42, ("triage",), {"n": "%d", "acc": "%.2f", "g": "%.1f"}, "cov=")
    assert sorted((r.row, r.label, r.col, r.shown) for r in triage.collect()) == [(0, "cov=1", 0, "10"), (0, "cov=1", 1, "0.50"), (0, "cov=1", 2, "-"), (1, "cov=0.9", 0, "9"), (1, "cov=0.9", 1, "-"), (1, "cov=0.9", 2, "0.5, 0.3")]
    assert R.keyed(records, "T", "bare", 42, ("triage",), {"n": "%d"}).count() == 0

    lines = R.markdown(cells.unionByName(runs), {"D": ["Model", "acc", "tpr"], "A": ["Run", "seeds", "acc"]})
    R.write_markdown(lines, f"{tmp_path}/report")
    text = "".join(p.read_text() for p in (tmp_path / "report").glob("part-*"))
    assert text.splitlines() == ["## D", "", "| Model | acc | tpr |", "|---|---|---|", "| Full | 0.6000 ± 0.1000 | 0.2500 ± 0.0000 |", "| Bare | - | - |", "## A", "", "| Run | seeds | acc |", "|---|---|---|", "| bare | 1 | - |", "| broken | 1 | - |", "| full run | 2 | 0.6000 ± 0.1000 |"]


def test_a_chunk_in_two_batches_is_judged_once(spark, tmp_path):
    """Chunk 1 comes in two files, 2 in one, 3 fails the gate, 4 never becomes whole."""
    row = lambda c, pe=True, ember=True: (c, pe, ember, 2.0)
    files = [[row(1), row(2), row(2, False, False), row(3)], [row(3, True, False), row(3, True, False)], [row(1, True, False), row(4)], [row(1)]]
    for k, rows in enumerate(files):
        part = spark.createDataFrame(rows, "chunk long, ok_pe boolean, ok_ember boolean, secs double").coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/in")
    sizes = spark.createDataFrame([(1, 3), (2, 2), (3, 3), (4, 5)], "chunk long, size long")
    stream = T.source(spark, f"{tmp_path}/in", "chunk long, ok_pe boolean, ok_ember boolean, secs double", 1)
    T.gate_with_progress(stream, sizes, 0.6, f"{tmp_path}/out", f"{tmp_path}/state")
    written = T.updates(spark, f"{tmp_path}/out").cache()
    assert written.select("batch").distinct().count() >= 3
    judged = {r.chunk: r.passed for r in T.verdicts(written).collect()}
    assert judged == {1: True, 2: True, 3: False}
    steps = T.progress(written).orderBy("batch").collect()
    assert [r.rows for r in steps] == sorted(r.rows for r in steps) and sum(r.done for r in steps[:1]) < 3
    assert (steps[-1].chunks, steps[-1].done, steps[-1].passed, steps[-1].rows, steps[-1].secs) == (4, 3, 2, 9, 18.0)
    # nothing new: a second drain changes nothing
    T.gate_with_progress(T.source(spark, f"{tmp_path}/in", "chunk long, ok_pe boolean, ok_ember boolean, secs double", 1), sizes, 0.6, f"{tmp_path}/out", f"{tmp_path}/state")
    assert T.updates(spark, f"{tmp_path}/out").count() == written.count()


def test_chunks_are_folders(spark, tmp_path):
    df = spark.range(100).withColumn("chunk", F.col("id") % 4)
    manifest.write_chunks(df, f"{tmp_path}/chunks")
    assert sorted(p.name for p in (tmp_path / "chunks").glob("chunk=*")) == [f"chunk={k}" for k in range(4)]
    back = spark.read.parquet(f"{tmp_path}/chunks")
    assert back.groupBy("chunk").count().where("count <> 25").count() == 0 and back.select("id").distinct().count() == 100
