import brute
import corpus_pipeline

from siltworks.llm import decontaminate, mcd_quality
from siltworks.llm.common import cut


def test_stages_keep_the_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items = decontaminate.Items([b[0] for b in bench], [b[1] for b in bench])
    for (name, stage), number in zip(corpus_pipeline.STAGES, (2, 10, 3, 8, 7), strict=True):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        if number != 7:
            assert out.columns == docs.columns, name
            out = cut(out, "stage")
        rows = out.collect()
        after = {r.doc_id for r in rows}
        assert after <= before.keys() and after
        if number == 2:
            assert after == {r.doc_id for r in mcd_quality.judge(docs, "doc_id").collect() if r.kept}
        if number == 10:
            assert all(set(r.text.split("\n")) <= set(before[r.doc_id].split("\n")) for r in rows)
        if number == 3:
            groups = brute.components(list(before.items()))
            assert after == {d for d, _, c in groups if c == d}
        if number == 8:
            assert after == {d for d, t in before.items() if not items.find(t)}
        if number == 7:
            assert after == before.keys()
        docs = out


def test_run_equals_the_stages(spark, sf_dir):
    assert corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
