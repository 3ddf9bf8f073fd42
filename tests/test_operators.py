import zlib

import pytest
from pyspark.sql import functions as F

from siltworks.operators import corpus, graph, joins, metrics, neighbours, running, split, windows
from siltworks.sources import manifest


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "s double, y int")
    assert metrics.roc_auc(df, "s", "y").first().auc == 0.875


def test_metrics_of_one_class_and_none(spark):
    df = spark.createDataFrame([(0.9, 1), (None, 0)], "s double, y int")
    c = metrics.confusion(df, "s", "y").first()
    assert (c.tp, c.fp, c.fn, c.tn, c.precision) == (1, 0, 0, 0, 1.0)
    assert metrics.tpr_at_fpr(df.where("s > 2"), "s", "y", [0.1]).first().t0 == 0.0


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.5, 0, "val")] * 4 + [(0.5, 1, "test"), (0.6, 1, "test"), (0.5, 0, "test")], "s double, y int, part string")
    t = metrics.val_threshold(df, "s", "y", "part", 0.25).first()
    assert (t.threshold, t.tpr, t.fpr) == (0.5, 0.5, 0.0)


def test_top_edge_bin(spark):
    df = spark.createDataFrame([(10000.0,), (0.0,), (10001.0,)], "x double").select(graph.histogram_bin(F.col("x")).alias("b"))
    assert [r.b for r in df.collect()] == [15, 0, None]


def test_knn_needs_fewer_rows_than_k_and_skips_nulls(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, v array<double>")
    i = spark.createDataFrame([(1, [1.0, 0.0]), (5, [0.0, 1.0]), (4, [1.0, 0.0]), (6, None)], "id long, v array<double>")
    got = [(r.query_id, r.idx_id, r["rank"]) for r in neighbours.knn(q, i, 10).orderBy("rank").collect()]
    assert got == [(1, 1, 1), (1, 4, 2), (1, 5, 3)]
    assert [r.idx_id for r in neighbours.knn(q, i, 10, exclude_self=True).orderBy("rank").collect()] == [4, 5]
    assert neighbours.knn(q.where("id > 5"), i, 3).count() == 0


def test_self_loops_leave_their_node(spark):
    e = spark.createDataFrame([(1, "a", "a"), (1, "b", "c"), (1, "b", "c")], "graph_id long, src string, dst string")
    f = spark.createDataFrame([(1, "b"), (1, "d")], "graph_id long, node string")
    nodes, edges = graph.build(e, f)
    assert {(r.node, r.external) for r in nodes.collect()} == {("a", 1), ("b", 0), ("c", 1), ("d", 0)}
    assert edges.count() == 1
    assert {r.node: r.deg for r in graph.degree_profile(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_header_fields(spark):
    head = bytearray(128)
    head[:2], head[60:62], head[80:84], head[84:86] = b"MZ", (80).to_bytes(2, "little"), b"PE\0\0", (0x8664).to_bytes(2, "little")
    df = spark.createDataFrame([(head,), (bytearray(b"junk"),)], "content binary")
    got = df.select(corpus.machine_field(F.col("content")).alias("m"), corpus.masked_bytes(F.col("content"), (84, 2)).alias("z")).collect()
    assert [r.m for r in got] == [0x8664, None]
    assert got[0].z[84:86] == b"\0\0" and bytes(got[1].z) == b"junk"


def test_instruction_tokens(spark):
    schema = "mnemonic string, operands array<struct<type:string,value:string,base:string,scale:int,disp:bigint>>"
    df = spark.createDataFrame([("mov", [("reg", "eax", None, None, None), ("imm", "16", None, None, None)]), ("push", [("imm", "99999", None, None, None)]), ("lea", [("reg", "rax", None, None, None), ("mem", None, "rbx", 2, 9000)]), ("ret", []), ("jmp", [("mem", None, "0", None, 4)]), ("inc", [("mem", None, "rcx", None, None)]), ("sub", [("imm", "-16", None, None, None)])], schema)
    got = [r[0] for r in df.select(corpus.normal_instruction(F.col("mnemonic"), F.col("operands"))).collect()]
    assert got == ["X_mov_eax,_0x10", "X_push_HIMM", "X_lea_rax,_[rbx*2+9000]", "X_ret", "X_jmp_[MEM]", "X_inc_[rcx*1+0]", "X_sub_-0x10"]


def test_binary_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(zlib.compress(b"MZdata"))
    (tmp_path / "b").write_bytes(b"MZ")
    (tmp_path / "c").write_bytes(b"other")
    assert sorted(r["size"] for r in manifest.ingest_files(spark, f"{tmp_path}/*", b"MZ").collect()) == [2, 6]


def test_index_files(spark, tmp_path):
    (tmp_path / "win_2024.csv").write_text("sha256,size\nAB,1\n")
    (tmp_path / "mac.csv").write_text("sha256,size\nCD,2\n")
    got = manifest.read_indexes(spark, f"{tmp_path}/*.csv", "sha256 string, size long")
    assert {(r.source, r.sha256) for r in got.collect()} == {("win", "AB"), ("mac", "CD")}


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing"):
        manifest.with_required(spark.range(1), ["x"], [])


def test_group_never_spans_parts(spark):
    df = spark.range(200).select((F.col("id") % 20).alias("g"), "id").withColumn("part", split.group_split(F.col("g"), {"train": 0.7, "val": 0.15, "test": 0.15}, "1"))
    assert split.leaks(df, "g", "part").count() == 0 and df.select("part").distinct().count() == 3


def test_versions_sort(spark):
    df = spark.createDataFrame([("1.10",), ("1.9",), ("1.9-rc",)], "v string")
    assert [r.v for r in df.orderBy(split.version_key(F.col("v"))).collect()] == ["1.9", "1.9-rc", "1.10"]


def test_sections_and_ranks(spark):
    df = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, False), (1, 3, True)], "k int, o int, h boolean")
    assert [r.section for r in windows.sections(df, "k", "o", "h").orderBy("o").collect()] == [0, 1, 1, 2]
    assert [r["rank"] for r in running.global_rank(df, [F.col("h"), F.col("o")], "rank").orderBy("rank").collect()] == [1, 2, 3, 4]


def test_reconcile_takes_the_first_candidate(spark):
    dim = spark.createDataFrame([("tool.exe", 1), ("tool", 2)], "candidate string, value int")
    names = spark.createDataFrame([("dir/TOOL.exe",), ("tool.dll",), ("none",)], "name string")
    assert {r.name: r.value for r in joins.reconcile(names, "name", dim).collect()} == {"dir/TOOL.exe": 1, "tool.dll": 2, "none": None}


def test_walk_vectors_are_nearer_along_edges(spark):
    """Two dense halves with one edge between them; the third graph has only a loop."""
    import numpy as np

    half = lambda g, a: [(g, f"{a}{i}", f"{a}{j}") for i in range(12) for j in range(12) if i != j and (i * 7 + j) % 3 == 0]
    rows = half(1, "a") + half(1, "b") + [(1, "a0", "b0")] + half(2, "c") + [(3, "x", "x")]
    edges = spark.createDataFrame(rows, "graph_id long, src string, dst string")
    for directed in (True, False):
        got = graph.walk_embedding(edges, dim=16, directed=directed).collect()
        assert {r.graph_id for r in got} == {1, 2}
        assert all(abs(np.linalg.norm(r.graph_vector) - 1) < 1e-4 and len(r.vector) == 16 and np.isfinite(r.vector).all() for r in got)
        v = {r.node: np.array(r.vector) / np.linalg.norm(r.vector) for r in got if r.graph_id == 1}
        assert len(v) == 24
        same = [v[x] @ v[y] for x in v for y in v if x < y and x[0] == y[0]]
        other = [v[x] @ v[y] for x in v for y in v if x[0] == "a" and y[0] == "b"]
        assert np.mean(same) > np.mean(other) + 0.2
    again = graph.walk_embedding(edges.repartition(3, "src"), dim=16).collect()
    first = graph.walk_embedding(edges, dim=16).collect()
    assert {(r.graph_id, r.node): r.vector for r in again} == {(r.graph_id, r.node): r.vector for r in first}


def test_top_nodes_bound_a_walked_graph(spark):
    edges = spark.createDataFrame([(1, "hub", f"n{i}") for i in range(30)] + [(1, "n1", "n2"), (1, "n2", "n3")], "graph_id long, src string, dst string")
    got = {r.node for r in graph.walk_embedding(edges, dim=4, most_nodes=4).collect()}
    assert got == {"hub", "n1", "n2", "n3"}


def test_vector_messages_drop_edges_past_the_cap(spark):
    nodes = spark.createDataFrame([(1, "a", 1.0, 0.0), (1, "b", 2.0, 1.0), (1, "c", 4.0, 5.0), (2, "a", 7.0, 0.0)], "graph_id long, node string, p double, q double")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "a", "c")], "graph_id long, src string, dst string")
    x = graph.scaled_features(nodes, ["p", "q"], F.col("graph_id") == 1, 2)
    assert {(r.graph_id, r.node): [round(v, 4) for v in r.x] for r in x.collect()} == {(1, "a"): [-1.0, -1.0], (1, "b"): [1.0, 1.0], (2, "a"): [11.0, -1.0]}
    got = {(r.graph_id, r.node): [round(v, 4) for v in r.x] for r in graph.message_pass_vectors(edges, x, 2, 0.5).collect()}
    assert got == {(1, "a"): [-0.5, -0.5], (1, "b"): [0.5, 0.5], (2, "a"): [16.5, -1.5]}
    r = graph.readout_vectors(x, 2).where("graph_id = 1").first()
    assert [round(v, 4) for v in [*r["mean"], *r["max"]]] == [0.0, 0.0, 1.0, 1.0]


def made_header(magic, machine, subsystem=3, offset=0x80, size=512):
    b = bytearray(size)
    b[:2], b[0x3C:0x40] = b"MZ", offset.to_bytes(4, "little")
    if offset + 94 <= size:
        b[offset : offset + 4] = b"PE\0\0"
        b[offset + 4 : offset + 6] = machine.to_bytes(2, "little")
        b[offset + 24 : offset + 26] = magic.to_bytes(2, "little")
        b[offset + 92 : offset + 94] = subsystem.to_bytes(2, "little")
    return bytes(b)


def test_views_of_headers(spark):
    whole = [(0x10B, 0x14C), (0x20B, 0x8664), (0x107, 0x1C0)]
    rows = [(i, bytearray(made_header(*x))) for i, x in enumerate(whole)]
    rows += [(10 + i, bytearray(made_header(m, 0, 0))) for i, (m, _) in enumerate(whole)]  # already zeroed
    cut = made_header(0x10B, 0x14C)
    bad = [b"not a header at all" * 10, b"", cut[:200], cut[:63], made_header(0x10B, 1, offset=0xFFFFFFFF), made_header(0x10B, 1, offset=0x7FFFFFF0), made_header(0x10B, 1, offset=419), cut[:0x80] + b"PX" + cut[0x82:], b"ZM" + cut[2:]]
    rows += [(20 + i, bytearray(b)) for i, b in enumerate(bad)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, content binary")
    c = F.col("content")
    got = {r.id: r for r in df.select("id", corpus.header_offset(c).alias("at"), corpus.model_view(c).alias("model"), corpus.analysis_view(c).alias("analysis")).collect()}
    for i, (magic, machine) in enumerate(whole):
        assert got[i].at == 128 and bytes(got[i].model) == made_header(magic, 0, 0) == bytes(got[10 + i].model)
        assert bytes(got[i].analysis) == made_header(magic, machine)
        assert bytes(got[10 + i].analysis) == made_header(magic, machine if magic != 0x107 else 0, 0)
    assert all(r.at is None and r.model is None and r.analysis is None for i, r in got.items() if i >= 20)
    edge = spark.createDataFrame([(bytearray(made_header(0x20B, 0, offset=418)),)], "content binary").select(corpus.header_offset(c).alias("at")).first()
    assert edge.at == 418  # the last byte is the header's own


def test_negatives_are_no_positives(spark):
    pos = spark.createDataFrame([(1, 2), (1, 3), (4, 3), (5, 4), (6, 9), (6, 9)], "a long, b long")
    got = {(r.a, r.b) for r in joins.shifted_negatives(pos).collect()}
    assert got == {(1, 4), (6, 10)}  # (1, 3) is a positive, (4, 4) a row with itself, (5, 5) too


def test_large_vocabularies_meet_tokens_by_a_join(spark, monkeypatch):
    tokens = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "zz"), (2, 0, None)], "doc_id long, pos long, token string")
    vocabulary = spark.createDataFrame([("a", 1), ("b", 2)], "token string, id long")
    for rows in (200_000, 1):
        monkeypatch.setattr(corpus, "SENT_ROWS", rows)
        got = {r.doc_id: (r.ids, r.n_tokens, r.n_unknown) for r in corpus.encode(tokens, vocabulary, 3).collect()}
        assert got == {1: ([1, 2, 3], 3, 1), 2: ([3], 1, 1)}


def test_metric_of_a_log_without_a_title_or_a_row(spark):
    text = ["before", "# RUN 7 x", "10 a 0.5", "# RUN 8", "Title", "10 b 0.25", "Title", " 10 c 0.75 d", "10 e 9", "# RUN 9", "Title", "10 f", "# RUN 10", "Title", "10 g bad"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)] + [(2, 0, "# RUN 1"), (2, 1, None), (2, 2, "10 x 1.5")], "log long, no int, line string")
    got = sorted((r.log, r.run, r.metric) for r in windows.scraped_metric(df, "log", "no", "line", "# RUN ", "Title", "10", 3).collect())
    assert got == [(1, "7", 0.5), (1, "8", 0.75), (2, "1", 1.5)]


def test_pair_classes_count_pairs(spark):
    df = spark.createDataFrame([(1, ["x"]), (2, ["x"]), (3, ["y", "x"]), (4, ["x", "y"]), (5, ["y"]), (6, []), (7, None)], "id long, tags array<string>")
    got = {(r.a, r.b): r.pairs for r in joins.overlap_classes(df, "tags").collect()}
    assert got == {("x", "x"): 1, ("x", "x,y"): 4, ("x,y", "x,y"): 1, ("x,y", "y"): 2, ("y", "y"): 0}


def test_overlap_pairs_of_many_blocks(spark, monkeypatch):
    """Pairs of several blocks, with rows that share two tags, repeat tags or keys, or lack them; none is told by an aggregate over pairs."""
    from siltworks.operators import joins as J

    monkeypatch.setattr(J, "PAIR_ROWS", 7)
    tags = [["x"], ["x", "y"], ["y", "z", "y"], [], None, ["z", None]]
    rows = [(i, tags[i % 6]) for i in range(60)] + [(3, ["x"]), (None, ["x"])]
    held = {}
    for i, t in rows:
        held.setdefault(i, set()).update(x for x in t or [] if x)
    want = {(a, b) for a in held for b in held if None not in (a, b) and a < b and held[a] & held[b]}
    pairs = J.overlap_pairs(spark.createDataFrame(rows, "k long, t array<string>"), "k", "t")
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "HashAggregate" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_expanded_overlaps_equal_the_composition(spark, monkeypatch):
    """Positives and shifted negatives with values, where keys have no value, two, or a null; pairs are joined once and never aggregated."""
    from pyspark.sql import functions as F

    from siltworks.operators import joins as J

    monkeypatch.setattr(J, "PAIR_ROWS", 6)
    tags = [["x"], ["x", "y"], ["z"], None, ["y", "z"]]
    rows = spark.createDataFrame([(i, tags[i * i % 5]) for i in range(40) if i % 7], "k long, t array<string>")
    values = spark.createDataFrame([(i, float(i) if i % 4 else None) for i in range(38)] + [(5, 0.5)], "id long, x double")
    pos = J.overlap_pairs(rows, "k", "t").withColumn("label", F.lit(1))
    want = J.expand_pairs(pos.unionByName(J.shifted_negatives(pos).withColumn("label", F.lit(-1))), values, "id", "x")
    got = J.expanded_overlaps(rows, "k", "t", values, "id", "x")
    cols = ["a", "b", "label", "a_x", "b_x"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect())) and got.columns == cols
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_scraped_metric_spreads_one_log(spark):
    """All lines in one log: the largest task of the counting holds a part of them."""
    from siltworks.operators.windows import scraped_metric

    lines = [(7, i * 4 + j, t) for i in range(400) for j, t in enumerate((f"### RUN = r{i} x", "Title", f"10 a {i}", "other"))]
    found = scraped_metric(spark.createDataFrame(lines, "log long, no long, line string"), "log", "no", "line", "### RUN = ", "Title", "10", 3)
    assert sorted((r.section, r.run, r.metric) for r in found.collect()) == [(i + 1, f"r{i}", float(i)) for i in range(400)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(log" not in plan or "windowspecdefinition(__range" in plan


def test_first_nodes_and_their_edges(spark):
    """What a graph's first nodes need: themselves, picked before the shuffle, and the edges at them."""
    from siltworks.operators import graph as G

    nodes = spark.createDataFrame([(g, f"n{i}") for g in (0, 1) for i in range(9)], "graph_id long, node string")
    edges = spark.createDataFrame([(g, f"n{i}", f"n{(i * 5 + 3) % 9}") for g in (0, 1) for i in range(9)], "graph_id long, src string, dst string")
    first = G.first_nodes(nodes, 2)
    assert sorted(map(tuple, first.collect())) == [(0, "n0"), (0, "n1"), (1, "n0"), (1, "n1")]
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
    want = [tuple(r) for r in edges.collect() if {r.src, r.dst} & {"n0", "n1"}]
    assert sorted(map(tuple, G.edges_at(edges, first).collect())) == sorted(want)


def test_walks_by_short_lists(spark, monkeypatch):
    """A hub's neighbours in several rows; fewer rows are joined than there are edges, and walks are the same as from one list."""
    from siltworks.operators import graph as G

    edges = spark.createDataFrame([(0, "hub", f"n{i}") for i in range(23)] + [(0, f"n{i}", f"n{i + 1}") for i in range(22)] + [(1, "p", "q")], "graph_id long, src string, dst string")
    rows, keep = {}, G.kept

    def counted(df, name):
        out = keep(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(G, "kept", counted)
    walks = lambda: sorted(map(str, G.random_walks(edges, 5, 3, "s").collect()))
    one = walks()
    few = rows["neighbours"]
    monkeypatch.setattr(G, "LISTED", 4)
    assert walks() == one and len(one) == 26 * 3
    assert few == 26 and rows["neighbours"] == 26 + 5
    ends = {(r.graph_id, *p) for r in edges.collect() for p in ((r.src, r.dst), (r.dst, r.src))}
    assert all((r.graph_id, a, b) in ends for r in G.random_walks(edges, 5, 3, "s").collect() for a, b in zip(r.path, r.path[1:]))
