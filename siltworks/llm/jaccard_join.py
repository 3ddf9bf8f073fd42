"""Near-duplicate documents: an exact n-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct 5-word shingles (the whole sequence where there
are fewer words).  Documents link at Jaccard similarity ``SIMILAR`` percent or
more; the result has each document's component.

Shingles have one global order: those that surely occur in one document only come
first, then others by estimated frequency, then by hash.  Both come from one
pass over all shingles into a bitmap of what may occur twice, sized by the number
of shingles up to a bound, and counts by hash bucket.  With a prefix of
``n - ceil(t n) + l`` shingles, linked documents share at least the smaller ``l`` of
their prefixes.  Each document takes the ``l``, up to its least intersection, of
least cost: ``ENTRY_COST`` for each entry it sends, ``TEST_COST`` for each pair that
shares one, by the shingles' estimated frequencies, and those pairs over ``l`` for
verifying; so documents of frequent shingles get longer prefixes.  Shingles of one document only are counted in the prefix but
never sent.

1. Documents of one set are one node.
2. Of each prefix shingle, all documents are compared with one leader, that of the
   fewest shingles of its own; links found this way are joined to components.  A
   group of near copies takes one comparison a document here.  While many pairs of
   different components are left, further rounds compare the others with a
   changing leader from the shingle's largest component.
3. Pairs of different components are compared; no pair that could join components
   is left out, so components are exact.

A pair is verified only if it shares ``l`` prefix shingles, and if lengths, places
in the order and the sets' parity sketches (each shingle in one set only changes
one of ``SKETCH`` bits at most) allow the overlap.  The join of step 3 tests these,
so of a group of near copies whose members don't link it emits no pairs.

Sets are compared by full 64-bit shingle hashes.  Steps are aggregations and
equi-joins that combine before they shuffle and may be split by Spark.

Cases: a null or empty text, or one without words, has an empty set and no links;
a null ``doc_id`` has no links and a null component; rows of one ``doc_id`` are one
document with the links of all of them; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Bitmap, Words, batch, bitmap_bits, block_rows, cut, merge_blocks, mix, signed, slices, split_by_ids, window_hash, word_sums

SHINGLE, SIMILAR = 5, 75
#: What sending a prefix shingle, and testing one pair that shares it, cost in verified pairs.
ENTRY_COST, TEST_COST = 8.0, 1.0
#: Bits of a set's parity sketch.
SKETCH = 1024
#: Another round of leaders is worth its while above so many pairs a row, and as long as rounds settle that share of them.
PAIRS_A_ROW, SETTLED = 256, 0.2


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    w = Words(texts, lower=True)
    h = w.hashes()
    out = []
    for s, e in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        own = h[s:e]
        if 0 < len(own) < SHINGLE:
            own = word_sums(own, np.array([0, len(own)]))[0]
            out.append(own)
        else:
            out.append(np.unique(window_hash(own, SHINGLE)))
    return out


def _node(own: np.ndarray) -> int:
    """A hash of a whole set; 0 for the empty one."""
    return int(mix(np.array([mix(own).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64)).view(np.int64)[0]) if len(own) else 0


def _sets(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for i, j, texts in slices(b.column(1)):
        yield from zip(range(i, j), shingle_sets(texts), strict=True)


def _sketch(own: np.ndarray) -> np.ndarray:
    """For each of SKETCH hash classes whether the set has an odd number of shingles in it, as longs."""
    odd = np.bincount((own & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


_SIGNATURE = "doc_id long, n long, node long, sketch array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sketch", pa.list_(pa.int64()))])
    for b in batches:
        found = [(len(s), _node(s), _sketch(s)) for _, s in _sets(b)]
        yield batch(schema, b.column(0), *([x[k] for x in found] for k in range(3)))


def _twice(rows: DataFrame, bits: int) -> Bitmap:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return block_rows((s for b in batches for _, s in _sets(b)), bits)

    return merge_blocks(rows.mapInArrow(run, "block int, positions binary"), bits, 2)


def choose_prefix(flag: np.ndarray, cost: np.ndarray) -> tuple[int, int]:
    """(l, prefix length) for shingles in global order: whether each may have partners, and its estimated candidates."""
    n = len(flag)
    base = n - -(-SIMILAR * n // 100)
    # a prefix can't be asked for more shared shingles than its set's least intersection
    l = np.arange(1, n - base + 1)
    entries, candidates = np.cumsum(flag)[base:], np.cumsum(np.where(flag, cost, 0))[base:]
    best = int(np.argmin(ENTRY_COST * entries + candidates * (TEST_COST + 1 / l))) + 1
    return best, base + best


def _entries(rows: DataFrame, shared: Broadcast[Bitmap], usual: int) -> DataFrame:
    """(shingle, node, n, at, l, own): the prefixes' shingles that may have partners; ``usual`` is the mean of the bitmap's counts."""
    schema = pa.schema([("shingle", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("l", pa.int32()), ("own", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for b in batches:
            held, n_held = [[] for _ in schema], 0
            for _, s in _sets(b):
                if not len(s):
                    continue
                flag, count = seen.test(s), seen.count(s)
                order = np.lexsort((s, count, flag))
                flag = flag[order]
                m, length = choose_prefix(flag, np.maximum(count[order].astype(np.int64) - usual, 1))
                at = np.flatnonzero(flag[:length])
                if not len(at):
                    continue
                fixed = (_node(s), len(s), m, len(s) - int(flag.sum()))
                for k, x in enumerate((signed(s[order][at]), fixed[0], fixed[1], at, fixed[2], fixed[3])):
                    held[k].append(x if isinstance(x, np.ndarray) else np.full(len(at), x, np.int64))
                n_held += len(at)
                if n_held >= 1 << 17:
                    yield batch(schema, *(np.concatenate(x) for x in held))
                    held, n_held = [[] for _ in schema], 0
            if held[0]:
                yield batch(schema, *(np.concatenate(x) for x in held))

    return rows.mapInArrow(run, "shingle long, node long, n int, at int, l int, own int").distinct()


def _needed(n: Column, m: Column) -> Column:
    """The least intersection of linked sets of n and m."""
    return F.ceil((n + m) * SIMILAR / F.lit(100.0 + SIMILAR))


def _close(n: Column, m: Column, a: Column, b: Column) -> Column:
    """Whether the sizes and sketches of two sets allow a link."""
    differ = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH // 64)), F.lit(0))
    return (100 * F.least(n, m) >= SIMILAR * F.greatest(n, m)) & (differ <= n + m - 2 * _needed(n, m))


def _able(a: str, b: str) -> Column:
    """Whether two sets that share a prefix shingle may link, by sizes and by what can follow it: at most ``l`` - 1 shared ones stand before."""
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    rest = F.least(n - F.col(f"{a}_at"), m - F.col(f"{b}_at")) - 1
    return (100 * F.least(n, m) >= SIMILAR * F.greatest(n, m)) & (F.least(f"{a}_l", f"{b}_l") + rest >= _needed(n, m))


def _sharing(pairs: DataFrame, entries: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sketches are close and that share ``l`` prefix shingles."""
    for s in "ab":
        pairs = pairs.join(sketches.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("sketch").alias(f"{s}_sketch")), s)
    near = pairs.where(_close(F.col("a_n"), F.col("b_n"), F.col("a_sketch"), F.col("b_sketch"))).select("a", "b")
    near = cut(near, "near")
    for s in "ab":
        own = entries.select(F.col("node").alias(s), "shingle", F.col("l").alias(f"{s}_l"))
        near = near.join(own, s if s == "a" else ["b", "shingle"])
    return near.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(F.least("a_l", "b_l")).alias("least")).where("shared >= least").select("a", "b")


def _linked(pairs: DataFrame, rows: DataFrame, signature: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) that link."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    chosen = cut(signature.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "node"), "chosen")
    near, _ = split_by_ids(rows, "doc_id", chosen)
    texts = near.join(chosen, "doc_id").select("node", "text")
    out = pa.schema([("node", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(0).to_pylist()
            # rows of one doc_id may have another text
            found = [(wanted[i], signed(s)) for i, s in _sets(b) if _node(s) == wanted[i]]
            if found:
                yield batch(out, [x[0] for x in found], pa.array([x[1] for x in found], pa.list_(pa.int64())))

    sets = cut(texts.mapInArrow(run, "node long, items array<long>").dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.toDF("a", "a_items"), "a").join(sets.toDF("b", "b_items"), "b")
    shared, n, m = F.size(F.array_intersect("a_items", "b_items")), F.size("a_items"), F.size("b_items")
    return both.where(100 * shared >= SIMILAR * (n + m - shared)).select("a", "b")


def _leader_pairs(open_: DataFrame, no: int) -> DataFrame:
    """(a, b): each row's node with the leader of its shingle, where they are of different components.

    The leader is of the component with most rows: in round 0 the node with fewest
    shingles of its own, later one by a hash of the round.
    """
    fields = ["node", "n", "at", "l"]
    order = F.col("own").cast("long") if no == 0 else F.xxhash64("node", F.lit(no))
    by_label = open_.groupBy("shingle", "label").agg(F.count("*").alias("rows"), F.min(F.struct(order.alias("order"), *fields)).alias("x"))
    lead = by_label.groupBy("shingle").agg(F.min(F.struct(-F.col("rows"), "x", "label")).alias("x")).select("shingle", F.col("x.label").alias("b_label"), *(F.col(f"x.x.{f}").alias(f"b_{f}") for f in fields))
    both = open_.select("shingle", F.col("label").alias("a_label"), *(F.col(f).alias(f"a_{f}") for f in fields)).join(lead, "shingle")
    both = both.where((F.col("a_label") != F.col("b_label")) & _able("a", "b"))
    return both.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def _still_open(entries: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows of shingles that nodes of different components share, labelled; their number, and that of pairs of different components."""
    named = entries.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    many = named.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("shingle")
    open_ = cut(named.join(many, "shingle", "left_semi"), "open")
    by_shingle = open_.groupBy("shingle", "label").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("same"))
    got = by_shingle.agg(F.sum("c"), F.sum((F.col("c") * F.col("c") - F.col("same")) / 2.0)).first()
    return open_, got[0] or 0, got[1] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component of ``edges`` (a, b); nodes without edges are left out.

    Least neighbours with pointer jumping: rounds grow with the logarithm of a
    component's width, and each is a few aggregations and joins.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        least = both.join(labels.toDF("b", "other"), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        hooked = labels.join(least, "node").select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        jumped = cut(hooked.join(labels.toDF("label", "above"), "label", "left").select("node", F.least("label", "above").alias("label"), (F.least("label", "above") != F.col("old")).alias("moved")), "labels")
        labels = jumped.select("node", "label")
        if not jumped.where("moved").limit(1).count():
            return labels


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, label) of components with ``edges`` (a, b) added.

    The edges are taken between labels, so the rounds grow with the new edges' width alone.
    """
    for s in "ab":
        edges = edges.join(labels.select(F.col("node").alias(s), F.col("label").alias(f"{s}_label")), s, "left")
    edges = edges.select(*(F.coalesce(f"{s}_label", s).alias(s) for s in "ab"))
    above = components(edges).toDF("old", "above")
    moved = labels.join(above, F.col("label") == F.col("old"), "left").select("node", F.coalesce("above", "label").alias("label"))
    added = above.join(labels, F.col("old") == F.col("node"), "left_anti").toDF("node", "label")
    return cut(moved.unionByName(added), "labels")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signature = cut(rows.mapInArrow(_signatures, _SIGNATURE), "signatures")
    known = rows.where(F.col("doc_id").isNotNull())
    alive = signature.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    sketches = alive.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))

    found = _twice(known, bitmap_bits(alive.agg(F.sum("n")).first()[0] or 0))
    seen, usual = docs.sparkSession.sparkContext.broadcast(found), max(1, int(found.counts.mean()))
    del found  # the driver's Python keeps no copy
    entries = _entries(known, seen, usual)
    several = entries.groupBy("shingle").agg(F.count("*").alias("size")).where("size > 1").select("shingle")
    entries = cut(entries.join(several, "shingle", "left_semi").withColumn("label", F.col("node")), "entries")
    seen.destroy()  # of at most 2 ** MOST_BITS bits; its table is written
    open_, labels, tried, left, no = entries, None, None, None, 0
    while True:
        pairs = _leader_pairs(open_, no)
        new = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = new if tried is None else tried.unionByName(new)
        found = cut(_linked(cut(_sharing(new, entries, sketches), "sharing"), known, alive), "links")
        labels = components(found) if labels is None else joined(labels, found)
        open_, n_rows, n_pairs = _still_open(open_, labels)
        if n_pairs <= PAIRS_A_ROW * n_rows or (left is not None and n_pairs > (1 - SETTLED) * left):
            break
        left, no = n_pairs, no + 1

    # pairs that could still join two components
    drawn = cut(open_.join(sketches.select("node", "sketch"), "node"), "open")
    a, b = (drawn.select("shingle", *(F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "at", "l", "label", "sketch"))) for s in "ab")
    able = _able("a", "b") & _close(F.col("a_n"), F.col("b_n"), F.col("a_sketch"), F.col("b_sketch"))
    pairs = a.join(b, "shingle").where((F.col("a_node") < F.col("b_node")) & (F.col("a_label") != F.col("b_label")) & able)
    pairs = pairs.groupBy(F.col("a_node").alias("a"), F.col("b_node").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("a_l", "b_l")).alias("least")).where("shared >= least").select("a", "b")
    more = _linked(cut(pairs.join(tried, ["a", "b"], "left_anti"), "pairs"), known, alive)

    # rows of one doc_id are one document
    same = alive.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").select("doc_id", "a")
    same = alive.select("doc_id", "node").join(same, "doc_id").where("node != a").select("a", F.col("node").alias("b"))
    labels = joined(labels, more.unionByName(same))
    placed = alive.select("doc_id", "node").join(labels, "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("label"))
    first = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    # by document, as a document without words may have another row with some
    of_doc = placed.join(first, "label").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = signature.select("doc_id", "n").join(of_doc, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that of the least ``doc_id``; of rows of one ``doc_id`` the first by text."""
    found = cut(near_duplicates(docs), "components")
    loses = found.where("component_id < doc_id").select("doc_id").distinct()
    repeated = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    work = cut(loses.withColumn("gone", F.lit(True)).unionByName(repeated.withColumn("gone", F.lit(False))).groupBy("doc_id").agg(F.max("gone").alias("gone")).toDF("__id", "__gone"), "work")
    names = docs.columns
    place, text = names.index("doc_id"), names.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    touched, rest = split_by_ids(plain.withColumn(f"c{place}", F.col(f"c{place}").cast("long")), f"c{place}", work)
    touched = touched.join(work, F.col(f"c{place}") == F.col("__id"), "left").where(F.coalesce("__gone", F.lit(False)) == F.lit(False))
    once = touched.withColumn("__no", F.row_number().over(Window.partitionBy(f"c{place}").orderBy(f"c{text}"))).where("__no = 1")
    return once.select(*plain.columns).unionByName(rest).toDF(*names)
