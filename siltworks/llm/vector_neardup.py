"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Equal vectors become one class with a weight first.  Classes go to blocks of
about ``block_rows``, near ones together: each takes the nearest of a bounded number
of pivots, and a cell that is too large is split by hash.  Every pair of blocks
of one length is multiplied in one task, unless the angle between the blocks'
centres, less both radii, rules a link out.

In a task, tiles of vectors quantised to int8 are multiplied (exactly, as whole
numbers below 2 ** 24 in float32).  A unit vector a is s * q + r with a residual
r whose norm is measured, so the cosine of a and b lies within
|sq_a| |r_b| + |sq_b| |r_a| + |r_a| |r_b| of the tile's product.  Pairs whose
interval is above or below the threshold are settled by it; only the pairs whose
interval holds the threshold are computed anew in double precision.  A task
emits a count and one link towards its least node for each vector that has any
link, so a group of n near vectors costs n rows a pair of blocks, not n squared.

Neither pivots nor blocks change a result.  The work without pruning is all
pairs; centres prune what is clustered.

Cases: a null, empty or zero vector, or one with a null or non-finite component,
links with nothing, nor does a row with a null id (its component is null);
vectors of different lengths don't link; equal rows are vectors of their own
that link; different vectors under one id keep their own links and share a
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch
from .jaccard_join import components
from .tables import Tables

#: Vectors of a block at least, its bytes at most, pivots at most, and the bytes that all blocks' centres may take (blocks grow beyond that).
LEAST_ROWS, BLOCK_BYTES, MOST_PIVOTS, CENTRE_BYTES = 4096, 32 << 20, 256, 64 << 20
#: Rows and columns of a tile.
TILE = 1024
#: Float32 products of int8 vectors are whole numbers up to this length; longer ones are added in parts.
_EXACT = 1024
#: Covers the rounding of the bounds' own float64 arithmetic.
_SLACK = 1e-9

_BLOCK = "block long, n long, dim int, nodes binary, weights binary, raw binary, quantised binary, stats binary, centre binary, radius double"


def usable(vector: Column) -> Column:
    """Whether a vector is neither null, empty nor zero, and all its components are finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, scaled first so that squares neither overflow nor vanish."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Int8 rows of unit vectors, and for each its scale, the norm of scale * row and the norm of the residual, both rounded up."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    near = q * scale[:, None]
    up = lambda v: np.sqrt((v * v).sum(axis=1)) * (1 + 1e-12) + 1e-15
    return q.astype(np.int8), np.stack((scale, up(near), up(x - near)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products of all rows of two int8 tiles (as float32 or, for long vectors, float64)."""
    if a.shape[1] <= _EXACT:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum((products(a[:, k : k + _EXACT], b[:, k : k + _EXACT]).astype(np.float64) for k in range(0, a.shape[1], _EXACT)), np.zeros((len(a), len(b))))


def merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least labels after joining nodes x[i] and y[i]; ``label`` holds each node's root."""
    while True:
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            return label
        x, y, low, high = x[apart], y[apart], np.minimum(lx, ly)[apart], np.maximum(lx, ly)[apart]
        np.minimum.at(label, high, low)
        while (label != (label := label[label])).any():
            pass


class Block:
    """A block's arrays."""

    def __init__(self, row: dict, real: str):
        n, dim = row["n"], row["dim"]
        self.nodes, self.weights = np.frombuffer(row["nodes"], "<i8"), np.frombuffer(row["weights"], "<i8")
        self.raw = np.frombuffer(row["raw"], real).reshape(n, dim)
        self.quantised = np.frombuffer(row["quantised"], np.int8).reshape(n, dim)
        self.scale, self.norm, self.rest = np.frombuffer(row["stats"], "<f8").reshape(3, n)


def tile_links(a: Block, b: Block, ra: slice, rb: slice, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Places in ``ra`` and ``rb`` of the linked pairs, and how many pairs were computed in double precision."""
    p = products(a.quantised[ra], b.quantised[rb])
    sa, ua, ea = a.scale[ra], a.norm[ra], a.rest[ra]
    sb, ub, eb = b.scale[rb], b.norm[rb], b.rest[rb]
    # a bound for each row over the whole tile first, with room for float32's rounding
    wide = threshold - (ua * eb.max() + ub.max() * ea + ea * eb.max()) - 1e-5
    i, j = np.nonzero(p * sb.astype(np.float32) >= (wide / sa).astype(np.float32)[:, None])
    about = p[i, j].astype(np.float64) * sa[i] * sb[j]
    error = ua[i] * eb[j] + ub[j] * ea[i] + ea[i] * eb[j] + _SLACK
    linked = about - error >= threshold
    open_ = np.flatnonzero(~linked & (about + error >= threshold))
    for k in range(0, len(open_), 1 << 14):
        at = open_[k : k + (1 << 14)]
        x, y = a.raw[ra][i[at]].astype(np.float64), b.raw[rb][j[at]].astype(np.float64)
        linked[at] = (unit(x) * unit(y)).sum(axis=1) >= threshold
    return i[linked], j[linked], len(open_)


def rows_of_block(n: int, dim: int, cores: int) -> int:
    """Rows of a block: so many that pairs of blocks are a few for each core, as every block goes to as many tasks as there are blocks."""
    most = max(1024, BLOCK_BYTES // (5 * dim))
    return max(int(min(most, max(LEAST_ROWS, n / (8 * cores) ** 0.5))), -(-n * 8 * dim // CENTRE_BYTES))


def near_vectors(rows: DataFrame, threshold: float = 0.95, block_rows: int | None = None, vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``rows`` (vec_id, ``vector``).

    ``threshold`` is positive; ``block_rows`` is chosen by the number of vectors and cores if it isn't given.
    """
    spark, tables = rows.sparkSession, Tables(rows.sparkSession, "near-vectors")
    real = "<f4" if dict(rows.dtypes)[vector] == "array<float>" else "<f8"
    kind = "array<float>" if real == "<f4" else "array<double>"
    all_rows = rows.select(F.col("vec_id").cast("long"), F.col(vector).cast(kind).alias("vector"))
    good = usable(F.col("vector")) & F.col("vec_id").isNotNull()
    fine = all_rows.where(good)

    classes = fine.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    classes = tables.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    n, longest = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return all_rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    block_rows = block_rows or rows_of_block(n, longest, spark.sparkContext.defaultParallelism)
    blocks = tables.keep(_blocks(classes, n, block_rows, real), "blocks")
    found = tables.keep(_products(blocks, threshold, real), "found")
    tables.drop("blocks")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # different vectors under one id are one node of the graph
    named = fine.join(classes.select("vector", "node"), "vector").select("vec_id", "node", "vector")
    same = named.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").select("vec_id", "a")
    same = named.select("vec_id", "node").join(same, "vec_id").where("node != a").select("a", F.col("node").alias("b"))
    labels = components(found.where("root != node").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(same))
    placed = classes.join(links, "node", "left").join(labels, "node", "left").select("vector", "first", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    least = placed.groupBy("label").agg(F.min("first").alias("component_id"))
    by_vector = tables.keep(placed.join(least, "label").select("vector", "n_links", "component_id"), "judged")
    out = fine.join(by_vector, "vector").select("vec_id", "n_links", "component_id")
    rest = all_rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _blocks(classes: DataFrame, n: int, block_rows: int, real: str) -> DataFrame:
    """Blocks of at most about ``block_rows`` classes of one length and one pivot, with their centre and radius."""
    spark = classes.sparkSession
    count = min(MOST_PIVOTS, max(1, n // block_rows))
    # a bounded number of pivots, drawn by hash
    drawn = classes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(count).collect()
    pivots: dict[int, list] = {}
    for r in drawn:
        pivots.setdefault(len(r.vector), []).append(r.vector)
    pivots = {d: unit(np.array(x)) for d, x in pivots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("node", pa.int64()), ("weight", pa.int64()), ("raw", pa.binary())])
        for b in batches:
            lists = b.column(0)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(real)
            dim, cell = np.diff(ends), np.zeros(len(lists), np.int32)
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                if d in pivots:
                    cell[at] = (unit(flat[ends[at][:, None] + np.arange(d)]) @ pivots[d].T).argmax(axis=1)
            size = flat.itemsize
            raw = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(((ends - ends[0]) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat[ends[0] : ends[-1]]))])
            yield batch(schema, dim, cell, b.column(1), b.column(2), raw)

    placed = classes.select("vector", "node", "weight").mapInArrow(place, "dim int, cell int, node long, weight long, raw binary")
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / block_rows).cast("long")
    # dim, cell and part of the cell in one number
    key = F.col("dim").cast("long") * (1 << 36) + F.col("cell").cast("long") * (1 << 28) + F.pmod(F.xxhash64("node"), parts)
    spread = placed.join(sizes, ["dim", "cell"]).select(key.alias("block"), "dim", "node", "weight", "raw")

    def pack(table: pa.Table) -> pa.Table:
        dim, n = table["dim"][0].as_py(), table.num_rows
        raw = np.frombuffer(b"".join(table["raw"].to_pylist()), real).reshape(n, dim)
        x = unit(raw)
        q, stats = quantise(x)
        centre = x.sum(axis=0)
        centre = centre / norm if (norm := np.sqrt((centre * centre).sum())) > 1e-9 else x[0]
        radius = float(np.arccos(np.clip((x @ centre).min() - 1e-9, -1, 1)))
        column = lambda v, t: pa.array([np.ascontiguousarray(v, t).tobytes()])
        values = [table["block"][:1].combine_chunks(), pa.array([n], pa.int64()), pa.array([dim], pa.int32()), column(table["node"].to_numpy(), "<i8"), column(table["weight"].to_numpy(), "<i8"), column(raw, real), column(q, np.int8), column(stats, "<f8"), column(centre, "<f8"), pa.array([radius])]
        return pa.table(values, names=["block", "n", "dim", "nodes", "weights", "raw", "quantised", "stats", "centre", "radius"])

    return spread.groupBy("block").applyInArrow(pack, _BLOCK)


def _products(blocks: DataFrame, threshold: float, real: str) -> DataFrame:
    """(node, links, root) of each vector that has a link within a pair of blocks: the weight of what it links with there, and the least node of its component there."""
    # the blocks are so large that their centres stay within CENTRE_BYTES
    heads = blocks.select("block", "dim", "centre", "radius").collect()
    centres: dict[int, tuple] = {}
    for d in {r.dim for r in heads}:
        own = sorted((r.block, r.centre, r.radius) for r in heads if r.dim == d)
        centres[d] = (np.array([x[0] for x in own]), np.array([np.frombuffer(x[1], "<f8") for x in own]), np.array([x[2] for x in own]))
    seen = blocks.sparkSession.sparkContext.broadcast(centres)
    reach = float(np.arccos(min(1.0, threshold))) + 1e-6

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
        for b in batches:
            for block, dim in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, centre, radius = seen.value[dim]
                k = int(np.searchsorted(ids, block))
                angle = np.arccos(np.clip(centre[k:] @ centre[k], -1, 1))
                with_ = ids[k:][angle <= radius[k:] + radius[k] + reach]
                with_ = np.union1d(with_, [block])
                own = np.full(len(with_), block)
                yield batch(schema, np.concatenate((own, with_[1:])), np.concatenate((own, own[1:])), np.concatenate((with_, with_[1:])))

    pairs = blocks.select("block", "dim").mapInArrow(meet, "block long, a long, b long")

    def multiply(table: pa.Table) -> pa.Table:
        found = [Block(r, real) for r in sorted(table.drop_columns(["a", "b", "centre", "radius"]).to_pylist(), key=lambda r: r["block"])]
        a, b, alone = found[0], found[-1], len(found) == 1
        na, nb = len(a.nodes), 0 if alone else len(b.nodes)
        order = np.argsort(nodes := np.concatenate((a.nodes, b.nodes[:nb])), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        links, label = np.zeros(na + nb, np.int64), np.arange(na + nb)
        for i in range(0, na, TILE):
            for j in range(i if alone else 0, len(b.nodes), TILE):
                x, y, _ = tile_links(a, b, slice(i, i + TILE), slice(j, j + TILE), threshold)
                x, y = x + i, y + j
                if alone and i == j:
                    x, y = x[x < y], y[x < y]
                if not len(x):
                    continue
                left, right = x, y if alone else y + na
                links += np.bincount(left, b.weights[y].astype(np.float64), na + nb).astype(np.int64) + np.bincount(right, a.weights[x].astype(np.float64), na + nb).astype(np.int64)
                label = merge(label, place[left], place[right])
        at = np.flatnonzero(links)
        return pa.table({"node": nodes[at], "links": links[at], "root": nodes[order][label[place[at]]]})

    return pairs.join(blocks, "block").groupBy("a", "b").applyInArrow(multiply, "node long, links long, root long")


def keep_one(rows: DataFrame, threshold: float = 0.95, vector: str = "embedding") -> DataFrame:
    """``rows`` without those whose id isn't the least of its component; rows with a null id stay."""
    found = near_vectors(rows, threshold, vector=vector)
    lost = found.where(F.col("vec_id").isNotNull() & ~F.col("kept")).select(F.col("vec_id").alias("__lost")).distinct()
    plain = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))
    return plain.join(lost, F.col(f"c{rows.columns.index('vec_id')}").cast("long") == F.col("__lost"), "left_anti").toDF(*rows.columns)
