"""Exact and approximate nearest neighbours as block products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept

#: Rows of a query block and of an index block; a task multiplies one with one, ``STEP`` queries at a time.
QUERY_ROWS, INDEX_ROWS, STEP = 4096, 16384, 256

#: Similarities that a task holds at once, besides the best so far.
TILE = 1 << 19

_PACKED = "ids binary, vectors binary, dim int"
_FOUND = pa.schema([("query_id", pa.int64()), ("idx_id", pa.int64()), ("sim", pa.float64())])
_COMPARED = _FOUND.append(pa.field("compared", pa.int64()))


def _pack(df: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
    """(``name``, ids, vectors, dim): blocks of about ``rows`` rows of one dimension, ids ascending; and the number of blocks.

    Only the number of rows comes to the driver.
    """
    df = _tidy(df)
    n = max(1, -(-df.count() // rows))

    def pack(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        ids, x = t["id"].to_numpy(), t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        order = np.argsort(ids, kind="stable")
        return pa.table({name: t[name][:1], "ids": pa.array([ids[order].astype("<i8").tobytes()]), "vectors": pa.array([x[order].astype("<f8").tobytes()]), "dim": t["dim"][:1]})

    placed = df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("dim", F.size("v"))
    return kept(placed.groupBy(name, "dim").applyInArrow(pack, f"{name} int, {_PACKED}"), name), n


def _tidy(df: DataFrame) -> DataFrame:
    """(id, v) of the rows with an id and a vector whose components are all numbers."""
    df = df.toDF("id", "v").select(F.col("id").cast("long"), F.col("v").cast("array<double>").alias("v"))
    return df.where("id is not null and size(v) > 0").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def _matrix(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors; the zero vector stays."""
    x = np.frombuffer(vectors, "<f8").reshape(-1, dim)
    return np.frombuffer(ids, "<i8"), x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def best(q_ids: np.ndarray, q: np.ndarray, i_ids: np.ndarray, i: np.ndarray, k: int, metric: str, exclude_self: bool) -> pa.Table:
    """(query_id, idx_id, sim) of each query's ``k`` best, ties to the lower id; ``i_ids`` ascend."""
    out, squares = [], (i * i).sum(axis=1)
    step = max(1, min(STEP, TILE // max(1, len(i))))
    for s in range(0, len(q), step):
        a = q[s : s + step]
        sim = a @ i.T
        if metric == "l2":
            sim *= 2
            sim -= (a * a).sum(axis=1)[:, None]
            sim -= squares
        np.round(sim, 9, out=sim)
        if exclude_self:
            sim[q_ids[s : s + step, None] == i_ids] = -np.inf
        take = min(k, sim.shape[1])
        least = np.partition(sim, -take, axis=1)[:, -take]
        row, col = np.nonzero((sim >= least[:, None]) & (sim > -np.inf))
        value = sim[row, col]
        order = np.lexsort((col, -value, row))
        row, col, value = row[order], col[order], value[order]
        near = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append(pa.table([q_ids[s + row[near]], i_ids[col[near]], value[near]], schema=_FOUND))
    return pa.concat_tables([_FOUND.empty_table(), *out])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query of (query_id, idx_id, sim), numbered from 1 by similarity, then id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "idx_id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "idx_id", "rank", "sim")


def knn(queries: DataFrame, index: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """(query_id, idx_id, rank, sim) of the ``k`` nearest; both inputs are (id, vector).

    Both sides are packed into blocks, and every query block meets every index
    block of its dimension in a task of its own, which keeps the ``k`` best of each
    query; these are merged by rank.  One job, whatever the number of queries;
    no vector reaches the driver.  Distances are squared Euclidean on unit vectors
    for ``l2`` (negated, as 2ab - aa - bb), nearest first.  Ranks are by similarity
    rounded to nine digits, then by id.  Rows with a null id or vector, or a
    component that is no number, are left out; queries without any neighbour give
    no row.
    """
    (q, n_q), (i, n_i) = _pack(queries, QUERY_ROWS, "qb"), _pack(index, INDEX_ROWS, "ib")
    # each block once for every block of the other side
    left = q.withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(n_i - 1))))
    right = i.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        pairs = ((x, y) for x in zip(*(a[c].to_pylist() for c in ("ids", "vectors", "dim")), strict=True) for y in zip(*(b[c].to_pylist() for c in ("ids", "vectors", "dim")), strict=True))
        return pa.concat_tables([_FOUND.empty_table(), *(best(*_matrix(*x), *_matrix(*y), k, metric, exclude_self) for x, y in pairs)])

    keys = ["qb", "ib", "dim"]
    return ranked(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(multiply, "query_id long, idx_id long, sim double"), k)


# ---------------------------------------------------------------- approximate

#: Rows that cells are fitted on, and cells at most.
SAMPLE_ROWS, MOST_CELLS = 20_000, 4096

#: Numbers of index vectors that a task looks at together.
GATHERED = 1 << 21


def fit_cells(index: DataFrame, cells: int, sample: int = SAMPLE_ROWS, rounds: int = 10, seed: str = "cells") -> np.ndarray:
    """Centres of cells by spherical k-means over a bounded sample drawn by digest, at most ``sample`` rows of (id, vector), of the first one's length."""
    from ..functions.arrays import seeded

    drawn = _tidy(index).orderBy(seeded(seed, F.col("id")), "id").limit(sample).collect()
    x = np.array([r.v for r in drawn if len(r.v) == len(drawn[0].v)], float)
    if not len(x):
        return np.zeros((1, 0))
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    c = x[: min(cells, len(x))].copy()
    for _ in range(rounds):
        at = closest_cells(x, c)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def closest_cells(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cell of each row, ``STEP`` rows at a time."""
    return np.concatenate([np.zeros(0, np.int64), *((x[s : s + STEP] @ centres.T).argmax(axis=1) for s in range(0, len(x), STEP))])


def probed_cells(x: np.ndarray, centres: np.ndarray, held: np.ndarray, probe: float) -> np.ndarray:
    """For each row, which cells it probes: its nearest ones, until they hold the share ``probe`` of all rows; eight cells a byte."""
    out = [np.zeros((0, -(-len(held) // 8)), np.uint8)]
    for s in range(0, len(x), STEP):
        order = np.argsort(-(x[s : s + STEP] @ centres.T), axis=1, kind="stable")
        there = held[order]
        before = np.cumsum(there, axis=1) - there
        probed = np.zeros(order.shape, bool)
        np.put_along_axis(probed, order, (before < probe * held.sum()) & (there > 0), 1)
        out.append(np.packbits(probed, axis=1))
    return np.concatenate(out)


def sketches(x: np.ndarray, bits: int) -> np.ndarray:
    """The signs of random projections, 64 to a word; the projections are the same everywhere."""
    planes = np.random.default_rng(20_260).standard_normal((x.shape[1], bits))
    return np.concatenate([np.zeros((0, bits // 8), np.uint8), *(np.packbits(x[s : s + STEP] @ planes > 0, axis=1) for s in range(0, len(x), STEP))]).view(np.uint64)


def closest_sketches(q: np.ndarray, i: np.ndarray, take: int) -> np.ndarray:
    """The places of the ``take`` rows of ``i`` that differ least from each row of ``q``."""
    apart = np.zeros((len(q), len(i)), np.uint16)
    for w in range(q.shape[1]):
        apart += np.bitwise_count(q[:, w, None] ^ i[:, w])
    return np.argpartition(apart, take - 1, axis=1)[:, :take] if take < len(i) else np.broadcast_to(np.arange(len(i)), apart.shape)


def best_of_cells(q: np.ndarray, sq: np.ndarray, probed: np.ndarray, i_ids: np.ndarray, i: np.ndarray, si: np.ndarray, cell: np.ndarray, part: np.ndarray, k: int, refine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, id, sim) of each query's ``k`` best of the cells in a block that it probes, and how many rows each query was compared with.

    Rows of the block are in order of cell, part and id; in each part of a cell the
    sketches pick the share ``refine`` of its rows.
    """
    compared, found = np.zeros(len(q), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])]) if len(cell) else cell
    for a, b in zip(starts, [*starts[1:], len(cell)], strict=True):
        asking = np.flatnonzero(probed[:, cell[a] >> 3] >> (7 - (cell[a] & 7)) & 1)
        y, ids, take = i[a:b], i_ids[a:b], max(1, round(refine * (b - a)))
        compared[asking] += take
        step = max(1, min(STEP, GATHERED // (take * y.shape[1])))
        for s in range(0, len(asking), step):
            row = asking[s : s + step]
            at = np.sort(closest_sketches(sq[row], si[a:b], take), axis=1)
            sim = np.round(np.matmul(y[at], q[row][:, :, None])[:, :, 0], 9)
            near = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            found.append((np.repeat(row, near.shape[1]), ids[np.take_along_axis(at, near, 1)].ravel(), np.take_along_axis(sim, near, 1).ravel()))
    row, ids, sim = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((ids, -sim, row))
    order = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < k]
    return row[order], ids[order], sim[order], compared


def knn_cells(queries: DataFrame, index: DataFrame, k: int, probe: float = 0.9, refine: float = 0.2, bits: int = 512, cells: int | None = None) -> DataFrame:
    """Approximate (query_id, idx_id, rank, sim, compared): ``compared`` is how many rows the query was compared with in full.

    An inverted file: every row of the index goes to its nearest cell; a query
    probes its nearest cells until they hold the share ``probe`` of all rows.  In
    each probed cell, sketches of ``bits`` signs pick the share ``refine`` of rows
    that are compared in full.  Cells are fitted on a bounded sample and split into
    parts of about ``INDEX_ROWS`` rows; neighbouring cells share a block of about as
    many rows.  Queries are packed into blocks with a bitmap of the cells that each
    probes, so a query goes once to each block of the index, not to each cell, and
    the ``k`` best of a block come back.  ``probe`` spares work where vectors
    cluster; vectors without structure need most cells for a high recall, and then
    sketches spare the comparisons.  Rows are left out as by ``knn``, and so are
    vectors of another length than the sample's first.
    """
    q, i = _tidy(queries), _tidy(index)
    spark, n_i = q.sparkSession, i.count()
    centres = fit_cells(i, cells or min(MOST_CELLS, max(8, int(n_i**0.5))))
    shared = spark.sparkContext.broadcast(centres)  # MOST_CELLS vectors at most

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(cell=closest_cells(_units(f["v"]), shared.value))

    dim = F.size("v") == centres.shape[1]
    placed = kept(i.where(dim).mapInPandas(place, "id long, v array<double>, cell int"), "cells")
    sizes = {r[0]: r[1] for r in placed.groupBy("cell").count().collect()}  # a row a cell
    held = np.array([sizes.get(c, 0) for c in range(len(centres))])
    parts = np.maximum(1, -(-held // INDEX_ROWS))
    layout = spark.createDataFrame([(c, int(parts[c]), int(held[:c].sum()), int(held[c])) for c in range(len(centres))], "cell int, parts int, first long, rows long")
    placed = placed.join(F.broadcast(layout), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    blocks = placed.withColumn("ib", F.floor((F.col("first") + F.col("part") * F.col("rows") / F.col("parts")) / INDEX_ROWS).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        n = t["v"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        ids, cell, part = (t[c].to_numpy() for c in ("id", "cell", "part"))
        order = np.lexsort((ids, part, cell))
        ids, x = ids[order].astype("<i8").tobytes(), n[order].astype("<f8").tobytes()
        signs = sketches(_matrix(ids, x, n.shape[1])[1], bits)
        return pa.table({"ib": t["ib"][:1], "ids": pa.array([ids]), "vectors": pa.array([x]), "dim": pa.array([n.shape[1]], pa.int32()), "signs": pa.array([signs.tobytes()]), "cell": pa.array([cell[order].astype("<i4").tobytes()]), "part": pa.array([part[order].astype("<i4").tobytes()])})

    def sign(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks:
            for at in range(len(t)):
                r = t.slice(at, 1)
                x = _matrix(*(r[c][0].as_py() for c in ("ids", "vectors", "dim")))[1]
                more = {"signs": sketches(x, bits), "probed": probed_cells(x, shared.value, held, probe)}
                yield pa.RecordBatch.from_arrays([*r.columns, *(pa.array([v.tobytes()]) for v in more.values())], names=[*r.schema.names, *more])

    n_b = int(held.sum()) // INDEX_ROWS + 1
    packed = kept(blocks.select("id", "v", "cell", "part", "ib").groupBy("ib").applyInArrow(pack, f"ib int, {_PACKED}, signs binary, cell binary, part binary"), "blocks")
    asking, n_q = _pack(q.where(dim), QUERY_ROWS, "qb")
    asked = kept(asking.mapInArrow(sign, f"qb int, {_PACKED}, signs binary, probed binary"), "asked")
    # each block once for every block of the other side
    left = asked.withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(n_b - 1))))
    right = packed.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        for x, y in ((x, y) for x in a.to_pylist() for y in b.to_pylist()):
            (q_ids, u), (i_ids, v) = (_matrix(r["ids"], r["vectors"], r["dim"]) for r in (x, y))
            sq, si = (np.frombuffer(r["signs"], np.uint64).reshape(-1, bits // 64) for r in (x, y))
            probed, cell, part = np.frombuffer(x["probed"], np.uint8).reshape(len(u), -1), np.frombuffer(y["cell"], "<i4"), np.frombuffer(y["part"], "<i4")
            row, ids, sim, compared = best_of_cells(u, sq, probed, i_ids, v, si, cell, part, k, refine)
            first = np.r_[True, row[1:] != row[:-1]][: len(row)]
            out.append(pa.table([q_ids[row], ids, sim, np.where(first, compared[row], 0)], schema=_COMPARED))
        return pa.concat_tables([_COMPARED.empty_table(), *out])

    keys = ["qb", "ib"]
    found = kept(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, idx_id long, sim double, compared long"), "found")
    counted = found.groupBy("query_id").agg(F.sum("compared").alias("compared"))
    return ranked(found, k).join(counted, "query_id")


def _units(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy())
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
