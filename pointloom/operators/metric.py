"""Neighbours in many dimensions: cells around pivots, and bounds by the triangle inequality on what a query has to meet.

Some rows, PIVOTS at most, are pivots; every row belongs to the cell of its nearest. A cell's rows are no farther from its pivot than its
radius, so for a query a cell holds nothing nearer than the distance to the pivot less the radius, nor than half of what the pivot is
farther than the query's own. A query meets the cells only whose bound is within what it looks for.
Neighbouring cells are put together into tiles of up to PIECE_ROWS rows, so a query is sent once to a tile, however many of its cells it
meets. Larger cells are cut into pieces, and so are the queries that meet a tile: a task has PIECE_ROWS of rows and QUERY_ROWS of queries at most.
In a task a product of matrices in single precision says which pairs may count, and only those are measured in full.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.operators.checkpoints import cut

PIVOTS = 1024
PIECE_ROWS, QUERY_ROWS = 16384, 16384
#: Numbers in a matrix of distances at most, and pairs that are measured at once.
MATRIX, PAIRS = 1 << 21, 1 << 16
#: What rounding may take from a distance, as a share of it.
ROUNDING = 1e-9


def wider(df: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in columns.items()]])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of a column of arrays of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, added up dimension by dimension as a sum over the arrays would be."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        d *= d
        out += d
    return out


def sound(df: DataFrame, vectors: list[str]) -> DataFrame:
    """The rows whose vectors have numbers only."""
    for v in vectors:
        df = df.filter(F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double"))))
    return df


def pivots_of(rows: DataFrame, vector: str) -> np.ndarray:
    """The vectors of about a quarter as many rows as the root of all, those with the least hashes; PIVOTS at most."""
    n = min(PIVOTS, math.isqrt(rows.count()) // 4 + 1)
    few = rows.select(F.xxhash64(vector).alias("_h"), vector).orderBy("_h").limit(n).select(vector).collect()
    return np.array([[float(x) for x in r[0]] for r in few]) if few else np.zeros((0, 0))


def in_cells(df: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    """df with cell, the number of the nearest pivot, and cell_distance."""
    schema = wider(df, cell=T.IntegerType(), cell_distance=T.DoubleType())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            v, cell, far = matrix(b.column(vector)), [], []
            for at in range(0, len(v), max(1, MATRIX // len(pivots))):
                d = squared(v[at : at + max(1, MATRIX // len(pivots))], pivots)
                c = d.argmin(1)
                cell.append(c)
                far.append(np.sqrt(d[np.arange(len(c)), c]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(cell), pa.int32()), pa.array(np.concatenate(far))], [*b.schema.names, "cell", "cell_distance"])

    return df.mapInArrow(placed, schema)


def cells_within(queries: DataFrame, vector: str, pivots: np.ndarray, radii: np.ndarray, limit: str | float, used: np.ndarray) -> DataFrame:
    """queries with cells, those that may hold a row within `limit` (a column or a number); used: cells that have rows."""
    fixed = None if isinstance(limit, str) else float(limit)
    schema = wider(queries, cells=T.ArrayType(T.IntegerType()))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            v, lists = matrix(b.column(vector)), []
            most = np.full(len(v), fixed) if fixed is not None else b.column(limit).to_numpy(zero_copy_only=False)
            for at in range(0, len(v), max(1, MATRIX // len(pivots))):
                d = np.sqrt(squared(v[at : at + max(1, MATRIX // len(pivots))], pivots))
                least = np.maximum(d - radii, (d - d.min(1, keepdims=True)) / 2)
                ok = used & (least <= most[at : at + len(d), None] + ROUNDING * (d + radii + 1))
                lists += [np.flatnonzero(x).astype(np.int32) for x in ok]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists), pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, cells], [*b.schema.names, "cells"])

    return queries.mapInArrow(bounded, schema)


def tiles(pivots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each cell's tile: cells are split at the middle of their rows along the axis on which their pivots are widest, until a tile has PIECE_ROWS."""
    out, todo, n = np.zeros(len(sizes), np.int32), [np.arange(len(sizes))], 0
    while todo:
        some = todo.pop()
        if len(some) == 1 or sizes[some].sum() <= PIECE_ROWS:
            out[some], n = n, n + 1
            continue
        some = some[np.argsort(pivots[some, np.ptp(pivots[some], axis=0).argmax()], kind="stable")]
        upto = np.cumsum(sizes[some])
        at = min(max(int(np.searchsorted(upto, upto[-1] / 2)), 1), len(some) - 1)
        todo += [some[:at], some[at:]]
    return out


def tiles_met(cells: str, tile: np.ndarray) -> Column:
    """The tiles of a column of cells."""
    of = F.lit([int(x) for x in tile])
    return F.array_distinct(F.transform(cells, lambda c: F.get(of, c)))


def meet(queries: DataFrame, rows: DataFrame, sizes: np.ndarray, tile: np.ndarray, vectors: list[str], search: Callable, extra: str, keep: list[str] | None = None) -> DataFrame:
    """(a_id, b_id, extra) of search over what each query meets.

    queries: id, vectors, the columns `keep` and tiles; rows: id, vectors and cell; sizes: the cells' rows. search gets two dicts of matrices
    with their ids (and of `keep`), rows by ascending id, and gives the places in both, and the extra columns.
    """
    spark, keep = queries.sparkSession, keep or []
    asked = {r["tile"]: r["n"] for r in queries.select(F.explode("tiles").alias("tile")).groupBy("tile").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a tile, PIVOTS at most
    held = np.bincount(tile, weights=sizes)
    cuts = [(t, int(max(1, -(-held[t] // PIECE_ROWS))), int(-(-n // QUERY_ROWS))) for t, n in asked.items()]
    table = spark.createDataFrame(cuts, "_tile int, _pieces int, _blocks int")
    of = spark.createDataFrame([(c, int(t)) for c, t in enumerate(tile)], "_cell int, tile int")
    hashed = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.select("id", *vectors, *keep, F.explode("tiles").alias("tile")).join(F.broadcast(table), F.col("tile") == F.col("_tile"))  # a row a tile, PIVOTS at most
    q = q.withColumn("block", hashed("_blocks")).withColumn("piece", each("_pieces")).select("id", *vectors, *keep, "tile", "piece", "block")
    known = F.broadcast(of.join(table, F.col("tile") == F.col("_tile")).select("_cell", "tile", "_pieces", "_blocks"))  # a row a cell, PIVOTS at most
    r = rows.join(known, F.col("cell") == F.col("_cell")).withColumn("piece", hashed("_pieces")).withColumn("block", each("_blocks")).select("id", *vectors, "tile", "piece", "block")
    names = [x.split()[0] for x in extra.split(", ")]
    empty = {"a_id": pa.array([], pa.int64()), "b_id": pa.array([], pa.int64())} | {n: pa.array([], pa.float64()) for n in names}

    def task(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table(empty)
        right = right.sort_by("id")
        a, b = ({"id": t.column("id").to_numpy()} | {v: matrix(t.column(v)) for v in vectors} for t in (left, right))
        a |= {n: left.column(n).to_numpy() for n in keep}
        parts, stride = [], max(1, MATRIX // len(right))
        for at in range(0, len(left), stride):
            some = {k: x[at : at + stride] for k, x in a.items()}
            i, j, more = search(some, b)
            parts.append([some["id"][i], b["id"][j], *more])
        return pa.table(dict(zip(["a_id", "b_id", *names], map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    keys = "tile", "piece", "block"
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(task, f"a_id long, b_id long, {extra}")


def of_pairs(measure: Callable, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """measure (of two matrices, row by row) of the rows i of a and j of b, PAIRS at a time."""
    parts = [measure(a[i[at : at + PAIRS]], b[j[at : at + PAIRS]]) for at in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances row by row, added up as `squared` does."""
    out = np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        d = x - y
        d *= d
        out += d
    return out


def rough(a: np.ndarray, known: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances of all rows of a to all of known[name], how far each row's may be off).

    Vectors are taken from the rows' mean and multiplied in single precision; where numbers are too large for that, or infinite,
    distances are those of `squared` and not off. What is needed of known is kept there.
    """
    b = known[name]
    if f"_{name}" not in known:
        with np.errstate(invalid="ignore", over="ignore"):
            mean = b.mean(0)
            w = b - mean
            own, far = (w * w).sum(1), (b * b).sum(1).max()
        fits = bool(np.isfinite(far) and far < 1e30)
        known[f"_{name}"] = mean, np.column_stack([-2 * w, own]).astype(np.float32).T if fits else None, own.max(), far
    mean, product, most, far = known[f"_{name}"]
    with np.errstate(invalid="ignore", over="ignore"):
        w = a - mean
        own, raw = (w * w).sum(1), (a * a).sum(1)
    if product is None or not np.all(raw < 1e30):
        return squared(a, b), np.zeros(len(a))
    d = np.column_stack([w, np.ones(len(w))]).astype(np.float32) @ product
    d += own[:, None].astype(np.float32)
    return d, 2 * (a.shape[1] + 8) * 2.0**-24 * (own + most) + 1e-14 * (raw + far) + 1e-36


def kth_of(d: np.ndarray, k: int) -> np.ndarray:
    """The k-th least of each row of d."""
    k = min(k, d.shape[1])
    return np.partition(d, k - 1, axis=1)[:, k - 1].astype(float)


def first_of(i: np.ndarray, k: int, *by: np.ndarray) -> np.ndarray:
    """Places of the first k of each number in i in the order of by, those of one number together."""
    order = np.lexsort((*reversed(by), i))
    at = i[order]
    return order[np.arange(len(at)) - np.searchsorted(at, at) < k]


def k_nearest(a: dict, b: dict, name: str, k: int, skip_self: bool, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, squared distance): the k nearest rows b (by ascending id) of each a, and none farther than `most`, each row's limit."""
    d, off = rough(a[name], b, name)
    if skip_self:
        own = np.minimum(np.searchsorted(b["id"], a["id"]), len(b["id"]) - 1)
        same = np.flatnonzero(b["id"][own] == a["id"])
        d[same, own[same]] = np.inf
    limit = np.full(len(d), np.inf) if most is None else most * most * (1 + 1e-9) + off
    found = d <= limit[:, None]
    if most is None or np.count_nonzero(found) > 8 * k * len(d):
        limit = np.minimum(limit, kth_of(d, k) + 2 * off)
        found = d <= limit[:, None]
    i, j = np.nonzero(found & (d < np.inf))
    exact = of_pairs(apart, a[name], b[name], i, j)
    keep = first_of(i, k, exact, j)
    return i[keep], j[keep], exact[keep]


def indexed(rows: DataFrame, key: str, vectors: dict[str, str], by: str) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """(rows in cells with id and vectors, written out once; pivots; radii; sizes). `by` is the vector that cells go by."""
    r = sound(rows.select(F.col(key).cast("long").alias("id"), *[F.col(c).alias(n) for n, c in vectors.items()]), list(vectors))
    pivots = pivots_of(r, by)
    if not len(pivots):
        return r.withColumns({"cell": F.lit(0), "cell_distance": F.lit(0.0)}), pivots, np.zeros(0), np.zeros(0, int)
    r = cut(in_cells(r, by, pivots))
    radii, sizes = np.zeros(len(pivots)), np.zeros(len(pivots), int)
    for x in r.groupBy("cell").agg(F.max("cell_distance").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # a row a cell, PIVOTS at most
        radii[x["cell"]], sizes[x["cell"]] = x["r"], x["n"]
    return r, pivots, radii, sizes
