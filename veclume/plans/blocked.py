"""Exact k nearest neighbours of a stated query set, in blocks, without a cross join.

Queries come to the driver in blocks of bounded size; each block is broadcast as
a matrix. A task holds the k least (exact distance, id) of each query while it
streams over its rows and emits k rows a query; ``topk`` merges them. A matrix
product a batch finds the rows within rounding of the k-th distance; all of
them, however many tie, are ordered by exact distance and id. The shuffle carries k rows a query and task, whatever the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veclume.operators.topk import topk

#: Queries of a block, and bytes of its matrix, at most.
BLOCK_QUERIES = 2048
BLOCK_BYTES = 32 << 20
#: Exact distances computed at once.
CANDIDATES = 1 << 17


def matrix(column: pa.Array, dimension: int | None = None) -> np.ndarray:
    """A list column as rows x dimension; rows of another length raise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dimension or 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = dimension or len(flat) // len(column)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != width).any():
        raise ValueError(f"vectors of unequal length: {int(sizes[sizes != width][0])}, not {width}")
    return flat.reshape(len(column), width)


#: A metric by name (``minkowski:p`` with its exponent), or a function of two matrices that gives the distances of their rows.
Metric = str | Callable[[np.ndarray, np.ndarray], np.ndarray]


def rough(x: np.ndarray, q: np.ndarray, metric: Metric) -> np.ndarray:
    """rows x queries distances, fast; smaller is nearer."""
    if metric == "euclidean":
        return (x * x).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (x @ q.T)
    if metric == "dot":
        return -(x @ q.T)
    if metric == "cosine":
        return 1 - _cosine(x @ q.T, np.sqrt((x * x).sum(1))[:, None] * np.sqrt((q * q).sum(1))[None, :])
    out = np.empty((len(x), len(q)))
    for k, v in enumerate(q):
        out[:, k] = exact(x, np.broadcast_to(v, x.shape), metric)
    return out


def _cosine(dot: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.clip(np.divide(dot, size, out=np.zeros_like(dot), where=size > 1.17549435e-38), -1, 1)


def _minkowski(x: np.ndarray, y: np.ndarray, p: float) -> np.ndarray:
    """As ``functions.vector.minkowski``: scaled by the greatest difference, which stands for p over 30."""
    if p <= 0:
        raise ValueError("p must be positive")
    d = np.abs(x - y)
    if abs(p - 1) < 1e-3:
        return d.sum(1)
    most = d.max(1, initial=0)
    if p > 30:
        return most
    size = np.where(most > 0, most, 1)[:, None]
    return np.where(most > 0, most * (np.where(d < 1e-10, 0, d / size) ** p).sum(1) ** (1 / p), 0.0)


def exact(x: np.ndarray, y: np.ndarray, metric: Metric) -> np.ndarray:
    """Distances of rows of x and y, each summed alike wherever it stands."""
    if callable(metric):
        return np.asarray(metric(x, y), float)
    if metric.startswith("minkowski:"):
        return _minkowski(x, y, float(metric.partition(":")[2]))
    if metric == "euclidean":
        return ((x - y) ** 2).sum(1)
    if metric == "manhattan":
        return np.abs(x - y).sum(1)
    if metric == "chebyshev":
        return np.abs(x - y).max(1, initial=0)
    if metric == "dot":
        return -(x * y).sum(1)
    if metric == "cosine":
        return 1 - _cosine((x * y).sum(1), np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
    if metric == "packed":  # words of at most 53 bits, as floats hold them
        return np.bitwise_count(x.astype(np.uint64) ^ y.astype(np.uint64)).sum(1).astype(float)
    if metric == "hamming":
        return ((x > 0) != (y > 0)).sum(1).astype(float)
    if metric == "jaccard":
        high = np.maximum(x, y).sum(1)
        return np.where(high <= 1e-8, 1.0, 1 - np.minimum(x, y).sum(1) / np.where(high <= 1e-8, 1, high))
    raise ValueError(f"unknown metric {metric}")


def query_blocks(queries: DataFrame, query_id: str, vec: str) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, matrix) of queries, streamed through the driver in blocks of bounded size."""
    ids, rows = [], []
    for i, v in queries.select(query_id, vec).where(F.col(query_id).isNotNull() & F.col(vec).isNotNull()).toLocalIterator():
        ids.append(i)
        rows.append(v)
        if len(ids) >= BLOCK_QUERIES or len(ids) * len(v) * 8 >= BLOCK_BYTES:
            yield ids, np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows, np.float64)


def _rounding(x: np.ndarray, q: np.ndarray, d: np.ndarray, metric: Metric) -> np.ndarray:
    """rows x queries bounds of what ``rough`` and ``exact`` may differ by."""
    unit = 4 * (x.shape[1] + 4) * np.finfo(float).eps
    if metric == "euclidean":
        return unit * ((x * x).sum(1)[:, None] + (q * q).sum(1)[None, :])
    if metric == "dot":
        return unit * np.sqrt((x * x).sum(1))[:, None] * np.sqrt((q * q).sum(1))[None, :]
    return np.full(d.shape, 2 * unit) if metric == "cosine" else unit * np.abs(d)


class Nearest:
    """The k least (exact distance, id) of each query over the rows seen so far."""

    def __init__(self, queries: np.ndarray, k: int, metric: Metric) -> None:
        self.queries, self.k, self.metric = queries, k, metric
        self.row, self.id, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # by query, distance, id
        self.bound = np.full(len(queries), np.inf)

    def add(self, x: np.ndarray, ids: np.ndarray, skip: np.ndarray | None = None) -> None:
        """x: rows with their ids; skip: queries x rows to leave out. What rounding leaves open is settled by exact distances."""
        with np.errstate(invalid="ignore", over="ignore"):
            d = rough(x, self.queries, self.metric)
            slack = _rounding(x, self.queries, d, self.metric)
            low, high = (d - slack).T, (d + slack).T
        high = np.where(np.isfinite(high), high, np.inf)
        if skip is not None:
            high[skip] = np.inf
        bound = self.bound
        if high.shape[1] >= self.k:
            bound = np.minimum(bound, np.partition(high, self.k - 1, axis=1)[:, self.k - 1])
        near = ~(low > bound[:, None])  # distances that are not numbers stay in
        if skip is not None:
            near &= ~skip
        row, col = np.nonzero(near)
        for a in range(0, len(row), CANDIDATES):
            r, c = row[a : a + CANDIDATES], col[a : a + CANDIDATES]
            with np.errstate(invalid="ignore", over="ignore"):
                self._merge(r, ids[c], exact(x[c], self.queries[r], self.metric))

    def _merge(self, row: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        row, ids, d = np.concatenate([self.row, row]), np.concatenate([self.id, ids]), np.concatenate([self.d, d])
        order = np.lexsort((ids, d, row))
        row, ids, d = row[order], ids[order], d[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.row, self.id, self.d = row[keep], ids[keep], d[keep]
        last = rank == self.k - 1
        self.bound[row[last]] = np.where(np.isnan(d[last]), np.inf, d[last])


def _block(db: DataFrame, ids: list, q: np.ndarray, k: int, metric: Metric, db_id: str, vec: str, exclude_self: bool) -> DataFrame:
    held = db.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = held.value
        names = np.array(names)
        best = Nearest(queries, k, metric)
        for batch in batches:
            if not len(batch):
                continue
            x, own = matrix(batch.column(1), queries.shape[1]), batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(x), 4096):
                part_ids = own[a : a + 4096]
                best.add(x[a : a + 4096], part_ids, part_ids[None, :] == names[:, None] if exclude_self else None)
        yield pa.RecordBatch.from_arrays([pa.array(names[best.row], pa.int64()), pa.array(best.id), pa.array(best.d)], ["query_id", "id", "distance"])

    return db.select(F.col(db_id).cast("long"), vec).mapInArrow(run, "query_id long, id long, distance double")


def knn(db: DataFrame, queries: DataFrame, k: int, metric: Metric = "euclidean", db_id: str = "vec_id", query_id: str = "vec_id", vec: str = "embedding", where: Column | None = None, exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of db; ties by id.

    where filters db before the search, so k rows come back if k match. Rows
    with a null vector or id take no part. euclidean gives squared L2.
    """
    db = db if where is None else db.where(where)
    db = db.where(F.col(db_id).isNotNull() & F.col(vec).isNotNull())
    parts = [_block(db, ids, q, k, metric, db_id, vec, exclude_self) for ids, q in query_blocks(queries, query_id, vec)]
    if not parts:
        return db.sparkSession.createDataFrame([], "query_id long, rank long, id long, distance double")
    found = reduce(DataFrame.unionByName, parts)
    return topk(found, "query_id", ["distance", "id"], k).select("query_id", "rank", "id", "distance")


def pairwise(db: DataFrame, queries: DataFrame, metric: Metric = "euclidean", db_id: str = "vec_id", query_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, id, distance) of a stated query set against all rows: the distance matrix, in long form; nothing is shuffled."""
    return within(db, queries, float("inf"), metric, db_id, query_id, vec)


def most_similar(db: DataFrame, queries: DataFrame, k: int, metric: Metric = "jaccard", db_id: str = "vec_id", query_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, id, similarity): greatest 1 - distance first, ties by id."""
    near = knn(db, queries, k, metric, db_id, query_id, vec)
    return near.select("query_id", "rank", "id", (1 - F.col("distance")).alias("similarity"))


def within(db: DataFrame, queries: DataFrame, radius: float, metric: Metric = "euclidean", db_id: str = "vec_id", query_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, id, distance) of all rows within the radius of a query (a range join); nothing is shuffled."""
    db = db.where(F.col(db_id).isNotNull() & F.col(vec).isNotNull())
    parts = []
    for ids, q in query_blocks(queries, query_id, vec):
        held = db.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, queries = held.value
            for batch in batches:
                x, own = matrix(batch.column(1), queries.shape[1]), batch.column(0).to_numpy(zero_copy_only=False)
                for a in range(0, len(x), 4096):
                    part = x[a : a + 4096]
                    near = rough(part, queries, metric) <= radius + 1e-6 * max(1.0, abs(radius)) if np.isfinite(radius) else np.ones((len(part), len(queries)), bool)
                    i, j = np.nonzero(near)
                    for b in range(0, len(i), CANDIDATES):
                        r, c = i[b : b + CANDIDATES], j[b : b + CANDIDATES]
                        d = exact(part[r], queries[c], metric)
                        keep = (d <= radius) | (not np.isfinite(radius))
                        yield pa.RecordBatch.from_arrays([pa.array(np.array(names)[c[keep]], pa.int64()), pa.array(own[a : a + 4096][r[keep]], pa.int64()), pa.array(d[keep])], ["query_id", "id", "distance"])

        parts.append(db.select(F.col(db_id).cast("long"), vec).mapInArrow(run, "query_id long, id long, distance double"))
    return reduce(DataFrame.unionByName, parts) if parts else db.sparkSession.createDataFrame([], "query_id long, id long, distance double")
