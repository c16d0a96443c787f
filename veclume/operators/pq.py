"""Product quantization: codebooks by k-means of sub-vectors, codes, asymmetric distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclume.functions.vector import l2
from veclume.operators.kmeans import nearest
from veclume.operators.topk import topk
from veclume.plans.blocked import matrix, query_blocks

MAX_CODES = 256


def train(df: DataFrame, m: int, k: int = MAX_CODES, iterations: int = 25, tolerance: float = 1e-3, seed: int = 0, id_col: str = "vec_id", vec: str = "embedding", progress: Callable[[int, float], None] | None = None, init: np.ndarray | None = None) -> np.ndarray:
    """m x k x d codebook. First centroids: init (k vectors), or rows chosen by a hash; codes without vectors keep theirs.

    An iteration is one pass: sums by sub-space and code on each task, m x k rows
    a task in the shuffle.
    """
    if not 0 < k <= MAX_CODES:
        raise ValueError(f"k must be 1 to {MAX_CODES}")
    x = init
    if x is None:
        first = df.select(id_col, vec).where(F.col(vec).isNotNull()).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(k)
        x = matrix(first.toArrow().column(vec))
    if len(x) < k or x.shape[1] % m:
        raise ValueError(f"{len(x)} vectors of {x.shape[1]} for {m} sub-spaces of {k} codes")
    rows = df.select(vec).where(F.col(vec).isNotNull()).persist()  # read once; what is lost is read again
    try:
        return _lloyd(rows, x.reshape(k, m, -1).transpose(1, 0, 2).copy(), iterations, tolerance, vec, progress)
    finally:
        rows.unpersist()


def _lloyd(df: DataFrame, book: np.ndarray, iterations: int, tolerance: float, vec: str, progress: Callable[[int, float], None] | None) -> np.ndarray:
    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py()) for b in group.column("sums"))
        return pa.table({"m": group.column("m")[:1], "k": group.column("k")[:1], "n": pa.array([int(group.column("n").to_numpy().sum())]), "sums": pa.array([total.tobytes()], pa.binary())})

    for step in range(1, iterations + 1):
        held = df.sparkSession.sparkContext.broadcast(book)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            b = held.value
            sums, counts = np.zeros_like(b), np.zeros(b.shape[:2], np.int64)
            for batch in batches:
                y = matrix(batch.column(0), b.shape[0] * b.shape[2])
                for s in range(b.shape[0]):
                    part = y[:, s * b.shape[2] : (s + 1) * b.shape[2]]
                    at, _ = nearest(part, b[s])
                    np.add.at(sums[s], at, part)
                    counts[s] += np.bincount(at, minlength=b.shape[1])
            s, c = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(c), pa.array(counts[s, c]), pa.array([v.tobytes() for v in sums[s, c]], pa.binary())], ["m", "k", "n", "sums"])

        parts = df.select(vec).mapInArrow(run, "m long, k long, n long, sums binary")
        new = book.copy()
        for r in parts.groupBy("m", "k").applyInArrow(add, parts.schema).collect():  # a row a code
            new[r.m, r.k] = np.frombuffer(r.sums) / r.n
        moved = float(np.sqrt(((new - book) ** 2).sum() / (book.shape[0] * book.shape[1])))
        book = new
        if progress:
            progress(step, moved)
        if moved < tolerance:
            break
    return book


def encode(df: DataFrame, book: np.ndarray, vec: str = "embedding") -> DataFrame:
    """Adds codes ARRAY<SMALLINT>; ties to the lowest code."""
    held = df.sparkSession.sparkContext.broadcast(book)
    at_vec = df.columns.index(vec)
    names = [*df.columns, "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        d = b.shape[2]
        for batch in batches:
            x = matrix(batch.column(at_vec), b.shape[0] * d)
            codes = np.stack([nearest(x[:, s * d : (s + 1) * d], b[s])[0] for s in range(b.shape[0])], axis=1) if len(x) else np.zeros((0, b.shape[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(codes.astype(np.int16)), pa.list_(pa.int16()))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", codes array<smallint>"
    return df.where(F.col(vec).isNotNull()).mapInArrow(run, schema)


def decode(df: DataFrame, book: np.ndarray, out: str = "decoded") -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(book)
    at = df.columns.index("codes")
    names = [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        for batch in batches:
            codes = matrix(batch.column(at), b.shape[0]).astype(np.int64)
            y = b[np.arange(b.shape[0])[None, :], codes].reshape(len(codes), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(y), pa.list_(pa.float64()))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` array<double>"
    return df.mapInArrow(run, schema)


def search(coded: DataFrame, book: np.ndarray, queries: DataFrame, k: int, id_col: str = "vec_id", query_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance): by tables of each query's distances to all codes; root of their sum."""
    parts = []
    for ids, q in query_blocks(queries, query_id, vec):
        m, _, d = book.shape
        tables = np.stack([((q[:, None, s * d : (s + 1) * d] - book[s][None]) ** 2).sum(axis=2) for s in range(m)], axis=1)
        held = coded.sparkSession.sparkContext.broadcast((np.array(ids), tables))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, t = held.value
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(names)
            for batch in batches:
                own, codes = batch.column(0).to_numpy(), matrix(batch.column(1), t.shape[1]).astype(np.int64)
                for r in range(len(names)):
                    dist = np.concatenate([best[r][0], np.sqrt(t[r][np.arange(t.shape[1])[None, :], codes].sum(axis=1))])
                    at = np.concatenate([best[r][1], own])
                    order = np.lexsort((at, dist))[:k]
                    best[r] = dist[order], at[order]
            for r, (dist, at) in enumerate(best):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), names[r]), pa.int64()), pa.array(at, pa.int64()), pa.array(dist)], ["query_id", "id", "distance"])

        parts.append(coded.select(F.col(id_col).cast("long"), "codes").mapInArrow(run, "query_id long, id long, distance double"))
    if not parts:
        return coded.sparkSession.createDataFrame([], "query_id long, rank long, id long, distance double")
    return topk(reduce(DataFrame.unionByName, parts), "query_id", ["distance", "id"], k).select("query_id", "rank", "id", "distance")


def reranked(coded: DataFrame, book: np.ndarray, queries: DataFrame, k: int, candidates: int, id_col: str = "vec_id", query_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance): the k nearest by exact L2 among so many candidates a query that ``search`` finds."""
    near = search(coded, book, queries, candidates, id_col, query_id, vec).select("query_id", "id")
    own = coded.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v"))
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vec).alias("q"))
    found = near.join(own, "id").join(asked, "query_id").select("query_id", "id", l2("q", "v").alias("distance"))
    return topk(found, "query_id", ["distance", "id"], k).select("query_id", "rank", "id", "distance")
