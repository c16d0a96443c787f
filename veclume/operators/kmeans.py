"""K-means, nearest-centroid assignment and inverted-file (IVF) search.

Centroids are few (``MAX_CENTROIDS`` at most) and travel as one broadcast
matrix. An iteration is one pass: each task adds up its vectors by centroid, so
the shuffle carries a row per centroid and task, whatever the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclume.operators.topk import topk
from veclume.plans.blocked import exact, knn, matrix, query_blocks, rough

MAX_CENTROIDS = 4096
#: Rows that initial centroids are chosen from, about.
INIT_SAMPLE = 20_000


def recommended_nlist(n: int) -> int:
    return max(8, min(4096, isqrt(max(n, 0))))


def recommended_nprobe(nlist: int, recall: float) -> int:
    share = 0.10 if recall < 0.8 else 0.15 if recall < 0.9 else 0.23 if recall < 0.95 else 0.30 if recall < 0.99 else 0.50
    return max(1, min(nlist, ceil(nlist * share)))


@dataclass
class KMeansModel:
    centroids: np.ndarray
    iterations: int
    movement: float
    converged: bool


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest centroid; ties to the lowest index."""
    d = rough(x, centroids, "euclidean")
    least = d.min(axis=1, keepdims=True)
    best = (d <= least + 1e-9 * np.maximum(1, np.abs(least))).argmax(axis=1)
    return best, exact(x, centroids[best], "euclidean") if len(x) else np.zeros(0)


def initial(df: DataFrame, k: int, seed: int = 0, how: str = "kmeans++", id_col: str = "vec_id", vec: str = "embedding") -> np.ndarray:
    """k-means++ or random rows of a sample chosen by a hash of the id; seeded."""
    if not 0 < k <= MAX_CENTROIDS:
        raise ValueError(f"k must be 1 to {MAX_CENTROIDS}")
    rows = df.select(id_col, vec).where(F.col(vec).isNotNull()).orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(max(INIT_SAMPLE, k))
    x = matrix(rows.toArrow().column(vec))
    if len(x) < k:
        raise ValueError(f"{len(x)} vectors for {k} centroids")
    if how == "random":
        return x[:k].copy()
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    d = exact(x, np.broadcast_to(x[chosen[0]], x.shape), "euclidean")
    while len(chosen) < k:
        total = d.sum()
        pick = int(rng.choice(len(x), p=d / total)) if total > 0 else int(np.setdiff1d(np.arange(len(x)), chosen)[0])
        chosen.append(pick)
        d = np.minimum(d, exact(x, np.broadcast_to(x[pick], x.shape), "euclidean"))
    return x[chosen].copy()


def update(df: DataFrame, centroids: np.ndarray, vec: str = "embedding", id_col: str = "vec_id") -> tuple[np.ndarray, np.ndarray, float, list]:
    """(sums, counts, inertia, farthest rows) by one pass; farthest: (distance, vector), one a centroid at most."""
    held = df.sparkSession.sparkContext.broadcast(centroids)
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        sums, counts, inertia = np.zeros_like(c), np.zeros(k, np.int64), np.zeros(k)
        far_d, far_v = np.full(k, -1.0), np.zeros_like(c)
        for batch in batches:
            x = matrix(batch.column(0), c.shape[1])
            if not len(x):
                continue
            at, d = nearest(x, c)
            np.add.at(sums, at, x)
            counts += np.bincount(at, minlength=k)
            inertia += np.bincount(at, d, k)
            order = np.argsort(d, kind="stable")
            far_v[at[order]] = np.where((d[order] > far_d[at[order]])[:, None], x[order], far_v[at[order]])
            np.maximum.at(far_d, at, d)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(inertia[used]), pa.array([s.tobytes() for s in sums[used]], pa.binary()), pa.array(far_d[used]), pa.array([v.tobytes() for v in far_v[used]], pa.binary())], ["c", "n", "inertia", "sums", "far_d", "far_v"])

    parts = df.select(vec).where(F.col(vec).isNotNull()).mapInArrow(run, "c long, n long, inertia double, sums binary, far_d double, far_v binary")

    def add(group: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(b.as_py()) for b in group.column("sums"))
        far = int(np.argmax(group.column("far_d").to_numpy()))
        return pa.table({"c": group.column("c")[:1], "n": pa.array([int(group.column("n").to_numpy().sum())]), "inertia": pa.array([float(group.column("inertia").to_numpy().sum())]), "sums": pa.array([s.tobytes()], pa.binary()), "far_d": group.column("far_d").take([far]), "far_v": group.column("far_v").take([far])})

    sums, counts, inertia, far = np.zeros_like(centroids), np.zeros(k, np.int64), 0.0, []
    for r in parts.groupBy("c").applyInArrow(add, parts.schema).orderBy("c").collect():
        sums[r.c], counts[r.c] = np.frombuffer(r.sums), r.n
        inertia += r.inertia
        far.append((r.far_d, np.frombuffer(r.far_v)))
    return sums, counts, inertia, sorted(far, key=lambda f: -f[0])


def fit(df: DataFrame, k: int, iterations: int = 25, tolerance: float = 1e-3, seed: int = 0, init: str | np.ndarray = "kmeans++", id_col: str = "vec_id", vec: str = "embedding") -> KMeansModel:
    """Assign, update, give empty centroids the farthest vectors, until the greatest movement is under the tolerance."""
    c = init.copy() if isinstance(init, np.ndarray) else initial(df, k, seed, init, id_col, vec)
    moved = float("inf")
    rows = df.select(id_col, vec).persist()  # read once; what is lost is read again
    try:
        for step in range(1, iterations + 1):
            sums, counts, _, far = update(rows, c, vec, id_col)
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
            for j, (_, v) in zip(np.flatnonzero(counts == 0), far, strict=False):
                new[j] = v
            moved = float(np.sqrt(((new - c) ** 2).sum(axis=1)).max())
            c = new
            if moved < tolerance:
                return KMeansModel(c, step, moved, True)
    finally:
        rows.unpersist()
    return KMeansModel(c, iterations, moved, False)


def means(df: DataFrame, by: str, vec: str = "embedding") -> DataFrame:
    """(by, i, mean): the mean vector of each group, an element a row, by one partial aggregation; null vectors take no part."""
    return df.select(by, F.posexplode(F.col(vec).cast("array<double>")).alias("i", "v")).groupBy(by, "i").agg(F.avg("v").alias("mean"))


def fit_mini_batch(df: DataFrame, k: int, steps: int, rate: float = 0.1, share: float = 0.1, seed: int = 0, init: str | np.ndarray = "kmeans++", id_col: str = "vec_id", vec: str = "embedding") -> KMeansModel:
    """Centroids moved toward the means of a batch a step: rows whose hash falls into the step's share, summed on the tasks."""
    c = init.copy() if isinstance(init, np.ndarray) else initial(df, k, seed, init, id_col, vec)
    moved, whole = 0.0, 1 << 30
    for step in range(steps):
        batch = df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed), F.lit(step)), F.lit(whole)) < int(whole * share))
        sums, counts, _, _ = update(batch, c, vec, id_col)
        new = np.where(counts[:, None] > 0, c + rate * (sums / np.maximum(counts, 1)[:, None] - c), c)
        moved, c = float(np.sqrt(((new - c) ** 2).sum(axis=1)).max()), new
    return KMeansModel(c, steps, moved, False)


def mini_batch_step(centroids: np.ndarray, x: np.ndarray, rate: float) -> np.ndarray:
    """c + rate (mean of its vectors - c)."""
    at, _ = nearest(x, centroids)
    out = centroids.copy()
    for j in np.unique(at):
        out[j] += rate * (x[at == j].mean(axis=0) - out[j])
    return out


def assign(df: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Adds cluster_id and distance (squared L2) of the nearest centroid; one narrow pass."""
    held = df.sparkSession.sparkContext.broadcast(centroids)
    at_vec = df.columns.index(vec)
    names = [*df.columns, "cluster_id", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(at_vec).is_valid()
            x = matrix(batch.column(at_vec).filter(known), held.value.shape[1])
            at, d = nearest(x, held.value)
            full = np.full(len(batch), -1), np.zeros(len(batch))
            where = np.flatnonzero(known.to_numpy(zero_copy_only=False))
            full[0][where], full[1][where] = at, d
            lost = np.ones(len(batch), bool)
            lost[where] = False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(full[0], pa.int32(), mask=lost), pa.array(full[1], mask=lost)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", cluster_id int, distance double"
    return df.mapInArrow(run, schema)


def ivf_search(assigned: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, nprobe: int, id_col: str = "vec_id", query_id: str = "vec_id", vec: str = "embedding", query_vec: str | None = None, codes: tuple[float, float] | None = None) -> DataFrame:
    """(query_id, rank, id, distance) from the nprobe nearest lists of each query; exact within them.

    ``assigned`` holds cluster_id (best stored partitioned by it: then only the
    probed lists are read). Queries go in blocks; a task compares its rows with
    the queries that probe their list. With ``codes`` (scale, zero point), vec
    holds integer codes, and queries are compared in the codes' own units.
    """
    if not 0 < nprobe <= len(centroids):
        raise ValueError("nprobe must be 1 to the number of lists")
    parts = []
    scale, zero = codes or (1.0, 0.0)
    for ids, q in query_blocks(queries, query_id, query_vec or vec):
        d = rough(q, centroids, "euclidean")
        probes = np.argsort(d, axis=1, kind="stable")[:, :nprobe]
        q = q / scale + zero
        by_list: dict[int, np.ndarray] = {int(c): np.flatnonzero((probes == c).any(axis=1)) for c in np.unique(probes)}
        held = assigned.sparkSession.sparkContext.broadcast((np.array(ids), q, by_list))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, queries, lists = held.value
            kept: dict[int, list] = {}
            for batch in batches:
                own, clusters, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), queries.shape[1])
                for c in np.unique(clusters):
                    rows = np.flatnonzero(clusters == c)
                    for r in lists.get(int(c), ()):
                        dist = scale**2 * exact(x[rows], np.broadcast_to(queries[r], (len(rows), queries.shape[1])), "euclidean")
                        held_d, held_i = kept.get(int(r), (np.zeros(0), np.zeros(0, np.int64)))
                        dist, at = np.concatenate([held_d, dist]), np.concatenate([held_i, own[rows]])
                        order = np.lexsort((at, dist))[:k]
                        kept[int(r)] = dist[order], at[order]
            for r, (dist, at) in kept.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), names[r]), pa.int64()), pa.array(at, pa.int64()), pa.array(dist)], ["query_id", "id", "distance"])

        lists = [int(c) for c in by_list]
        rows = assigned.where(F.col("cluster_id").isin(lists)).select(F.col(id_col).cast("long"), F.col("cluster_id"), vec)
        parts.append(rows.mapInArrow(run, "query_id long, id long, distance double"))
    if not parts:
        return assigned.sparkSession.createDataFrame([], "query_id long, rank long, id long, distance double")
    return topk(reduce(DataFrame.unionByName, parts), "query_id", ["distance", "id"], k).select("query_id", "rank", "id", "distance")


#: Rows that a probe rule is measured on, about.
HELD_OUT = 200


def measured_nprobe(assigned: DataFrame, centroids: np.ndarray, k: int, recall: float, seed: int = 0, id_col: str = "vec_id", vec: str = "embedding", held_out: int = HELD_OUT) -> int:
    """The least number of lists that finds this share of the true k nearest of held-out rows, and a little more.

    About ``held_out`` rows, chosen by a hash, are searched exactly; each true
    neighbour lies in a list, whose place in the query's order of lists says
    how many probes find it. The share is asked for with a margin of two
    standard errors, so that other queries reach it too.
    """
    n = assigned.where(F.col(vec).isNotNull()).count()
    whole = 1 << 40
    chosen = assigned.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed), F.lit(17)), F.lit(whole)) < int(whole * min(1.0, held_out / max(n, 1)))).select(id_col, vec)
    truth = knn(assigned, chosen, k, "euclidean", id_col, id_col, vec)
    where = truth.join(assigned.select(F.col(id_col).cast("long").alias("id"), "cluster_id"), "id").select("query_id", "cluster_id").toArrow()  # k rows a held-out query
    held = {r[0]: np.array(r[1], float) for r in chosen.select(F.col(id_col).cast("long"), vec).where(F.col(vec).isNotNull()).collect()}
    if not len(where):
        return len(centroids)
    order = {i: np.argsort(np.argsort(rough(v[None, :], centroids, "euclidean")[0], kind="stable"), kind="stable") for i, v in held.items()}
    place = np.sort([order[q][c] for q, c in zip(where.column(0).to_pylist(), where.column(1).to_pylist(), strict=True)])
    asked = min(1.0, recall + 2 * (recall * (1 - recall) / len(place)) ** 0.5)
    return int(place[min(ceil(asked * len(place)), len(place)) - 1]) + 1


def search(df: DataFrame, queries: DataFrame, k: int, model: KMeansModel | None, nprobe: int, n: int, threshold: int = 10_000) -> DataFrame:
    """IVF from ``threshold`` vectors on if a model is there, else exact search."""
    if model is not None and n >= threshold:
        return ivf_search(assign(df, model.centroids), model.centroids, queries, k, nprobe)
    return knn(df, queries, k)
