"""Core distances, mutual reachability and the minimum spanning tree for density clustering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclume.functions.vector import mutual_reachability
from veclume.plans.blocked import CANDIDATES, knn, matrix, pairwise
from veclume.storage import kept

#: Nearest rows of a point whose edges are candidates.
NEIGHBOURS = 16
#: Points and candidates together that one task contracts.
SMALL = 2_000_000
#: Points of a tile, and rows that a task compares with it at once, in a Boruvka round.
TILE = 2048
ROWS = 1024


def core_distances(df: DataFrame, min_samples: int = 5, id_col: str = "vec_id", vec: str = "embedding", queries: DataFrame | None = None) -> DataFrame:
    """(id, core): distance to the min_samples-th nearest other row, or the farthest if there are fewer; alone: 0."""
    near = knn(df, df if queries is None else queries, min_samples, "euclidean", id_col, id_col, vec, exclude_self=True)
    core = near.groupBy(F.col("query_id").alias("id")).agg(F.sqrt(F.max("distance")).alias("core"))
    own = (df if queries is None else queries).select(F.col(id_col).cast("long").alias("id"))
    return own.join(core, "id", "left").select("id", F.coalesce("core", F.lit(0.0)).alias("core"))


def pair_reachability(pairs: DataFrame, df: DataFrame, core: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(i, j, d) of the given pairs: the greater of both core distances and the distance; i = j: 0."""
    own = df.select(F.col(id_col).alias("id"), F.col(vec).alias("v")).join(core, "id")
    a = own.select(F.col("id").alias("i"), F.col("v").alias("va"), F.col("core").alias("ca"))
    b = own.select(F.col("id").alias("j"), F.col("v").alias("vb"), F.col("core").alias("cb"))
    d = F.when(F.col("i") == F.col("j"), 0.0).otherwise(mutual_reachability("va", "vb", "ca", "cb"))
    return pairs.join(a, "i").join(b, "j").select("i", "j", d.alias("d"))


def dense_reachability(df: DataFrame, core: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(i, j, d) of all rows, or of a stated set of them as i, against all rows; the diagonal is 0."""
    cells = pairwise(df, df if queries is None else queries, "euclidean", id_col, id_col, vec)
    a, b = core.select(F.col("id").alias("i"), F.col("core").alias("ca")), core.select(F.col("id").alias("j"), F.col("core").alias("cb"))
    both = cells.select(F.col("query_id").alias("i"), F.col("id").alias("j"), F.sqrt("distance").alias("l2")).join(a, "i").join(b, "j")
    return both.select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.greatest("ca", "cb", "l2")).alias("d"))


def _round(points: DataFrame, tile: tuple) -> DataFrame:
    """Least outgoing edge of each component of a tile of points among the edges to all rows, by (exact weight, source, target)."""
    held = points.sparkSession.sparkContext.broadcast(tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, core, comp = held.value
        unit = 4 * (x.shape[1] + 4) * np.finfo(float).eps
        best: dict[int, tuple[float, int, int, int]] = {}
        for batch in batches:
            own, c, m = (batch.column(k).to_numpy() for k in (0, 2, 3))
            y = matrix(batch.column(1), x.shape[1])
            for a in range(0, len(own), ROWS):
                part = slice(a, a + ROWS)
                size = (y[part] ** 2).sum(1)[:, None] + (x**2).sum(1)[None, :]
                d, floor = size - 2 * y[part] @ x.T, np.maximum(c[part][:, None], core[None, :]) ** 2
                outside = (m[part][:, None] != comp[None, :]) & np.isfinite(d)
                least = np.where(outside, np.maximum(d + unit * size, floor * (1 + unit)), np.inf).min(axis=0)
                row, col = np.nonzero(outside & (np.maximum(d - unit * size, floor * (1 - unit)) <= least[None, :]))
                for b in range(0, len(row), CANDIDATES):
                    r, k = row[b : b + CANDIDATES], col[b : b + CANDIDATES]
                    w = np.maximum(np.sqrt(((y[part][r] - x[k]) ** 2).sum(1)), np.maximum(c[part][r], core[k]))
                    low, high, key = np.minimum(own[part][r], ids[k]), np.maximum(own[part][r], ids[k]), comp[k]
                    order = np.lexsort((high, low, w, key))
                    for e in order[np.concatenate([[True], key[order][1:] != key[order][:-1]])] if len(order) else ():
                        edge = (float(w[e]), int(low[e]), int(high[e]), int(m[part][r[e]]))
                        if int(key[e]) not in best or edge < best[int(key[e])]:
                            best[int(key[e])] = edge
        rows = [(k, *e) for k, e in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))], ["comp", "weight", "source", "target", "other"])

    return points.select("id", "v", "core", "comp").mapInArrow(run, "comp long, weight double, source long, target long, other long")


def _tiles(points: DataFrame) -> Iterator[tuple]:
    """Points in tiles of about TILE rows by a hash of the id, one at a time on the driver."""
    n = points.count()
    parts = -(-n // TILE)
    for k in range(parts):
        rows = points.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).select("id", "v", "core", "comp").toArrow()
        if len(rows):
            yield rows.column("id").to_numpy(), matrix(rows.column("v")), rows.column("core").to_numpy(), rows.column("comp").to_numpy()


def _roots(chosen: DataFrame) -> DataFrame:
    """(comp, root) of components that chose an edge to another: pointers are doubled until none moves.

    Edges have one order, so the choices make trees in which two components
    chose each other's edge; the lesser of the two is the root.
    """
    back = chosen.select(F.col("comp").alias("other"), F.col("other").alias("back"))
    mutual = (F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other"))
    at = kept(chosen.join(back, "other", "left").select("comp", F.when(mutual, F.col("comp")).otherwise(F.col("other")).alias("root")), "mst-roots")
    while True:
        far = at.select(F.col("comp").alias("root"), F.col("root").alias("far"))
        new = kept(at.join(far, "root", "left").select("comp", F.coalesce("far", "root").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "mst-roots")
        at = new.select("comp", "root")
        if not new.where("moved").limit(1).count():
            return at


def _candidates(df: DataFrame, core: DataFrame, neighbours: int, id_col: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """(points, edges): points with bound, the least weight that an edge may have which is not among the edges to their nearest rows."""
    near = kept(knn(df, df, neighbours, "euclidean", id_col, id_col, vec, exclude_self=True).select(F.col("query_id").alias("id"), F.col("id").alias("to"), F.sqrt("distance").alias("l2")), "mst-near")
    reach = near.groupBy("id").agg(F.when(F.count("*") >= neighbours, F.max("l2")).otherwise(float("inf")).alias("reach"))  # fewer: all others are listed
    own = df.where(F.col(vec).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v"))
    points = own.join(core, "id").join(reach, "id", "left").select("id", "v", "core", F.greatest(F.coalesce("reach", F.lit(float("inf"))), "core").alias("bound"), F.col("id").alias("comp"))
    to = core.select(F.col("id").alias("to"), F.col("core").alias("far"))
    weight = F.greatest("l2", "core", "far")
    edges = near.join(core, "id").join(to, "to").select(F.least("id", "to").alias("source"), F.greatest("id", "to").alias("target"), weight.alias("weight")).distinct()
    return kept(points, "mst-points"), kept(edges, "mst-edges")


def _contract(ids: np.ndarray, comp: np.ndarray, bound: np.ndarray, ends: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new component of each point, which edges are of the tree): Boruvka rounds on one task's arrays.

    bound: least weight of an unlisted edge of each point; ends: ids of both
    ends, the lesser first. A component waits while its least listed edge is not
    under all of its bounds.
    """
    order = np.lexsort((ends[:, 1], ends[:, 0], weight))
    place = np.searchsorted(ids, ends)
    names, label = np.unique(comp, return_inverse=True)
    limit = np.full(len(names), len(order))  # edges under the bounds of a component
    np.minimum.at(limit, label, np.searchsorted(weight[order], bound, "left"))
    a, b = label[place[order, 0]], label[place[order, 1]]
    rank, chosen = np.arange(len(order)), np.zeros(len(order), bool)
    while True:
        apart = a != b
        a, b, rank = a[apart], b[apart], rank[apart]
        least = np.full(len(limit), len(order))
        np.minimum.at(least, a, rank)
        np.minimum.at(least, b, rank)
        sure = np.flatnonzero(least < limit)
        if not sure.size:
            break
        chosen[least[sure]] = True
        at = np.searchsorted(rank, least[sure])
        root = np.arange(len(limit))
        root[sure] = np.where(a[at] == sure, b[at], a[at])
        back = np.flatnonzero((root[root] == np.arange(len(root))) & (np.arange(len(root)) < root))
        root[back] = back  # of two that chose each other the lesser stays
        while (root[root] != root).any():
            root = root[root]
        merged = np.full(len(limit), len(order))
        np.minimum.at(merged, root, limit)
        limit, label, a, b = merged, root[label], root[a], root[b]
    back = np.zeros(len(order), bool)
    back[order] = chosen
    low = np.full(len(limit), np.iinfo(np.int64).max)
    np.minimum.at(low, label, names[np.searchsorted(names, comp)])
    return low[label], back


def _contracted(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, a, b, w): 0 a point and its new component, 1 an edge of the tree; one task, for tables within SMALL."""
    none = F.lit(None).cast("double")
    rows = points.select(F.lit(0).alias("kind"), F.col("id").alias("a"), F.col("comp").alias("b"), F.col("bound").alias("w"))
    rows = rows.unionByName(edges.select(F.lit(1).alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.coalesce("weight", none).alias("w")))

    def run(t: pa.Table) -> pa.Table:
        kind, x, y, w = (t.column(c).to_numpy() for c in ("kind", "a", "b", "w"))
        own, edge = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        own = own[np.argsort(x[own], kind="stable")]
        comp, tree = _contract(x[own], y[own], w[own], np.stack([x[edge], y[edge]], axis=1), w[edge])
        edge = edge[tree]
        return pa.table({"kind": kind[np.concatenate([own, edge])], "a": np.concatenate([x[own], x[edge]]), "b": np.concatenate([comp, y[edge]]), "w": w[np.concatenate([own, edge])]})

    return rows.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(run, "kind int, a long, b long, w double")


def minimum_spanning_tree(df: DataFrame, core: DataFrame, id_col: str = "vec_id", vec: str = "embedding", neighbours: int = NEIGHBOURS) -> DataFrame:
    """(source, target, weight): n - 1 edges of the tree over mutual reachability, by Boruvka rounds.

    Candidates are the edges to each row's nearest rows, found once. In a round
    each component takes its least candidate to another; that is its least edge
    of all unless a row of it has a bound (the weight any other edge of it has
    at least) that is no greater. Only such rows are compared with all others,
    in tiles of about ``TILE`` rows. Labels, candidates and edges are tables in
    the shared folder, so points have no bound; while points and candidates are
    ``SMALL`` rows or less, the rounds that candidates decide run in one task.
    """
    points, edges = _candidates(df, core, neighbours, id_col, vec)
    found: list[DataFrame] = []
    small = points.count() + edges.count() <= SMALL
    while True:
        if small:
            both = kept(_contracted(points, edges), "mst-contracted")
            found.append(both.where("kind = 1").select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("w").alias("weight")))
            points = points.drop("comp").join(both.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("comp")), "id")
            if not points.agg(F.min("comp") < F.max("comp")).first()[0]:
                break
            points = kept(points, "mst-points")
        ends = points.select("id", "comp")
        a, b = ends.select(F.col("id").alias("source"), F.col("comp").alias("ca")), ends.select(F.col("id").alias("target"), F.col("comp").alias("cb"))
        edges = kept(edges.select("source", "target", "weight").join(a, "source").join(b, "target").where("ca <> cb"), "mst-edges")
        both = edges.select(F.col("ca").alias("comp"), "weight", "source", "target", F.col("cb").alias("other")).unionByName(edges.select(F.col("cb").alias("comp"), "weight", "source", "target", F.col("ca").alias("other")))
        least = kept(both.groupBy("comp").agg(F.min(F.struct("weight", "source", "target", "other")).alias("e")), "mst-least")
        most = F.coalesce(F.col("e.weight"), F.lit(float("inf")))
        open_ = kept(points.join(least, "comp", "left").where((F.col("bound") <= most) & (F.col("bound") < float("inf"))).select("id", "v", "core", "comp"), "mst-open")
        parts = [least.select("comp", "e.*")]
        parts += [kept(_round(points, tile).groupBy("comp").agg(F.min(F.struct("weight", "source", "target", "other")).alias("e")).select("comp", "e.*"), "mst-tile") for tile in _tiles(open_)]
        chosen = kept(reduce(DataFrame.unionByName, parts).groupBy("comp").agg(F.min(F.struct("weight", "source", "target", "other")).alias("e")).select("comp", "e.*"), "mst-chosen")
        if not chosen.limit(1).count():
            break
        found.append(chosen.select("source", "target", "weight").distinct())
        points = kept(points.join(_roots(chosen.select("comp", "other")), "comp", "left").select("id", "v", "core", "bound", F.coalesce("root", "comp").alias("comp")), "mst-points")
    return reduce(DataFrame.unionByName, found) if found else df.sparkSession.createDataFrame([], "source long, target long, weight double")


def hdbscan_tree(df: DataFrame, min_samples: int = 5, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(source, target, weight): core distances, then the spanning tree over mutual reachability."""
    return minimum_spanning_tree(df, core_distances(df, min_samples, id_col, vec), id_col, vec)
