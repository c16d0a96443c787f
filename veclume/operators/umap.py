"""Steps of UMAP's layout: edge gradients, negative samples, updates and the loss.

points: (id, y ARRAY<DOUBLE>); edges: (source, target, weight). Updates are
synchronous: all gradients of an epoch come from the same layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veclume.functions.vector import vsum

EPS = 1e-6
CLAMP = 4.0
LEHMER = 2**31 - 1


def curve(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a d^2b), fitted by least squares to the wanted falling-off."""
    import numpy as np

    x = np.linspace(0, 3 * spread, 300)
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a = b = 1.0
    for _ in range(200):
        u = np.power(x, 2 * b, where=x > 0, out=np.zeros_like(x))
        f = 1 / (1 + a * u)
        ja, jb = -u * f**2, -a * u * 2 * np.log(np.where(x > 0, x, 1)) * f**2
        j = np.stack([ja, jb], axis=1)
        step = np.linalg.lstsq(j.T @ j + 1e-9 * np.eye(2), j.T @ (y - f), rcond=None)[0]
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-10:
            break
    return float(a), float(b)


def _ends(edges: DataFrame, points: DataFrame) -> DataFrame:
    s = points.select(F.col("id").alias("source"), F.col("y").alias("ys"))
    t = points.select(F.col("id").alias("target"), F.col("y").alias("yt"))
    return edges.join(s, "source").join(t, "target")


def _squared() -> Column:
    return vsum(F.zip_with("ys", "yt", lambda a, b: (a - b) * (a - b)))


def _clamped(factor: Column) -> Column:
    return F.zip_with("ys", "yt", lambda a, b: F.least(F.greatest(factor * (a - b), F.lit(-CLAMP)), F.lit(CLAMP)))


def edge_gradients(edges: DataFrame, points: DataFrame, a: float, b: float, rate: float) -> DataFrame:
    """(source, target, g): the pull on source; on target it is the opposite."""
    j = _ends(edges, points).withColumn("d2", F.greatest(_squared(), F.lit(EPS)))
    factor = -2 * a * b * F.pow("d2", F.lit(b - 1)) / (1 + a * F.pow("d2", F.lit(b))) * F.col("weight") * rate
    return j.select("source", "target", _clamped(factor).alias("g"))


def negative_gradients(pairs: DataFrame, points: DataFrame, b: float, a: float, rate: float) -> DataFrame:
    """(source, target, g): the push on source from sampled others."""
    j = _ends(pairs, points).where("source <> target").withColumn("d2", _squared())
    factor = 2 * b / ((EPS + F.col("d2")) * (1 + a * F.pow("d2", F.lit(b)))) * rate
    return j.select("source", "target", _clamped(factor).alias("g"))


def negative_pairs(points: DataFrame, per_point: int, n: int, seed: int) -> DataFrame:
    """(source, target): seeded targets by number; points must be numbered 0..n-1.

    Two steps of a Lehmer generator (modulus 2^31 - 1) over source and draw, so
    that any SQL gives the same targets.
    """
    k = F.explode(F.sequence(F.lit(0), F.lit(per_point - 1)))
    draws = points.select(F.col("id").alias("source"), k.alias("k"))
    one = F.pmod(F.pmod(F.col("source") + seed, F.lit(LEHMER)) * 48271, F.lit(LEHMER))
    two = F.pmod((one + F.col("k") * 16807 + 1) * 69621, F.lit(LEHMER))
    return draws.select("source", F.pmod(two, F.lit(n)).cast("long").alias("target"))


def sort_edges(edges: DataFrame) -> DataFrame:
    """Edges dealt out by source and sorted by it in each partition, as a segment sum by source wants them."""
    return edges.repartition("source").sortWithinPartitions("source", "target")


def apply(points: DataFrame, *gradients: DataFrame) -> DataFrame:
    """Points moved by the sums of their gradients (id, g), dimension by dimension."""
    all_ = gradients[0]
    for g in gradients[1:]:
        all_ = all_.unionByName(g)
    sums = all_.select("id", F.posexplode("g").alias("d", "v")).groupBy("id", "d").agg(F.sum("v").alias("v"))
    moves = sums.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias("m"))  # a row a dimension
    return points.join(moves, "id", "left").select("id", F.when(F.col("m").isNull(), F.col("y")).otherwise(F.zip_with("y", "m", lambda y, m: y + m)).alias("y"))


def epoch(points: DataFrame, edges: DataFrame, n: int, rate: float, a: float, b: float, negatives: int = 5, seed: int = 0) -> DataFrame:
    pull = edge_gradients(edges, points, a, b, rate)
    push = negative_gradients(negative_pairs(points, negatives, n, seed), points, b, a, rate)
    ends = pull.select(F.col("source").alias("id"), "g"), pull.select(F.col("target").alias("id"), F.transform("g", lambda x: -x).alias("g"))
    return apply(points, *ends, push.select(F.col("source").alias("id"), "g"))


def loss(edges: DataFrame, points: DataFrame, a: float, b: float) -> DataFrame:
    """Sum of -w ln q - (1 - w) ln(1 - q) over edges, q = 1 / (1 + a d^2b) kept off 0 and 1."""
    q = F.least(F.greatest(1 / (1 + a * F.pow(_squared(), F.lit(b))), F.lit(1e-6)), F.lit(1 - 1e-6))
    j = _ends(edges, points).withColumn("q", q)
    return j.agg(F.sum(-F.col("weight") * F.ln("q") - (1 - F.col("weight")) * F.ln(1 - F.col("q"))).alias("loss"), F.count("*").alias("edges"))
