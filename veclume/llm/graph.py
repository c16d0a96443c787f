"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclume.llm.scratch import Scratch

MAX_STEPS = 60


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the least node that is reachable.

    Each step is two partial aggregations and equi-joins; its result is written
    to the shared folder, so lineage does not grow. Nodes without an edge are
    not returned. Self-edges and repeated edges do no harm; null ends are dropped.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    pairs = scratch.keep(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(MAX_STEPS):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = scratch.keep(small.where("u <> v").distinct(), "star")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(pairs)
        pairs = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_STEPS} steps")
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
