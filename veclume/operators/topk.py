"""Top-k selection, merging and recall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def topk(df: DataFrame, by: str | list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in this order, with their rank from 1.

    Catalyst cuts each group to k rows before the shuffle (WindowGroupLimit), so
    what is shuffled is bounded by k rows a group and task. Give the order ties.
    """
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def select_single(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of all (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


def merge(parts: list[DataFrame], by: str, order: list[Column | str], k: int, distinct: list[str] | None = None) -> DataFrame:
    """Top-k of the union of partial results; rows of equal ``distinct`` columns count once."""
    union = reduce(DataFrame.unionByName, [p.drop("rank") for p in parts])
    return topk(union.dropDuplicates(distinct) if distinct else union, by, order, k)


def recall(found: DataFrame, truth: DataFrame, query: str = "query_id", item: str = "id") -> DataFrame:
    """Mean over queries of |found and truth| / |truth|."""
    hits = truth.select(query, item).join(found.select(query, item).distinct().withColumn("hit", F.lit(1)), [query, item], "left")
    each = hits.groupBy(query).agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
    return each.agg(F.avg("recall").alias("recall"), F.count("*").alias("queries"))


def argmin(df: DataFrame, value: str, index: str) -> DataFrame:
    return df.agg(F.min(F.struct(F.col(value).alias("v"), F.col(index).alias("i"))).alias("s")).select("s.v", "s.i")


def argmax(df: DataFrame, value: str, index: str) -> DataFrame:
    """(v, i) of the greatest value; ties to the least index."""
    return df.agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(index)).alias("i"))).alias("s")).select("s.v", (-F.col("s.i")).alias("i"))


def global_minimum(df: DataFrame, value: str, row: str, column: str) -> DataFrame:
    """(value, row, column) of the least cell; ties to the first row, then column."""
    return df.agg(F.min(F.struct(value, row, column)).alias("s")).select("s.*")
