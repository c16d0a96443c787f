"""User functions over batches and rows: the hooks for what the library does not express."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def process(df: DataFrame, operation: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """operation of each Arrow batch, as a stream through each partition (a table function)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield operation(batch)

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class Strategy:
    """How a table goes through an operation: in one partition, in so many, or in batches of so many rows."""

    kind: str  # sequential, parallel, streaming
    partitions: int = 1
    rows: int = 0


#: Fixed values of the choice: rows from which all cores are used, rows up to which one partition does, partitions between.
LARGE, SMALL, FEW = 10_000, 100, 4
MEMORY_LIMIT = 512 << 20


def choose_strategy(rows: int, bytes_a_row: int, cores: int, memory_limit: int = MEMORY_LIMIT) -> Strategy:
    """Batches that fit if the whole does not; all cores for large tables, one partition for tiny ones, a few between."""
    if rows * bytes_a_row > memory_limit:
        return Strategy("streaming", cores, max(1, memory_limit // max(bytes_a_row, 1)))
    if rows > LARGE:
        return Strategy("parallel", cores)
    return Strategy("sequential") if rows < SMALL else Strategy("parallel", FEW)


def process_with(df: DataFrame, operation: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, strategy: Strategy) -> DataFrame:
    """operation under a strategy; streaming cuts each partition's batches to its number of rows."""
    if strategy.kind == "sequential":
        return process(df.coalesce(1), operation, schema)
    if strategy.kind == "parallel":
        return process(df.repartition(strategy.partitions), operation, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), strategy.rows):
                yield operation(batch.slice(i, strategy.rows))

    return df.mapInArrow(run, schema)


def apply_function(a: Column, f: Callable[[Column], Column]) -> Column:
    """f of each element, as a Column expression."""
    return F.transform(a, f)


def valid(df: DataFrame, id_col: str = "id", distance: str = "distance") -> DataFrame:
    """Results with an id and a finite distance."""
    d = F.col(distance)
    return df.where(F.col(id_col).isNotNull() & d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf")))


def vector_statistics(df: DataFrame, by: str, vec: str = "embedding") -> DataFrame:
    """(by, n, mean, stddev, mean_norm): over all elements, and of the lengths; two partial aggregations."""
    x = F.transform(F.col(vec).cast("array<double>"), lambda v: v)
    add = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))
    rows = df.select(by, F.size(vec).alias("d"), add(x, lambda v: v).alias("s"), add(x, lambda v: v * v).alias("q"))
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum("d").alias("d"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.avg(F.sqrt("q")).alias("mean_norm"))
    mean = F.col("s") / F.col("d")
    return g.select(by, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("d") - mean * mean, F.lit(0.0))).alias("stddev"), "mean_norm")
