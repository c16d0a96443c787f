"""Matrices in long form (i, j, v): products, transposes, power iteration.

A product is one equi-join on the inner index and one sum, so it is dealt by
the inner index, then by the cell, and partial sums come before that shuffle.
``batch`` columns multiply many matrices at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veclume.functions.vector import UNARY
from veclume.plans.blocked import matrix


def transpose(m: DataFrame) -> DataFrame:
    return m.select(*[F.col(c) for c in m.columns if c not in ("i", "j", "v")], F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None, transpose_a: bool = False, transpose_b: bool = False, batch: list[str] | None = None) -> DataFrame:
    """alpha A B + beta C."""
    keys = batch or []
    a, b = transpose(a) if transpose_a else a, transpose(b) if transpose_b else b
    left = a.select(*keys, "i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(*keys, F.col("i").alias("k"), "j", F.col("v").alias("y"))
    out = left.join(right, [*keys, "k"]).groupBy(*keys, "i", "j").agg((alpha * F.sum(F.col("x") * F.col("y"))).alias("v"))
    if c is not None and beta:
        both = out.join(c.select(*keys, "i", "j", F.col("v").alias("w")), [*keys, "i", "j"], "full")
        out = both.select(*keys, "i", "j", (F.coalesce("v", F.lit(0.0)) + beta * F.coalesce("w", F.lit(0.0))).alias("v"))
    return out


def gram(df: DataFrame, vec: str) -> DataFrame:
    """(i, j, v) of M' M, M the vectors of all rows: a task emits one matrix of sums. Null vectors take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(0), None if total is None else len(total))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    return df.where(F.col(vec).isNotNull()).select(vec).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def fused(a: DataFrame, b: DataFrame, bias: DataFrame | None = None, activation: str = "none", alpha: float = 1.0, batch: list[str] | None = None) -> DataFrame:
    """activation(alpha A B + bias of the column)."""
    out = multiply(a, b, alpha, batch=batch)
    v: Column = F.col("v")
    if bias is not None:
        out = out.join(bias.select("j", F.col("v").alias("w")), "j", "left")
        v = v + F.coalesce("w", F.lit(0.0))
    return out.select(*(batch or []), "i", "j", UNARY[activation](v).alias("v"))


def multiply_vector(m: DataFrame, x: DataFrame, batch: list[str] | None = None, normalize: bool = False) -> DataFrame:
    """(batch..., i, v) of M x, x: (batch..., j, v); normalize: of unit length, unless it is all zeros."""
    keys = batch or []
    out = m.join(x.select(*keys, "j", F.col("v").alias("x")), [*keys, "j"]).groupBy(*keys, "i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))
    if not normalize:
        return out
    size = out.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    if keys:
        out = out.join(size, keys)
    else:
        out = out.withColumn("size", F.lit(size.first().size).cast("double"))  # one row
    return out.select(*keys, "i", F.when(F.col("size") > 0, F.col("v") / F.col("size")).otherwise(0.0).alias("v"))


def power_iteration(m: DataFrame, n: int, steps: int = 100, tolerance: float = 1e-10) -> tuple[float, list[float]]:
    """(signed eigenvalue of greatest size, unit vector) of a square matrix; the vector of n numbers is on the driver."""
    spark = m.sparkSession
    x, value = [1 / n**0.5] * n, 0.0
    for _ in range(steps):
        y = [0.0] * n
        for r in multiply_vector(m, spark.createDataFrame(list(enumerate(x)), "j int, v double")).collect():
            y[r.i] = r.v
        size = sum(v * v for v in y) ** 0.5
        rayleigh = sum(p * q for p, q in zip(x, y, strict=True))
        if size == 0:
            return 0.0, x
        x = [v / size for v in y]
        if abs(rayleigh - value) < tolerance:
            return rayleigh, x
        value = rayleigh
    return value, x


def zeros(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    return _full(spark, rows, columns, F.lit(0.0))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return _full(spark, n, n, F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))


def random(spark: SparkSession, rows: int, columns: int, seed: int, low: float = -1.0, high: float = 1.0) -> DataFrame:
    unit = F.pmod(F.xxhash64("i", "j", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return _full(spark, rows, columns, low + (high - low) * unit)


def _full(spark: SparkSession, rows: int, columns: int, v: Column) -> DataFrame:
    cells = spark.range(rows * columns).select((F.col("id") / columns).cast("int").alias("i"), (F.col("id") % columns).cast("int").alias("j"))
    return cells.withColumn("v", v)


def from_vectors(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    return df.select(F.col(id_col).cast("int").alias("i"), F.posexplode(F.col(vec).cast("array<double>")).alias("j", "v"))


def strided(m: DataFrame, rows: int, stride: int | None = None) -> DataFrame:
    """(batch, i, j, v): every ``stride`` (or rows) rows of a tall matrix the next matrix of ``rows`` rows; rows between are left out."""
    step = stride or rows
    return m.select((F.col("i") / step).cast("int").alias("batch"), (F.col("i") % step).cast("int").alias("i"), "j", "v").where(F.col("i") < rows)


def row(m: DataFrame, i: int) -> DataFrame:
    """(j, v) of a row."""
    return m.where(F.col("i") == i).select("j", "v")


def cell(m: DataFrame, i: int, j: int) -> DataFrame:
    """(v) of a cell."""
    return m.where((F.col("i") == i) & (F.col("j") == j)).select("v")


def to_rows(m: DataFrame) -> DataFrame:
    """(i, row): rows as arrays in the order of their columns."""
    return m.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("row"))  # a row of a matrix
