"""Histograms: uniform, equal-frequency, logarithmic and custom edges, and figures of them.

Edges come to the driver (a few, by the number of bins) and become literals, so
that binning is a narrow projection and one partial aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veclume.operators.stats import finite, selected


def uniform_edges(low: float, high: float, bins: int) -> list[float]:
    return [low + (high - low) * k / bins for k in range(bins + 1)]


def log_edges(low: float, high: float, bins: int) -> list[float]:
    if low <= 0:
        raise ValueError("logarithmic bins need a positive minimum")
    a, b = math.log(low), math.log(high)
    return [math.exp(a + (b - a) * k / bins) for k in range(bins + 1)]


def frequency_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    """Least value, quantiles at k / bins, greatest value."""
    found = selected(df.select(finite(value).alias("v")), "v", tuple(k / bins for k in range(bins + 1))).first()
    return list(found.q) if found else []


def extent(df: DataFrame, value: str) -> tuple[float, float]:
    r = df.agg(F.min(finite(value)), F.max(finite(value))).first()
    return (0.0, 0.0) if r[0] is None else (r[0], r[1])


def bin_of(value: str, edges: list[float], include_outliers: bool = True) -> Column:
    """Bin of each value: edges[k] <= x < edges[k+1], the last closed; not finite: null. Outliers clamp or are null."""
    x, n = finite(value), len(edges) - 1
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]]) if n > 1 else F.array().cast("array<double>")
    k = F.size(F.filter(inner, lambda e: e <= x))
    inside = F.lit(True) if include_outliers else (x >= edges[0]) & (x <= edges[-1])
    return F.when(x.isNotNull() & inside, k)


def histogram(df: DataFrame, value: str, edges: list[float], by: list[str] | None = None, include_outliers: bool = True) -> DataFrame:
    """(by..., bin, low, high, count) with every bin, also empty ones."""
    by = by or []
    n = len(edges) - 1
    found = df.select(*by, bin_of(value, edges, include_outliers).alias("bin")).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    spine = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    bins = F.explode(F.array(*[F.struct(F.lit(k).alias("bin"), F.lit(float(edges[k])).alias("low"), F.lit(float(edges[k + 1])).alias("high")) for k in range(n)]))
    spine = spine.select(*by, bins.alias("b")).select(*by, "b.*")
    return spine.join(found, [*by, "bin"], "left").select(*by, F.col("bin").cast("long").alias("bin"), "low", "high", F.coalesce("n", F.lit(0).cast("long")).alias("count"))


def uniform(df: DataFrame, value: str, bins: int = 100, low: float | None = None, high: float | None = None, by: list[str] | None = None) -> DataFrame:
    a, b = extent(df, value) if low is None or high is None else (low, high)
    return histogram(df, value, uniform_edges(a if low is None else low, b if high is None else high, bins), by)


def equal_frequency(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Also under the names quantile-based and variance-minimizing."""
    return histogram(df, value, frequency_edges(df, value, bins), by)


def logarithmic(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Values of 0 or less are left out."""
    positive = df.where(F.col(value) > 0)
    return histogram(positive, value, log_edges(*extent(positive, value), bins), by)


def averaged(hist: DataFrame, by: str) -> DataFrame:
    """(bin, low, high, mean_count, mean_share) over the histograms of all groups, which have the same edges."""
    total = F.sum("count").over(Window.partitionBy(by))  # a row a bin
    share = hist.withColumn("share", F.when(total > 0, F.col("count") / total).otherwise(0.0))
    return share.groupBy("bin", "low", "high").agg(F.avg("count").alias("mean_count"), F.avg("share").alias("mean_share"))


def normalized(hist: DataFrame) -> DataFrame:
    total = F.sum("count").over(Window.partitionBy())
    return hist.withColumn("share", F.when(total > 0, F.col("count") / total).otherwise(0.0))


def cumulative(hist: DataFrame) -> DataFrame:
    """Adds the running share; a histogram is small, so one task orders it."""
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("cdf", F.sum("count").over(w) / F.sum("count").over(Window.partitionBy()))


def figures(hist: DataFrame) -> DataFrame:
    """mean, sd, skewness, kurtosis (not excess), entropy (bits), mode, median, q1, q3 of bin centres."""
    c = cumulative(hist).withColumn("x", (F.col("low") + F.col("high")) / 2)
    n, mean = c.agg(F.sum("count"), F.sum(F.col("x") * F.col("count")) / F.when(F.sum("count") > 0, F.sum("count"))).first()
    mean = F.lit(mean).cast("double")
    d, w = F.col("x") - mean, F.col("count") / F.lit(n or 1)
    g = c.agg(
        F.first(mean).alias("mean"), F.sqrt(F.sum(w * d * d)).alias("sd"), F.sum(w * d * d * d).alias("m3"), F.sum(w * d * d * d * d).alias("m4"),
        F.sum(F.when(F.col("count") > 0, -w * F.log2(F.when(F.col("count") > 0, w))).otherwise(0.0)).alias("entropy"),
        F.max(F.struct(F.col("count"), (-F.col("bin")).alias("b"), "x"))["x"].alias("mode"),
        *[F.min(F.when(F.col("cdf") >= q, F.struct("bin", "x")))["x"].alias(name) for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))],
    )
    spread = F.col("sd") > 0
    return g.withColumn("skewness", F.when(spread, F.col("m3") / F.pow("sd", F.lit(3))).otherwise(0.0)).withColumn("kurtosis", F.when(spread, F.col("m4") / F.pow("sd", F.lit(4))).otherwise(0.0)).drop("m3", "m4")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of the lesser counts, bin by bin; unequal numbers of bins give 0."""
    j = a.select("bin", F.col("count").alias("x")).join(b.select("bin", F.col("count").alias("y")), "bin", "full")
    return j.agg(F.when(F.count_if(F.col("x").isNull() | F.col("y").isNull()) > 0, F.lit(0).cast("long")).otherwise(F.coalesce(F.sum(F.least("x", "y")), F.lit(0).cast("long"))).alias("intersection"))


def two_dimensional(df: DataFrame, x: str, y: str, x_edges: list[float], y_edges: list[float]) -> DataFrame:
    """(x_bin, y_bin, count) of the cells that have rows."""
    cells = df.select(bin_of(x, x_edges).cast("long").alias("x_bin"), bin_of(y, y_edges).cast("long").alias("y_bin"))
    return cells.where("x_bin is not null and y_bin is not null").groupBy("x_bin", "y_bin").agg(F.count("*").alias("count"))
