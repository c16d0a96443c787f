"""Reductions, moments, quantiles, correlation and their derived figures."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUANTILES = (0.25, 0.5, 0.75, 0.95)


def finite(value: str) -> Column:
    """The value, or null if it is null, NaN or infinite."""
    x = F.col(value).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def reduction(df: DataFrame, value: str, index: str) -> DataFrame:
    """count, sum, mean, min, max and the index of the last two (ties: least index), in one aggregation."""
    x, i = F.col(value).cast("double"), F.col(index).cast("long")
    low, high = F.min(F.struct(x.alias("v"), i.alias("i"))), F.max(F.struct(x.alias("v"), (-i).alias("i")))
    return df.where(F.col(value).isNotNull()).agg(
        F.count("*").alias("count"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), low["v"].alias("min"), high["v"].alias("max"), low["i"].alias("min_index"), (-high["i"]).alias("max_index"),
    )


def basic(df: DataFrame, value: str, by: list[str] | None = None, bias_correction: bool = True) -> DataFrame:
    """count, mean, variance, sd, min, max, range, sum, cv, sem and a 95 % interval; of one value the variance is 0."""
    x = F.col(value).cast("double")
    spread = F.coalesce(F.var_samp(x) if bias_correction else F.var_pop(x), F.lit(0.0))
    out = df.where(F.col(value).isNotNull()).groupBy(*(by or [])).agg(
        F.count("*").alias("count"), F.avg(x).alias("mean"), spread.alias("variance"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x).alias("sum"),
    )
    out = out.withColumn("stddev", F.sqrt("variance")).withColumn("range", F.col("max") - F.col("min"))
    out = out.withColumn("cv", F.when(F.col("mean") != 0, F.col("stddev") / F.abs("mean")).otherwise(0.0)).withColumn("sem", F.col("stddev") / F.sqrt("count"))
    return out.withColumn("ci_low", F.col("mean") - 1.96 * F.col("sem")).withColumn("ci_high", F.col("mean") + 1.96 * F.col("sem"))


def moments(df: DataFrame, value: str, by: list[str] | None = None, bias_correction: bool = True) -> DataFrame:
    """count, skewness and excess kurtosis, bias-corrected by default; shape and tail class. No spread: 0 and -3."""
    x = F.col(value).cast("double")
    g = df.where(F.col(value).isNotNull()).groupBy(*(by or [])).agg(F.count("*").alias("count"), F.var_pop(x).alias("v"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    n = F.col("count").cast("double")
    skew, kurt = F.col("g1"), F.col("g2")
    if bias_correction:
        skew = F.when(n >= 3, F.sqrt(n * (n - 1)) / (n - 2) * skew).otherwise(skew)
        kurt = F.when(n >= 4, (n * n - 1) / ((n - 2) * (n - 3)) * (kurt + 6 / (n + 1))).otherwise(kurt)
    flat = F.coalesce(F.col("v"), F.lit(0.0)) < 1e-9
    out = g.withColumn("skewness", F.when(flat, 0.0).otherwise(skew)).withColumn("kurtosis", F.when(flat, -3.0).otherwise(kurt))
    shape = F.when(F.abs("skewness") < 0.5, "symmetric").when(F.col("skewness") > 0, "right").otherwise("left")
    tail = F.when(F.col("kurtosis") > 1, "heavy").when(F.col("kurtosis") < -1, "light").otherwise("normal")
    return out.withColumn("shape", shape).withColumn("tail", tail).drop("v", "g1", "g2")


#: Ranks in a group that the sketch may miss by, as one part of so many; what exact selection sorts is twice that share.
ACCURACY = 10_000
#: Values of a group that are sorted as they are.
SMALL_GROUP = 100_000


def selected(df: DataFrame, value: str, levels: tuple[float, ...], by: list[str] | None = None, nearest: bool = False) -> DataFrame:
    """(by..., q ARRAY): exact quantiles by linear interpolation between ranks, or the value of the nearest rank.

    Two passes and no whole group in one task: a sketch of fixed size brackets
    each level's rank, the values under a bracket are counted, and only those
    inside, a few ten-thousandths of a group and all copies of one value once,
    are sorted. Groups of ``SMALL_GROUP`` values or less are bracketed by their
    ends. Null is left out; NaN is greatest; a group without values has no q.
    """
    by = by or []
    keys, other = [f"by{k}" for k in range(len(by))], [f"other{k}" for k in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("x"))
    slack = 3 / ACCURACY
    ends = F.array(*[F.lit(min(max(q + s, 0.0), 1.0)) for q in levels for s in (-slack, slack)])
    sketch = rows.groupBy(*keys).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", ends, ACCURACY).alias("e"))
    small = F.col("n") <= SMALL_GROUP

    def bracket(k: int, q: float) -> Column:
        first = F.when(small | F.lit(q - slack <= 0), F.col("low")).otherwise(F.get("e", F.lit(2 * k)))
        last = F.when(small | F.lit(q + slack >= 1), F.col("high")).otherwise(F.get("e", F.lit(2 * k + 1)))
        rank = F.greatest(F.ceil(F.col("n") * q), F.lit(1)) - 1 if nearest else (F.col("n") - 1) * F.lit(q)
        return F.struct(F.lit(k).alias("k"), first.alias("a"), last.alias("b"), rank.cast("double").alias("at"))

    brackets = sketch.where("n > 0").select(*[F.col(k).alias(o) for k, o in zip(keys, other, strict=True)], F.array(*[bracket(k, q) for k, q in enumerate(levels)]).alias("brackets"))
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, other, strict=True)]
    known = rows.where("x is not null")
    if by:
        joined = known.join(brackets, reduce(lambda x, y: x & y, same))
    else:  # one row, which becomes literals
        held = brackets.first()
        one = [F.struct(*[F.lit(v).alias(c) for c, v in b.asDict().items()]) for b in held.brackets] if held else []
        joined = known.withColumn("brackets", F.array(*one) if one else F.lit(None).cast(brackets.schema["brackets"].dataType))
    cells = joined.select(*keys, "x", F.explode("brackets").alias("c")).select(*keys, "x", "c.*").where("x <= b")
    counts = cells.groupBy(*keys, "k", "at", F.when(F.col("x") >= F.col("a"), F.col("x")).alias("x")).agg(F.count("*").alias("n"))  # what is under a bracket is one row
    found = counts.groupBy(*keys, "k", "at").agg(
        F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("n"))), F.lit(0).cast("long")).alias("under"), F.sort_array(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("x", "n")))).alias("v"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("got"))

    def at(rank: Column) -> Column:
        reached = lambda acc, v: F.coalesce(acc["got"], F.when(acc["seen"] + v["n"] > rank, v["x"]))
        return F.aggregate("v", zero, lambda acc, v: F.struct((acc["seen"] + v["n"]).alias("seen"), reached(acc, v).alias("got")), lambda acc: acc["got"])

    low, high = at(F.floor("at") - F.col("under")), at(F.ceil("at") - F.col("under"))
    q = found.select(*keys, "k", (F.when(low == high, low).otherwise(low + (high - low) * (F.col("at") - F.floor("at")))).alias("q"))
    q = q.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "q"))), lambda s: s["q"]).alias("q"))  # an entry a level
    if not by:
        return q
    q = q.select(*[F.col(k).alias(o) for k, o in zip(keys, other, strict=True)], "q")
    return sketch.select(*keys).join(q, reduce(lambda x, y: x & y, same), "left").select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "q")


def quantiles(df: DataFrame, value: str, levels: tuple[float, ...] = QUANTILES, by: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Columns q<level in percent>: linear interpolation between ranks, or (approximate) a sketch of fixed size."""
    levels = tuple(min(max(q, 0.0), 1.0) for q in levels)
    by = by or []
    sketch = F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(q) for q in levels]), ACCURACY)
    found = df.groupBy(*by).agg(sketch.alias("q")) if approximate else selected(df, value, levels, by)
    return found.select(*by, *[F.get("q", F.lit(k)).alias(f"q{level * 100:g}".replace(".", "_")) for k, level in enumerate(levels)])


def fences(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """q1, median, q3, iqr and the fences 1.5 iqr outside."""
    q = quantiles(df, value, (0.25, 0.5, 0.75), by).withColumn("iqr", F.col("q75") - F.col("q25"))
    return q.withColumn("low_fence", F.col("q25") - 1.5 * F.col("iqr")).withColumn("high_fence", F.col("q75") + 1.5 * F.col("iqr"))


def outlier_groups(df: DataFrame, value: str, by: str, threshold: float) -> DataFrame:
    """Groups whose mean lies more than threshold standard deviations from the mean of means."""
    means = df.groupBy(by).agg(F.avg(value).alias("mean"))
    m, sd = means.agg(F.avg("mean"), F.coalesce(F.stddev_samp("mean"), F.lit(0.0))).first()
    z = (F.col("mean") - m) / sd if sd else F.lit(0.0)
    return means.select(by, "mean", z.alias("z")).where(F.abs("z") > threshold)


def correlation_matrix(df: DataFrame, columns: list[str], covariance: bool = False) -> DataFrame:
    """(i, j, value) for i <= j by one aggregation. Series without spread correlate 0 with others, and with themselves."""
    pairs = list(combinations_with_replacement(columns, 2))
    aggs = []
    for a, b in pairs:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        if covariance:
            aggs.append(F.coalesce(F.covar_samp(x, y), F.lit(0.0)))
        elif a == b:
            aggs.append(F.when(F.var_pop(x) > 1.17549435e-38, 1.0).otherwise(0.0))
        else:
            aggs.append(F.when((F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.corr(x, y)).otherwise(0.0))
    row = df.agg(*[v.alias(f"v{k}") for k, v in enumerate(aggs)])
    cells = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"v{k}").alias("value")) for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def logsumexp(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """ln of the sum of exp by group, in two aggregations: the greatest value, then the sum relative to it."""
    by = by or []
    x = F.col(value).cast("double")
    inf = float("inf")
    if by:
        joined = df.join(df.groupBy(*by).agg(F.max(x).alias("__m")), by)
    else:
        joined = df.withColumn("__m", F.lit(df.agg(F.max(x)).first()[0]).cast("double"))
    m = F.first("__m")
    sums = joined.groupBy(*by).agg(m.alias("m"), F.sum(F.exp(x - F.col("__m"))).alias("s"))
    return sums.select(*by, F.when(F.col("m") == -inf, F.lit(-inf)).when(F.col("m") == inf, F.lit(inf)).otherwise(F.col("m") + F.ln("s")).alias("logsumexp"))


def exclusive_sum(df: DataFrame, order: str, value: str, out: str = "first") -> DataFrame:
    """Adds the sum of the values before each row in this order. For a row a list or bin: one task orders them."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0).cast(df.schema[value].dataType)))


def across(groups: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mean over data sets of figures that ``basic`` or ``moments`` gave of each."""
    return groups.agg(F.count("*").alias("datasets"), *[F.avg(c).alias(f"mean_{c}") for c in columns])
