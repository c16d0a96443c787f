"""Quality of quantized vectors: per row, over all, by method, and over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veclume.functions import quant as Q
from veclume.operators.stats import selected
from veclume.storage import kept


def row_quality(df: DataFrame, original: str, decoded: str) -> DataFrame:
    """Adds mse, rmse, max_error, psnr, snr and class of each row."""
    error = Q.mse(original, decoded)
    out = df.withColumn("mse", error).withColumn("rmse", F.sqrt("mse")).withColumn("max_error", Q.max_error(original, decoded)).withColumn("psnr", Q.psnr(original, F.col("mse")))
    snr = F.when(F.col("mse") > 0, 10 * F.log10(1 / F.when(F.col("mse") > 0, F.col("mse")))).otherwise(F.lit(float("inf")))
    return out.withColumn("snr", snr).withColumn("class", Q.quality_class(F.col("psnr")))


def batch_quality(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Figures over rows of row_quality; p95 is the nearest rank of the errors."""
    by = by or []
    p95 = selected(rows, "mse", (0.95,), by, nearest=True).withColumn("p95_mse", F.get("q", F.lit(0))).drop("q")
    whole = None if by else p95.first().p95_mse
    found = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("mse").alias("mean_mse"), F.min("mse").alias("min_mse"), F.max("mse").alias("max_mse"), F.coalesce(F.stddev_pop("mse"), F.lit(0.0)).alias("sd_mse"),
        F.avg(F.when(F.col("psnr") < float("inf"), F.col("psnr"))).alias("mean_psnr"),
        *[F.count_if(F.col("class") == c).alias(f"n_{c}") for c in ("excellent", "good", "acceptable", "poor")],
    )
    return found.join(p95, by) if by else found.withColumn("p95_mse", F.lit(whole).cast("double"))


def poor_rows(rows: DataFrame, most_mse: float, id_col: str = "vec_id") -> DataFrame:
    return rows.where(F.col("mse") > most_mse).select(id_col, "mse")


def compare(df: DataFrame, original: str, methods: dict[str, Column]) -> DataFrame:
    """Batch figures by method; methods: a decoded vector each."""
    parts = [row_quality(df.select(F.lit(name).alias("method"), F.col(original), d.alias("decoded")), original, "decoded").drop(original, "decoded") for name, d in methods.items()]
    return batch_quality(reduce(DataFrame.unionByName, parts), ["method"])


#: Rows of a stretch that a task slides over where there are no groups.
STRETCH = 100_000


def stretches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds stretch and lead: rows in ranges of the order, each with the size - 1 rows before it again (lead).

    Rows are numbered by range, then over ranges by their counts, so no task
    holds more than a range.
    """
    ranged = kept(df.repartitionByRange(F.col(order)).withColumn("range_no", F.spark_partition_id()), "sliding")
    counts = ranged.groupBy("range_no").count().orderBy("range_no").collect()  # a row a partition
    first, at = [], 0
    for r in counts:
        first.append((r.range_no, at))
        at += r["count"]
    begins = df.sparkSession.createDataFrame(first, "range_no int, range_first long")
    place = F.row_number().over(Window.partitionBy("range_no").orderBy(order)) - 1
    numbered = ranged.withColumn("place", place).join(F.broadcast(begins), "range_no").withColumn("place", F.col("place") + F.col("range_first")).drop("range_no", "range_first")
    own = F.floor(F.col("place") / STRETCH)
    again = F.when((F.col("place") + size - 1) / STRETCH >= own + 1, F.array(own, own + 1)).otherwise(F.array(own))
    out = numbered.withColumn("own_stretch", own).withColumn("stretch", F.explode(again))
    return out.withColumn("lead", F.col("stretch") > F.col("own_stretch")).drop("own_stretch", "place")


def sliding(df: DataFrame, order: str, value: str, by: str | None = None, size: int = 100, step: float = 0.0) -> DataFrame:
    """Adds the mean of the last ``size`` values, and degrading: of the window (10 or more) the last 5 average over the first 5 plus step.

    Without ``by`` the rows go in stretches, so that no task gets all of them.
    """
    if by is None:
        out = _slide(stretches(df, order, size), order, value, "stretch", size, step)
        return out.where(~F.col("lead")).drop("lead", "stretch")
    return _slide(df, order, value, by, size, step)


def _slide(df: DataFrame, order: str, value: str, by: str, size: int, step: float) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(size - 1), 0)
    held = F.collect_list(value).over(w)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / 5
    late, early = mean(F.slice("__w", -5, 5)), mean(F.slice("__w", 1, 5))
    out = df.withColumn("sliding_mean", F.avg(value).over(w)).withColumn("__w", held)
    return out.withColumn("degrading", F.when(F.size("__w") >= 10, late > early + step).otherwise(False)).drop("__w")
