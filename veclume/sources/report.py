"""Reports of measured figures: printed as a table, or kept as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, figures map<string,double>"


def report(df: DataFrame, name: str) -> DataFrame:
    """(name, figures): a row per row of df, its number columns as a map; name is a column."""
    numbers = [f.name for f in df.schema if f.name != name and f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    return df.select(F.col(name).cast("string").alias("name"), F.map_from_arrays(F.array(*[F.lit(c) for c in numbers]), F.array(*[F.col(c).cast("double") for c in numbers])).alias("figures"))


def save(df: DataFrame, name: str, path: str) -> None:
    report(df, name).write.mode("append").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def console(df: DataFrame, rows: int = 20) -> str:
    """The table as text, of the first rows."""
    return df._jdf.showString(rows, 40, False)
