"""Named tensors: stored as Parquet rows, loaded as NumPy arrays for broadcast."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "name string, shape array<int>, dtype string, data binary"
DTYPES = ("float32", "float16", "int8", "uint8", "float64")
#: Bytes of weights that may be loaded on the driver.
MAX_BYTES = 256 << 20


def save(spark: SparkSession, tensors: dict[str, np.ndarray], path: str) -> None:
    rows = [(n, list(t.shape), str(t.dtype), np.ascontiguousarray(t).tobytes()) for n, t in tensors.items()]
    for name, _, dtype, _ in rows:
        if dtype not in DTYPES:
            raise ValueError(f"{name}: type {dtype} is not one of {', '.join(DTYPES)}")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).selectExpr("name", "shape", "dtype", "octet_length(data) as bytes")


def load(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    size = manifest(spark, path).agg({"bytes": "sum"}).first()[0] or 0
    if size > MAX_BYTES:
        raise ValueError(f"{size} bytes of weights; at most {MAX_BYTES}")
    rows = spark.read.schema(SCHEMA).parquet(path).collect()
    return {r.name: np.frombuffer(bytes(r.data), r.dtype).reshape(r.shape).copy() for r in rows}


def broadcast_compatible(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether shapes match from the right, ones fitting any size."""
    return all(x == y or 1 in (x, y) for x, y in zip(reversed(a), reversed(b), strict=False))
