"""Arrow batches of bounded bytes between Spark and Python, both ways.

Texts differ in length by orders of magnitude, so a number of rows bounds
nothing. ``over_arrow`` asks Spark for batches of ``BATCH_BYTES`` at most (a
longer row is a batch of its own) and cuts what a function returns likewise, so
the buffers of either side stay small whatever an operator does. The limits are
settings of the session, which Spark reads when a plan runs: every operator of
this folder sets them alike, so none depends on what ran before.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BATCH_BYTES = 2 << 20
#: Rows of a batch at most; a bound on what short rows cost as Python objects.
BATCH_ROWS = 10_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits of a batch to this module's, where they are higher."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    for key, most in limits.items():
        held = spark.conf.get(key).removesuffix("b")
        if not held.lstrip("-").isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch, in slices of about BATCH_BYTES."""
    n = -(-batch.nbytes // BATCH_BYTES)
    if n <= 1 or len(batch) <= 1:
        yield batch
        return
    step = -(-len(batch) // n)
    for i in range(0, len(batch), step):
        yield batch.slice(i, step)


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def bounded(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in run(batches):
                yield from pieces(out)
        finally:
            trim()

    return cut


def over_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema), in batches of bounded bytes."""
    small_batches(df.sparkSession)
    return df.mapInArrow(bounded(run), schema)

