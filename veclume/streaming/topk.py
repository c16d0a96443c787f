"""Running top-k over a stream of vectors, and other operators over streams.

State is k rows a query: each micro-batch gives its own k nearest (a bounded
set), which are merged with the stored ones. The merge is associative and
drops repeats, so a batch that is replayed does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veclume.operators.topk import merge
from veclume.plans.blocked import knn

SCHEMA = "query_id long, rank long, id long, distance double"


class StreamingTopK:
    """Keeps the k nearest rows of each query in versioned tables under a folder."""

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, k: int, metric: str = "euclidean", id_col: str = "vec_id", vec: str = "embedding") -> None:
        self.spark, self.path, self.queries, self.k, self.metric, self.id_col, self.vec = spark, path.rstrip("/"), queries, k, metric, id_col, vec
        self.last: int | None = None

    def _table(self, version: int) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/batch={version}")

    def update(self, batch: DataFrame, batch_id: int) -> None:
        found = knn(batch, self.queries, self.k, self.metric, self.id_col, self.id_col, self.vec)
        parts = [found] + ([self._table(self.last)] if self.last is not None and self.last != batch_id else [])
        merge(parts, "query_id", ["distance", "id"], self.k, ["query_id", "id"]).select("query_id", "rank", "id", "distance").write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        self.last = batch_id

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def result(self) -> DataFrame:
        if self.last is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self._table(self.last)


def vector_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    """Files of vectors as a stream, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed(events: DataFrame, ts: str, key: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum by event-time window and key; rows later than the watermark are dropped (streams)."""
    w = F.window(ts, size, slide or size)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by key: runs of events less than the gap apart."""
    w = F.session_window(ts, gap)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")
