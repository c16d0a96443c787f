"""A change log: append-only segments of Parquet rows with sequence numbers and checksums.

Operations: insert, remove, metadata, checkpoint. Replay keeps the last state of
each id; it may be run again, or over repeated entries, with the same outcome.

Each flush writes one more segment, a folder under the log's. Rewriting
(``compact``, ``truncate``) writes the new segment aside, moves it in by one
rename and then deletes the old ones: a reader, or a crash, between the steps
meets entries twice, never none.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "seq bigint, ts timestamp, op string, id bigint, vec array<float>, metadata map<string,string>, checksum string"
#: Segments from which ``flush`` merges them into one.
MAX_SEGMENTS = 10


def checksum() -> Column:
    """Of all but the time; vectors and sorted map entries enter as 64-bit hashes."""
    body = [F.col("seq").cast("string"), F.col("op"), F.col("id").cast("string"), F.xxhash64("vec").cast("string"), F.xxhash64(F.array_sort(F.map_entries("metadata"))).cast("string")]
    return F.sha2(F.concat_ws("|", *[F.coalesce(b, F.lit("~")) for b in body]), 256)


class ChangeLog:
    """sync: ``immediate`` writes each append, ``batch`` holds them until flush (or so many appends)."""

    def __init__(self, spark: SparkSession, path: str, sync: str = "immediate", batch: int = 16) -> None:
        if sync not in ("immediate", "batch"):
            raise ValueError(f"unknown sync mode {sync}")
        self.spark, self.path, self.sync, self.batch = spark, path.rstrip("/"), sync, batch
        self.held: list[DataFrame] = []

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def segments(self) -> list[str]:
        """Paths of the segments, in order."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path(self.path)) if f.isDirectory()]
        return [f"{self.path}/{n}" for n in sorted(names) if n.startswith("segment-")]

    def append(self, changes: DataFrame, first_seq: int) -> None:
        """changes: (op, id, vec, metadata, n), n from 0."""
        rows = changes.select((F.col("n") + first_seq).cast("long").alias("seq"), F.current_timestamp().alias("ts"), "op", F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec"), F.col("metadata").cast("map<string,string>").alias("metadata"))
        self.held.append(rows.withColumn("checksum", checksum()))
        if self.sync == "immediate" or len(self.held) >= self.batch:
            self.flush()

    def checkpoint(self, seq: int) -> None:
        """An entry that says that all before it is in the base."""
        self.append(self.spark.createDataFrame([("checkpoint", None, None, None, 0)], "op string, id long, vec array<float>, metadata map<string,string>, n long"), seq)

    def flush(self) -> None:
        if self.held:
            rows, self.held = reduce(DataFrame.unionByName, self.held), []
            # names sort in the order of writing
            rows.write.parquet(f"{self.path}/segment-{len(self.segments()):06d}-{uuid.uuid4().hex}")
            if len(self.segments()) > MAX_SEGMENTS:
                self._rewrite(self._read())

    def _read(self) -> DataFrame:
        paths = self.segments()
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def _rewrite(self, rows: DataFrame) -> None:
        old, aside = self.segments(), f"{self.path}/_new-{uuid.uuid4().hex}"
        rows.dropDuplicates(["seq"]).write.parquet(aside)
        fs, path = self._fs()
        fs.rename(path(aside), path(f"{self.path}/segment-000000-{uuid.uuid4().hex}"))
        for p in old:
            fs.delete(path(p), True)

    def entries(self, after: int = -1, verify: bool = True) -> DataFrame:
        """Entries after a sequence number; verify: read them once first and raise at a wrong checksum."""
        rows = self._read().where(F.col("seq") > after)
        if verify:
            bad = rows.where(F.col("checksum").isNull() | (F.col("checksum") != checksum())).agg(F.min("seq")).first()[0]
            if bad is not None:
                raise ValueError(f"change log: bad checksum at {bad}")
        return rows

    def replay(self, after: int = -1) -> DataFrame:
        return replay(self.entries(after))

    def truncate(self, after: int) -> None:
        """Roll back: drop the entries after a sequence number."""
        self._rewrite(self._read().where(F.col("seq") <= after))

    def compact(self, checkpoint: int = -1) -> None:
        """Drop the entries up to a checkpoint and merge the segments."""
        self._rewrite(self._read().where(F.col("seq") > checkpoint))

    def statistics(self) -> DataFrame:
        """One row: entries, last_seq, checkpoints, segments, bytes."""
        fs, path = self._fs()
        size = sum(fs.getContentSummary(path(p)).getLength() for p in self.segments())
        counts = self._read().agg(F.count("*").alias("entries"), F.max("seq").alias("last_seq"), F.count_if(F.col("op") == "checkpoint").alias("checkpoints"))
        return counts.withColumn("segments", F.lit(len(self.segments()))).withColumn("bytes", F.lit(size).cast("long"))


def replay(entries: DataFrame) -> DataFrame:
    """(id, vec, metadata) that are there after all entries: one partial aggregation by id."""
    data = entries.where(F.col("op").isin("insert", "remove"))
    last = data.groupBy("id").agg(F.max_by(F.struct("op", "vec", "metadata"), "seq").alias("e"), F.max("seq").alias("at"))
    meta = entries.where("op = 'metadata'").groupBy("id").agg(F.max_by(F.struct("metadata"), "seq").alias("m"), F.max("seq").alias("meta_at"))
    live = last.where("e.op = 'insert'").join(meta, "id", "left")
    metadata = F.when(F.col("meta_at") > F.col("at"), F.col("m.metadata")).otherwise(F.col("e.metadata"))
    return live.select("id", F.col("e.vec").alias("vec"), metadata.alias("metadata"))
