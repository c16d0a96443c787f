"""A vector index over versioned Parquet tables: inserts, lazy deletes, compaction, search, recovery.

Layout under a folder: ``base/v<n>`` (id, vec, metadata, cluster_id; by list if
there are centroids), ``log`` (a change log), and a small table ``versions``
whose last row says which base holds and up to which sequence number. Tables are
never changed in place.

Upkeep follows each change: lists are trained once there are enough vectors, a
checkpoint (a new base) is made every ``auto_checkpoint`` changes, and the log
drops what the base has from ``auto_compact`` bytes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veclume.functions.vector import hints
from veclume.operators import kmeans
from veclume.operators.topk import merge
from veclume.plans.blocked import knn
from veclume.sources.changelog import ChangeLog, replay

BASE = "id bigint, vec array<float>, metadata map<string,string>, cluster_id int"
VERSIONS = "version bigint, seq bigint, nlist int, nprobe int, centroids array<array<double>>"


@dataclass(frozen=True)
class IndexConfig:
    dimension: int
    metric: str = "euclidean"
    kind: str = "flat"  # flat, ivf, ivf_auto
    nlist: int = 0
    nprobe: int = 0
    routing_threshold: int = 10_000
    minimum_training: int = 0
    recall: float = 0.9
    auto_train: bool = True
    auto_checkpoint: int = 0  # changes between checkpoints; 0: none by itself
    auto_compact: int = 0  # bytes of the log; 0: never by itself
    sync: str = "immediate"

    def __post_init__(self) -> None:
        if self.dimension <= 0:
            raise ValueError("dimension must be positive")
        if self.kind not in ("flat", "ivf", "ivf_auto"):
            raise ValueError(f"unknown kind {self.kind}")
        if self.kind == "ivf" and not 0 < self.nprobe <= self.nlist:
            raise ValueError("nprobe must be 1 to nlist")
        if self.kind == "ivf" and self.minimum_training and self.minimum_training < self.nlist:
            raise ValueError("training needs nlist vectors at least")

    def training_size(self, nlist: int) -> int:
        return self.minimum_training or max(10 * nlist, 1000)


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, config: IndexConfig) -> None:
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.log = ChangeLog(spark, f"{self.path}/log", config.sync)
        self.version, self.base_seq, self.seq, self.centroids = 0, -1, 0, None
        self.nprobe: int | None = None
        self.since_checkpoint = 0
        self.cached: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: IndexConfig) -> VectorIndex:
        """An index as it was: the last base, and the log after it."""
        out = cls(spark, path, config)
        if out._there("versions"):
            last = spark.read.schema(VERSIONS).parquet(f"{out.path}/versions").orderBy(F.desc("version")).first()
            out.version, out.base_seq = last.version, last.seq
            out.centroids = np.array(last.centroids, float) if last.centroids else None
            out.nprobe = last.nprobe
            out.seq = last.seq + 1
        if out.log.segments():
            out.log.entries(after=out.base_seq)  # raises at a wrong checksum
            last = out.log.statistics().first().last_seq
            out.seq = max(out.seq, (-1 if last is None else last) + 1)
            out.since_checkpoint = out.seq - out.base_seq - 1
        return out

    def _there(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _append(self, changes: DataFrame, n: int) -> None:
        self.log.append(changes, self.seq)
        self.seq += n
        self.since_checkpoint += n
        self.release()
        if self.config.auto_checkpoint and self.since_checkpoint >= self.config.auto_checkpoint:
            self.checkpoint()

    def checkpoint(self) -> int:
        """A new base of all changes so far, and an entry of it; the log drops the changes once it has auto_compact bytes."""
        version = self.compact(keep_log=True)
        self.log.checkpoint(self.seq)
        self.log.flush()
        self.seq += 1
        self.since_checkpoint = 0
        if self.config.auto_compact and self.log.statistics().first().bytes >= self.config.auto_compact:
            self.log.compact(self.base_seq)
        return version

    # -- cache -----------------------------------------------------------------

    def cache(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> VectorIndex:
        """Keep the rows as they are now on the executors until the next change or release."""
        if self.cached is None:
            self.cached = self._rows().persist(level)
        return self

    def release(self) -> None:
        """Let go of what is cached; tables stay."""
        if self.cached is not None:
            self.cached.unpersist()
            self.cached = None

    def cache_statistics(self) -> DataFrame:
        """One row: cached, level."""
        level = self.cached.storageLevel if self.cached is not None else StorageLevel.NONE
        return self.spark.createDataFrame([(self.cached is not None, str(level))], "cached boolean, level string")

    def _numbered(self, df: DataFrame, op: str) -> tuple[DataFrame, int]:
        """Sequence numbers in the order of ids: counts by range, then places within."""
        n = df.count()
        part = F.pmod(F.xxhash64("id"), F.lit(max(1, n // 100_000 + 1)))
        rows = df.withColumn("__p", part)
        sizes = {r[0]: r[1] for r in rows.groupBy("__p").count().collect()}
        base, at = [], 0
        for p in sorted(sizes):
            base.append((p, at))
            at += sizes[p]
        if not base:
            return df.withColumn("op", F.lit(op)).withColumn("n", F.lit(0)), 0
        table = self.spark.createDataFrame(base, "__p long, __b long")
        place = F.row_number().over(Window.partitionBy("__p").orderBy("id")) - 1
        return rows.withColumn("__r", place).join(F.broadcast(table), "__p").select("id", "vec", "metadata", F.lit(op).alias("op"), (F.col("__b") + F.col("__r")).alias("n")), n

    def insert(self, rows: DataFrame) -> int:
        """rows: (id, vec[, metadata]). Wrong dimensions raise; an id that is there is replaced."""
        metadata = F.col("metadata") if "metadata" in rows.columns else F.lit(None)
        right = F.when(F.size("vec") == self.config.dimension, F.col("vec")).otherwise(F.raise_error(F.lit(f"vector of another dimension than {self.config.dimension}")).cast(rows.schema["vec"].dataType))
        changes, n = self._numbered(rows.select(F.col("id").cast("long").alias("id"), right.alias("vec"), metadata.cast("map<string,string>").alias("metadata")), "insert")
        if n:
            self._append(changes, n)
            if self.config.auto_train and self.needs_training():
                self.train()
        return n

    def remove_one(self, id_: int) -> None:
        """Remove an id; one that is not there raises."""
        if not self.remove(self.spark.createDataFrame([(id_,)], "id long")):
            raise KeyError(id_)

    def remove(self, ids: DataFrame) -> int:
        """Number of ids that were there and are now removed."""
        there = self.rows().join(ids.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi").select("id", F.lit(None).cast("array<float>").alias("vec"), F.lit(None).cast("map<string,string>").alias("metadata"))
        changes, n = self._numbered(there, "remove")
        if n:
            self._append(changes, n)
        return n

    def set_metadata(self, rows: DataFrame) -> int:
        """Replace the metadata of ids that are there."""
        own = rows.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("array<float>").alias("vec"), F.col("metadata").cast("map<string,string>").alias("metadata"))
        changes, n = self._numbered(own.join(self.rows().select("id"), "id", "left_semi"), "metadata")
        if n:
            self._append(changes, n)
        return n

    def rows(self) -> DataFrame:
        """(id, vec, metadata, cluster_id): the base with the log after it applied; cluster_id is null for new rows."""
        return self.cached if self.cached is not None else self._rows()

    def _rows(self) -> DataFrame:
        self.log.flush()
        base = self.spark.read.schema(BASE).parquet(f"{self.path}/base/v{self.version}") if self.version else self.spark.createDataFrame([], BASE)
        if not self.log.segments() or self.base_seq == self.seq - 1:
            return base
        changes = self.log.entries(after=self.base_seq, verify=False)
        moved = changes.where(F.col("op").isin("insert", "remove")).select("id").distinct()
        fresh = replay(changes).withColumn("cluster_id", F.lit(None).cast("int"))
        meta = changes.where("op = 'metadata'").groupBy("id").agg(F.max_by(F.struct("metadata"), "seq").alias("m"))
        kept = base.join(moved, "id", "left_anti").join(meta, "id", "left").select("id", "vec", F.when(F.col("m").isNotNull(), F.col("m.metadata")).otherwise(F.col("metadata")).alias("metadata"), "cluster_id")
        return kept.unionByName(fresh)

    def compact(self, keep_log: bool = False) -> int:
        """A new base without deleted rows, and a log without what it has; with centroids, rows are stored by list. Ids stay.

        The base before stays for readers that have begun; older ones go.
        """
        rows = self.rows()
        version = self.version + 1
        if self.centroids is not None:
            rows = kmeans.assign(rows.drop("cluster_id"), self.centroids, "id", "vec").drop("distance")
            rows.write.partitionBy("cluster_id").parquet(f"{self.path}/base/v{version}")
        else:
            rows.write.parquet(f"{self.path}/base/v{version}")
        self._publish(version)
        self.release()
        if not keep_log and self.log.segments():
            self.log.compact(self.base_seq)
            self.since_checkpoint = 0
        self._drop(f"base/v{version - 2}")
        return version

    def _drop(self, name: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _publish(self, version: int) -> None:
        c = self.centroids.tolist() if self.centroids is not None else None
        self.spark.createDataFrame([(version, self.seq - 1, len(c or ()), self.nprobe, c)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        self.version, self.base_seq = version, self.seq - 1

    def train(self, nlist: int | None = None, seed: int = 0, iterations: int = 25) -> int:
        """Fit centroids, store rows by list, and measure how many lists the wanted recall takes."""
        rows = self.rows()
        n = rows.count()
        nlist = nlist or self.config.nlist or kmeans.recommended_nlist(n)
        if n < nlist:
            raise ValueError(f"{n} vectors for {nlist} lists")
        self.centroids = kmeans.fit(rows, nlist, iterations, seed=seed, id_col="id", vec="vec").centroids
        listed = kmeans.assign(rows.drop("cluster_id"), self.centroids, "id", "vec")
        self.nprobe = kmeans.measured_nprobe(listed, self.centroids, 10, self.config.recall, seed, "id", "vec")
        return self.compact()

    def needs_training(self) -> bool:
        if self.config.kind == "flat" or self.centroids is not None:
            return False
        n = self.rows().count()
        return n >= self.config.training_size(self.config.nlist or kmeans.recommended_nlist(n))

    def search(self, queries: DataFrame, k: int, where: Column | None = None, nprobe: int | None = None, query_id: str = "query_id") -> DataFrame:
        """(query_id, rank, id, distance); the filter comes first, so k rows return if k match.

        Lists are probed if there are centroids, no filter, and the table is
        large enough; else the search is exact. Rows not yet in a list are
        always compared.
        """
        queries = queries.select(F.col(query_id).alias("id"), "vec")
        rows = self.rows()
        n = rows.count() if self.centroids is not None and where is None else 0
        if self.centroids is not None and where is None and n >= self.config.routing_threshold and self.config.metric == "euclidean":
            nprobe = nprobe or self.config.nprobe or self.nprobe or kmeans.recommended_nprobe(len(self.centroids), self.config.recall)
            listed = kmeans.ivf_search(rows.where("cluster_id is not null"), self.centroids, queries, k, min(nprobe, len(self.centroids)), "id", "id", "vec")
            loose = knn(rows.where("cluster_id is null"), queries, k, "euclidean", "id", "id", "vec")
            return merge([listed, loose], "query_id", ["distance", "id"], k).select("query_id", "rank", "id", "distance")
        return knn(rows, queries, k, self.config.metric, "id", "id", "vec", where)

    def get(self, ids: list[int]) -> DataFrame:
        return self.rows().where(F.col("id").isin(ids)).withColumn("hints", hints("vec"))

    def vectors(self, ids: list[int]) -> dict[int, list[float]]:
        return {r.id: r.vec for r in self.get(ids).select("id", "vec").collect()}

    def metadata(self, id_: int) -> dict[str, str] | None:
        found = self.rows().where(F.col("id") == id_).select("metadata").first()
        return found and found.metadata

    def iterate(self) -> Iterator[Row]:
        """Rows one partition at a time."""
        return self.rows().toLocalIterator()

    def for_each(self, f: Callable[[Row], None]) -> None:
        """f of each row, on the executors."""
        self.rows().foreach(f)

    def contains(self, ids: DataFrame) -> DataFrame:
        """(id, found)."""
        own = self.rows().select("id", F.lit(True).alias("found"))
        return ids.select(F.col("id").cast("long").alias("id")).join(own, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))

    def handles(self, where: Column) -> DataFrame:
        return self.rows().where(where).select("id")

    def statistics(self) -> DataFrame:
        """One row: vectors, dimension, bytes, lists and the spread of their sizes, entries in the log."""
        rows = self.rows()
        sizes = rows.where("cluster_id is not null").groupBy("cluster_id").count().agg(F.count("*").alias("lists"), F.avg("count").alias("mean_list"), F.coalesce(F.stddev_pop("count"), F.lit(0.0)).alias("sd_list")).first()
        total = rows.agg(F.count("*").alias("vectors"), F.count("metadata").alias("with_metadata"))
        slots = self.spark.read.schema(BASE).parquet(f"{self.path}/base/v{self.version}").count() if self.version else 0
        live = rows.join(self.spark.read.schema(BASE).parquet(f"{self.path}/base/v{self.version}").select("id"), "id", "left_semi").count() if self.version else 0
        d = self.config.dimension
        return total.select("vectors", "with_metadata", F.lit(d).alias("dimension"), (F.col("vectors") * (4 * d)).alias("bytes"), F.lit(sizes.lists).alias("lists"), F.lit(sizes.mean_list).alias("mean_list"), F.lit(sizes.sd_list).alias("sd_list"), F.lit(self.seq).alias("log_entries"), F.lit(slots - live).cast("long").alias("replaced"), F.lit(fragmentation(live, slots)).alias("fragmentation"))


def fragmentation(active: int, slots: int) -> float:
    """Share of a base's rows that are gone from the index."""
    return 0.0 if not slots else 1 - active / slots
