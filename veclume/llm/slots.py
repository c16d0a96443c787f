"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot is a hash of its id and text modulo a fixed number of slots,
thousands; it never changes. The map gives each slot a shard and is a small
stored table with a version. ``deal`` makes the first version, slots in turn,
before anything is known of the records. Bytes and rows are then summed by slot,
and ``rebalance`` edits the map for these sizes or another number of shards: a
shard keeps its slots, largest first, up to its share; the others go, largest
first, to the shard with the least bytes so far. Each edit is stored as the next
version beside the old ones. ``shard`` does all this in a folder: it takes the
last version that is there, or deals the first one, and assigns rows by the new
version as read back.

Law of the query: `bytes` (the sizes of shards are near equal). Slots bound the
driver's part: a row for each slot, whatever the number of records. A hot
source, a group of copies or an id of many rows is no hot slot, since neither
ids nor contents are hashed alone; only rows equal in both share a slot always.

Null text has no bytes. Null ids and texts hash as such. Rows of a slot are
numbered by id, then the hash of their text; rows equal in both are alike.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veclume.llm.scratch import Scratch

SLOTS = 8192
SHARDS = 40
ROW_BYTES = 16

MAP_SCHEMA = T.StructType([T.StructField("version", T.LongType()), T.StructField("shards", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("bytes", T.LongType()), T.StructField("rows", T.LongType())])


@dataclass(frozen=True)
class SlotMap:
    """A version of the map: shard, bytes and rows of each slot."""

    version: int
    shards: int
    shard: tuple[int, ...]
    bytes: tuple[int, ...]
    rows: tuple[int, ...]

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for s, b in zip(self.shard, self.bytes, strict=True):
            out[s] += b
        return out


def slot_of(id_col: str, text_col: str, slots: int = SLOTS) -> F.Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(slots)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    return docs.select(
        F.col(id_col), (F.octet_length(F.coalesce(text_col, F.lit(""))) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text_col, F.lit("")), "UTF-8")).alias("text_crc32"), slot_of(id_col, text_col, slots).alias("virtual_slot"), F.xxhash64(text_col).alias("__tie"),
    )


def deal(shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
    """The first version: slots in turn, of unknown sizes."""
    return SlotMap(1, shards, tuple(k % shards for k in range(slots)), (0,) * slots, (0,) * slots)


def measured(rows: DataFrame, slots: int = SLOTS) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Bytes and rows of each slot of rows (virtual_slot, size); the driver gets a row per slot."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.virtual_slot], count[r.virtual_slot] = r.b, r.n
    return tuple(size), tuple(count)


def rebalance(old: SlotMap, shards: int, size: tuple[int, ...] | None = None, rows: tuple[int, ...] | None = None) -> SlotMap:
    """The next version, for this number of shards and these sizes: slots leave what is gone, then what is overfull."""
    size, rows = size or old.bytes, rows or old.rows
    goal = sum(size) / shards
    shard, load = list(old.shard), [0] * shards
    loose = []
    by: dict[int, list[int]] = {}
    for k, s in enumerate(shard):
        by.setdefault(s, []).append(k)
    for s, own in by.items():
        for k in sorted(own, key=lambda k: (-size[k], k)):
            if s < shards and load[s] + size[k] <= goal:
                load[s] += size[k]
            else:
                loose.append(k)
    heap = [(b, s) for s, b in enumerate(load)]
    heapq.heapify(heap)
    for k in sorted(loose, key=lambda k: (-size[k], k)):
        b, s = heapq.heappop(heap)
        shard[k] = s
        heapq.heappush(heap, (b + size[k], s))
    return SlotMap(old.version + 1, shards, tuple(shard), tuple(size), tuple(rows))


def map_table(spark: SparkSession, m: SlotMap) -> DataFrame:
    return spark.createDataFrame([(m.version, m.shards, k, s, b, n) for k, (s, b, n) in enumerate(zip(m.shard, m.bytes, m.rows, strict=True))], MAP_SCHEMA)


def save_map(spark: SparkSession, m: SlotMap, path: str) -> None:
    """Write the version beside the others; a version that is there already is an error."""
    map_table(spark, m).coalesce(1).write.mode("error").parquet(f"{path}/version={m.version}")


def map_there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The given version, or the last."""
    rows = spark.read.schema(MAP_SCHEMA).parquet(path)
    version = version if version is not None else rows.agg(F.max("version")).first()[0]
    held = rows.where(F.col("version") == version).orderBy("slot").collect()
    if not held:
        raise ValueError(f"no version {version} of the map at {path}")
    return SlotMap(version, held[0].shards, tuple(r.shard for r in held), tuple(r.bytes for r in held), tuple(r.rows for r in held))


def assign(rows: DataFrame, m: SlotMap, id_col: str = "doc_id") -> DataFrame:
    """Adds shard and slot, a row's place in its shard: its virtual slot's first place and the place there."""
    first, at = [], [0] * m.shards
    for s, n in zip(m.shard, m.rows, strict=True):
        first.append(at[s])
        at[s] += n
    table = rows.sparkSession.createDataFrame([(k, s, f) for k, (s, f) in enumerate(zip(m.shard, first, strict=True))], "virtual_slot long, shard int, __first long")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(id_col, "__tie", "size", "text_crc32"))
    placed = rows.withColumn("__place", place - 1)
    return placed.join(F.broadcast(table), "virtual_slot").withColumn("slot", F.col("__first") + F.col("__place")).drop("__first", "__place", "__tie")


def shard(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> tuple[DataFrame, SlotMap]:
    """Rows with their shard and slot, by the map at path as rebalanced for them and stored."""
    spark = docs.sparkSession
    rows = sized(docs, id_col, text_col, slots)
    if not map_there(spark, path):
        save_map(spark, deal(shards, slots), path)
    save_map(spark, rebalance(load_map(spark, path), shards, *measured(rows, slots)), path)
    m = load_map(spark, path)
    return assign(rows, m, id_col), m


def sharding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per document, by a map that is dealt, stored, rebalanced for the sizes, stored and read back."""
    out, m = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{Scratch(spark, 'slots').root}/map")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(m.version).cast("long").alias("map_version"))
