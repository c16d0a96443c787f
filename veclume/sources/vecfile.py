"""Binary vector files: a 16-byte header (count, dimension, type, reserved) and rows, little-endian.

Fixed values of the format: types 0 float32, 1 float16, 2 int8, 3 uint8.
``read`` is a Python data source over a file or a folder of files: a partition
per range of rows, read by seek; ids count the rows in the order of the files'
names. ``write`` is its sink: a file a partition, under a name of its own until
the job commits, so that attempts that are lost or repeated leave nothing behind.
Their paths must be reachable from the executors (a shared mount); for stores
that only Spark reaches, ``read_binary`` takes whole files through Spark.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

HEADER, HEADER_SIZE = "<iiII", 16
TYPES = {0: np.dtype("<f4"), 1: np.dtype("<f2"), 2: np.dtype("i1"), 3: np.dtype("u1")}
NAMES = {"float32": 0, "float16": 1, "int8": 2, "uint8": 3}
SCHEMA = "id bigint, vec array<float>"
PARTITION_BYTES = 64 << 20
BATCH_ROWS = 4096
SUFFIX = ".vec"


def header(data: bytes) -> tuple[int, int, np.dtype]:
    count, dim, kind, _ = struct.unpack_from(HEADER, data)
    if count < 0 or dim <= 0 or kind not in TYPES:
        raise ValueError(f"not a vector file: count {count}, dimension {dim}, type {kind}")
    return count, dim, TYPES[kind]


def encode(vectors: np.ndarray, kind: str = "float32") -> bytes:
    code = NAMES[kind]
    x = np.asarray(vectors)
    if TYPES[code].kind in "iu":
        info = np.iinfo(TYPES[code])
        x = np.clip(np.rint(x), info.min, info.max)
    return struct.pack(HEADER, len(x), x.shape[1], code, 0) + x.astype(TYPES[code]).tobytes()


def _batch(first: int, x: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(x.astype(np.float32).reshape(-1))
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(x))), pa.ListArray.from_arrays(offsets, flat)], ["id", "vec"])


class Range(InputPartition):
    """Rows first to end of a file whose first row has the id begin."""

    def __init__(self, path: str, begin: int, first: int, end: int) -> None:
        self.path, self.begin, self.first, self.end = path, begin, first, end


def _local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/")


class VectorReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = _local(options["path"])
        self.first, self.limit = int(options.get("first", 0)), options.get("rows")

    def partitions(self) -> list[Range]:
        files = sorted(f"{self.path}/{n}" for n in os.listdir(self.path) if n.endswith(SUFFIX)) if os.path.isdir(self.path) else [self.path]
        stop = None if self.limit is None else self.first + int(self.limit)
        out, begin = [], 0
        for path in files:
            with open(path, "rb") as f:
                count, dim, kind = header(f.read(HEADER_SIZE))
            a, b = max(self.first - begin, 0), count if stop is None else min(count, stop - begin)
            step = max(1, PARTITION_BYTES // (dim * kind.itemsize))
            out += [Range(path, begin, k, min(k + step, b)) for k in range(a, b, step)]
            begin += count
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.end:
            return
        with open(partition.path, "rb") as f:
            _, dim, kind = header(f.read(HEADER_SIZE))
            f.seek(HEADER_SIZE + partition.first * dim * kind.itemsize)
            for a in range(partition.first, partition.end, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.end - a)
                x = np.frombuffer(f.read(n * dim * kind.itemsize), kind).reshape(n, dim)
                yield _batch(partition.begin + a, x)


@dataclass
class Written(WriterCommitMessage):
    aside: str
    path: str
    rows: int


class VectorWriter(DataSourceArrowWriter):
    """Files part-<number>.vec of (id, vec) rows."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.kind, self.overwrite = _local(options["path"]), options.get("kind", "float32"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        number = TaskContext.get().partitionId()
        aside = f"{self.path}/_part-{number:05d}-{uuid.uuid4().hex}"
        rows, dim = 0, 0
        with open(aside, "wb") as f:
            f.write(struct.pack(HEADER, 0, 0, NAMES[self.kind], 0))
            for batch in iterator:
                if not len(batch):
                    continue
                sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                dim = dim or int(sizes[0])
                if (sizes != dim).any():
                    raise ValueError(f"vectors of unequal length: {int(sizes[sizes != dim][0])}, not {dim}")
                f.write(encode(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dim), self.kind)[HEADER_SIZE:])
                rows += len(batch)
            f.seek(0)
            f.write(struct.pack(HEADER, rows, dim, NAMES[self.kind], 0))
        return Written(aside, f"{self.path}/part-{number:05d}{SUFFIX}", rows)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for n in os.listdir(self.path) if os.path.isdir(self.path) else []:
                if n.endswith(SUFFIX):
                    os.remove(f"{self.path}/{n}")
        for m in messages:
            if m is not None and m.rows:
                os.replace(m.aside, m.path)
            elif m is not None:
                os.remove(m.aside)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.aside):
                os.remove(m.aside)


class VectorSource(DataSource):
    """spark.read.format("vecfile").option("first", ...).option("rows", ...).load(path); df.write.format("vecfile").option("kind", ...).save(path)"""

    @classmethod
    def name(cls) -> str:
        return "vecfile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options)

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options, overwrite)


def read(spark: SparkSession, path: str, first: int = 0, rows: int | None = None) -> DataFrame:
    spark.dataSource.register(VectorSource)
    r = spark.read.format("vecfile").option("first", str(first))
    return (r if rows is None else r.option("rows", str(rows))).load(path)


def write(df: DataFrame, path: str, kind: str = "float32", id_col: str = "vec_id", vec: str = "embedding") -> None:
    """Files of the vectors in the order of their ids, as ``read`` takes them; null vectors are left out."""
    df.sparkSession.dataSource.register(VectorSource)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("vec")).where("vec is not null")
    rows.repartitionByRange("id").sortWithinPartitions("id").write.format("vecfile").option("kind", kind).mode("overwrite").save(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, vec) of all files under a path that Spark reads; a task holds a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = data.as_buffer()
                count, dim, kind = header(raw.slice(0, HEADER_SIZE).to_pybytes())
                x = np.frombuffer(raw, kind, count * dim, HEADER_SIZE).reshape(count, dim)
                for a in range(0, count, BATCH_ROWS):
                    part = _batch(a, x[a : a + BATCH_ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), *part.columns], ["file", "id", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, {SCHEMA}")


def write_parts(df: DataFrame, path: str, kind: str = "float32", id_col: str = "vec_id", vec: str = "embedding", rows_a_file: int = 100_000) -> None:
    """Vector files as rows of a Parquet table (first id, rows, file), in id order in each; any store Spark reaches will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = [], []

        def file() -> pa.RecordBatch:
            x = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([ids[0]]), pa.array([len(x)]), pa.array([encode(x, kind)], pa.binary())], ["first_id", "rows", "file"])

        for batch in batches:
            if len(batch):
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                held.append(x)
                ids += batch.column(0).to_pylist()
            if len(ids) >= rows_a_file:
                yield file()
                held, ids = [], []
        if ids:
            yield file()

    rows = df.select(F.col(id_col).cast("long"), vec).where(F.col(vec).isNotNull()).repartitionByRange(id_col).sortWithinPartitions(id_col)
    rows.mapInArrow(run, "first_id long, rows long, file binary").write.parquet(path)
