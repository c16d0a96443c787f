"""Tables written to the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode one is set where it is unset, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='veclume-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at


def release(spark: SparkSession) -> None:
    """Give back now what finished steps have left, not when garbage happens to be collected next.

    The driver's collection lets Spark delete their shuffle files and broadcasts.
    The executors' lets them return heap: each keeps what its largest step took,
    beside the Python workers of the steps that follow.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


class Scratch:
    """A folder of Parquet tables of one operator's run; what is left of it goes when the application ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        fs, at = self._fs(self.root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and read it again."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing will read again."""
        fs, at = self._fs(df._scratch_path)
        fs.delete(at, True)
