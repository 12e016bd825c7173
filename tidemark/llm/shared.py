"""The folder that driver and executors share, and tables written to it to cut lineage."""

from __future__ import annotations

import atexit
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where that is unset (as in tests) one of its own in the warehouse."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        d = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not d:
        d = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lost executors then cost a read, not a new computation."""
    path = new_dir(df.sparkSession, name)
    _at_end(df.sparkSession, path)
    df.write.options(**options).format(fmt).save(path)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


_kept: list[str] = []


def _at_end(spark: SparkSession, path: str) -> None:
    """Deletes a table when Python ends, as long as the session lives then."""
    if not _kept:
        atexit.register(lambda: [remove(spark, p) for p in _kept] if spark.sparkContext._jsc is not None else None)
    _kept.append(path)


class Scratch:
    """Tables that only a step's own work needs: all are deleted when it ends, but for those that are kept for its result. Kept ones go when Python ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = new_dir(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, by Hadoop's file system, wherever that is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Returns memory that a worker no longer uses to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def small_batches(spark: SparkSession, megabytes: int = 16) -> None:
    """Bounds what Python gets at once by bytes, as texts may be very long."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")):
        try:
            spark.conf.set(key, value)
        except Exception as e:  # a fixed or unknown setting keeps its value
            if "CANNOT_MODIFY" not in str(e):
                raise
