"""Durable intermediate tables for iterative operators, and distributed ranks.

Tables are Parquet in a folder that all executors share: that of ``spark.checkpoint.dir``, or else the one
given to ``SparkContext.setCheckpointDir``. Each application writes below a folder of its own there, which is
deleted when the driver ends; tables that nothing reads any more can go earlier by :func:`discard`.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Without this, shuffle files stay until the driver's JVM happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _path(spark: SparkSession, path: str):
    """(file system, path) in the JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _remove(files, at) -> None:
    """At the end of the driver's Python, while its JVM may still answer."""
    try:
        files.delete(at, True)
    except Exception:  # the JVM has ended, and has deleted the folder if it could
        pass


def folder(spark: SparkSession) -> str:
    """This application's folder. Without a shared one, only a local master may use a temporary folder."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.gettempdir()}"
        found = f"{base.rstrip('/')}/lociweave-{app}-{uuid.uuid4().hex[:8]}"
        files, at = _path(spark, found)
        files.mkdirs(at)
        files.deleteOnExit(at)
        atexit.register(_remove, files, at)
        _own[app] = found
    return _own[app]


def cut(df: DataFrame, name: str = "step", batch_bytes: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: ends its lineage, survives lost executors.

    ``batch_bytes`` bounds the batches that Python functions of the plan get.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark, batch_bytes), brief_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lociweave_path = path
    return out


@contextmanager
def _setting(spark: SparkSession, key: str, value: str | None) -> Iterator[None]:
    """A session setting while a job runs; None leaves it."""
    before = spark.conf.get(key, None)
    if value is not None:
        spark.conf.set(key, value)
    try:
        yield
    finally:
        if value is not None and before is None:
            spark.conf.unset(key)
        elif value is not None:
            spark.conf.set(key, before)


def brief_shuffles(spark: SparkSession):
    """Jobs that start meanwhile delete their shuffle files when they end."""
    return _setting(spark, _CLEAN, "true")


def small_batches(spark: SparkSession, size: int | None):
    """Arrow batches of at most so many bytes while a job runs."""
    return _setting(spark, _BATCH, str(size) if size else None)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`cut` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_lociweave_path", None)
        if path:
            files, at = _path(df.sparkSession, path)
            files.delete(at, True)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """By columns into all shuffle partitions: adaptive execution, which goes by compressed bytes, would join them into
    ones that are large in memory."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *columns)


def ranked(df: DataFrame, *order, name: str = "ord", start: int = 0) -> DataFrame:
    """Add a global 0-based rank: range partitions are ranked alone and shifted by what precedes them.

    No task sees all rows; equal rows go to one partition, so ``order`` should tell rows apart.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranks")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_shift")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_own", own).join(shift, "_part").withColumn(name, (F.col("_own") + F.col("_shift") + start).cast("long")).drop("_part", "_own", "_shift")
