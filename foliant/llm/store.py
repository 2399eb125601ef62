"""Shared-folder tables that cut lineage and survive a lost executor."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BYTES, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of the two or three numbers that a broadcast may hold: some tens of megabytes.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where it is unset: a temporary folder on a local master (tests), else a
    folder in the warehouse, which a cluster shares by definition.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        found = "file://" + tempfile.mkdtemp(prefix="foliant-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_foliant"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def bounded_batches(spark: SparkSession) -> None:
    """Send Python workers about a megabyte at once, so that long texts stay bounded; one row is a batch at least.

    The setting stays, as results are computed after this call; one that the
    caller made is left alone.
    """
    if _BYTES not in spark.conf.getAll:
        spark.conf.set(_BYTES, str(_BATCH_BYTES))


def frugal(run):
    """A batch function that gives freed memory back at the end of each task: workers live on for other stages."""

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass

    return inner


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The shuffle files of the write go when it is done, as nothing reads them
    any more. The table goes with ``free``, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    files, jpath = _file_system(spark, path)
    files.deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliant_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` made, once nothing will read them again."""
    for t in tables:
        path = getattr(t, "_foliant_path", None)
        if path:
            files, jpath = _file_system(t.sparkSession, path)
            files.delete(jpath, True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for a broadcast if its rows, counted now, are ``most`` at most; ``df`` should be a ``cut`` table of few columns."""
    return F.broadcast(df) if df.count() <= most else df
