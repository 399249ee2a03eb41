"""Shared-folder staging: tables written once and read back, so that lineage is cut durably."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session has none: on one machine (tests, local runs) a temporary folder, removed at the end; on a cluster the warehouse, which is shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        folder = tempfile.mkdtemp(prefix="curvelark-")
        atexit.register(shutil.rmtree, folder, True)
        own = "file://" + folder
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_curvelark"
    spark.sparkContext.setCheckpointDir(own)
    return own


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Survives lost executors, unlike a local checkpoint, and later passes read columns, not lineage. Within :func:`temporary` the
    folder is removed at the end of that; otherwise it stays as long as the shared folder, for results may be read from it at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end: for work whose result has been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def lasting() -> Iterator[None]:
    """Tables staged inside stay, whatever is around."""
    _scopes.append([])
    try:
        yield
    finally:
        _scopes.pop()


#: Rows of an Arrow batch when they are whole texts.
TEXT_BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Let Python functions of this session get at most TEXT_BATCH_ROWS rows at once: with long texts, the usual number would fill a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


def hash_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of ``key`` alone, and never many more; their number doesn't grow with the input, nor do a task's."""
    from pyspark.sql import functions as F

    share = int(min(1.0, 1.2 * rows / max(1, df.count())) * (1 << 40))
    place = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40))
    return df.where(place < share).orderBy(place, key).limit(rows)


def release_heap(spark: SparkSession) -> str | None:
    """Let the driver's JVM collect what earlier plans left: it would sooner take all the heap it may have, and keep it. Spark's cleaner then also drops broadcasts and shuffles out of use.

    What the JVM has freed outside its heap (of compilers, of many threads) goes back to the system too, where it knows the command for that; the result is what that says.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    asked = new(jvm.Object, 4)
    try:
        asked[0], asked[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")  # the server's own class is closed to callers
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), asked)
    except Py4JError:  # another JVM
        return None


def release_memory() -> None:
    """Give back to the system what this Python worker has freed: it stays idle for a while beside other stages, with all that it keeps."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
