"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster.  Where it is unset, as
in local tests, a folder of this process is used and set.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_ROOT = "chartloom"


def shared(spark: SparkSession) -> str:
    """The shared folder; in local mode without one, a new temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="chartloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Tables of one run of an operator; ``drop`` removes one that is not needed any more, the end of the JVM all."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared(spark)}/{_ROOT}/{uuid.uuid4().hex}"
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows as Parquet and reads them back: lineage ends at the files."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables, and lets Spark remove the shuffle files of plans that are done with."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()
        _trim_driver(self.spark)


def _trim_driver(spark: SparkSession) -> None:
    """Hands native memory that the driver's JVM has freed back to the system, where the JVM can."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # The server's class is not open; its interface is.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        args = array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, args)
    except Py4JError:
        pass


def tidy(run: Callable[[Any], Iterator]) -> Callable[[Any], Iterator]:
    """A function for ``mapInArrow`` after whose last batch the worker hands freed memory back to the system.

    Workers are kept for later tasks, and their memory counts as the executor's.
    """

    def whole(batches):
        yield from run(batches)
        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds the bytes of the batches handed to Python, so that long texts do not make large ones.

    Left alone where the session has its own bound.  Results do not depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    # Fixed value: Spark's default of 64 MB, which two tasks of an executor double in the JVM and hold again in Python.
    if spark.conf.get(name) in ("67108864b", "67108864", "64m"):
        spark.conf.set(name, size)
