"""Tables between two steps of an operator, in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster.  Where it is unset, as in local
tests, a folder of this process is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared(spark: SparkSession) -> str:
    """The shared folder; in local mode without one, a temporary folder that goes with the process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="chartloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in a folder of its own in the shared folder, which goes when the session's JVM ends."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared(spark)}/{name}-{uuid.uuid4().hex}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return f"{folder.toString()}/t"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet, read back: what follows reads them again and not what made them."""
    path = fresh(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
