"""Structured Streaming forms: event-time windows, rolling windows, sketches and redraws of a buffer."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.scalar import col, finite
from ..operators.downsample import append_and_downsample
from ..operators.series import anomalies
from ..sources.scratch import fresh


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sink(path: str, whole: bool) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own, so that one that is run again replaces what it wrote."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if whole else f"{path}/rows/batch={number}")

    return run


def run_available(out: DataFrame, mode: str, state_in_rocksdb: bool = False) -> DataFrame:
    """Runs a stream over what its source has now and returns the rows: in ``complete`` mode those of the last batch, else of all.

    Rows go to files and state to the folder that the cluster shares; nothing is gathered by the driver.
    """
    spark = out.sparkSession
    path = fresh(spark, "stream")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    if state_in_rocksdb:
        spark.conf.set(key, ROCKSDB)
    try:
        q = out.writeStream.foreachBatch(_sink(path, mode == "complete")).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(out.schema).parquet(*([f"{path}/rows"] if mode == "complete" else [f"{path}/rows/batch=*"]))


def run_every(out: DataFrame, interval: str, show: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Starts a stream whose batches are shown every ``interval`` of processing time, such as '500 milliseconds'."""
    path = fresh(out.sparkSession, "stream")
    return out.writeStream.foreachBatch(show).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(processingTime=interval).start()


def _utc(df: DataFrame, ts: str) -> DataFrame:
    """A time without a zone as an instant, read as UTC: event time needs instants."""
    if dict(df.dtypes)[ts] != "timestamp_ntz":
        return df
    return df.withColumn(ts, F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(ts)).cast("timestamp"))


def _back(c: Column, kind: str) -> Column:
    """The bound of a window as a time of the kind that the rows had."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz")) if kind == "timestamp_ntz" else c


def _held(stream: DataFrame, ts: str, late: str) -> tuple[DataFrame, str]:
    """Rows with instants, behind a watermark where they stream; the kind of time they had."""
    df = _utc(stream, ts)
    return (df.withWatermark(ts, late) if stream.isStreaming else df), dict(stream.dtypes)[ts]


def window_stats(stream: DataFrame, ts: str, value: str, length: str, late: str = "10 minutes", by: tuple[str, ...] = (), slide: str | None = None) -> DataFrame:
    """Statistics of tumbling or sliding event-time windows; rows later than the watermark are dropped."""
    v = F.when(finite(value), col(value))
    held, kind = _held(stream, ts, late)
    win = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = held.groupBy(win, *by).agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)).alias("std_dev"))
    return out.select(_back(F.col("window.start"), kind).alias("start"), _back(F.col("window.end"), kind).alias("end"), *by, "count", "min", "max", "mean", "std_dev")


def session_stats(stream: DataFrame, ts: str, value: str, gap: str, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """(start, end, by..., count, mean) of sessions that end after a gap."""
    held, kind = _held(stream, ts, late)
    out = held.where(finite(value)).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("count"), F.avg(col(value)).alias("mean"))
    return out.select(_back(F.col("w.start"), kind).alias("start"), _back(F.col("w.end"), kind).alias("end"), *by, "count", "mean")


def window_histogram(stream: DataFrame, ts: str, value: str, length: str, low: float, high: float, bins: int, late: str = "10 minutes") -> DataFrame:
    """(start, bin, count) of event-time windows over a fixed range; values outside count in the edge bins."""
    held, kind = _held(stream, ts, late)
    b = F.least(F.greatest(F.floor((col(value) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    out = held.where(finite(value)).groupBy(F.window(ts, length).alias("w"), b.alias("bin")).agg(F.count("*").alias("count"))
    return out.select(_back(F.col("w.start"), kind).alias("start"), "bin", "count")


def distinct_by_window(stream: DataFrame, ts: str, value: str, length: str, precision: int = 12, late: str = "10 minutes") -> DataFrame:
    """(start, sketch): mergeable HyperLogLog state of each event-time window."""
    held, kind = _held(stream, ts, late)
    return held.groupBy(F.window(ts, length).alias("w")).agg(F.hll_sketch_agg(value, F.lit(precision)).alias("sketch")).select(_back(F.col("w.start"), kind).alias("start"), "sketch")


def quantiles_by_window(stream: DataFrame, ts: str, value: str, length: str, late: str = "10 minutes") -> DataFrame:
    """(start, sketch): mergeable KLL state of each event-time window, read by ``kll_sketch_get_quantile_double``."""
    held, kind = _held(stream, ts, late)
    out = held.where(finite(value)).groupBy(F.window(ts, length).alias("w")).agg(F.kll_sketch_agg_double(col(value)).alias("sketch"))
    return out.select(_back(F.col("w.start"), kind).alias("start"), "sketch")


def log_buckets_by_window(stream: DataFrame, ts: str, value: str, length: str, accuracy: float = 0.01, late: str = "10 minutes") -> DataFrame:
    """(start, sign, bucket, count): counts by logarithmic bucket of each event-time window; states of two parts add up."""
    held, kind = _held(stream, ts, late)
    v, gamma = col(value), (1 + accuracy) / (1 - accuracy)
    bucket = F.when(v == 0, 0).otherwise(F.ceil(F.log(F.abs(v)) / math.log(gamma))).cast("int")
    out = held.where(finite(value)).groupBy(F.window(ts, length).alias("w"), F.signum(v).cast("int").alias("sign"), bucket.alias("bucket")).agg(F.count("*").alias("count"))
    return out.select(_back(F.col("w.start"), kind).alias("start"), "sign", "bucket", "count")


class RollingWindow(StatefulProcessor):
    """Statistics of the last ``size`` finite values of a key after each row; state is the window alone."""

    def __init__(self, size: int, key: str, order: str, value: str):
        self.size, self.key, self.order, self.value = size, key, order, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("window", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = [v[0] for v in self.held.get()] if self.held.exists() else []
        new = pd.concat(list(rows)).sort_values(self.order)
        new = new[new[self.value].notna() & ~new[self.value].isin([float("inf"), float("-inf")])]
        both = pd.Series(last + new[self.value].astype(float).tolist())
        roll = both.rolling(self.size, min_periods=1)
        tail = slice(len(last), None)
        out = pd.DataFrame({"key": key[0], "idx": new[self.order].to_numpy(), "length": roll.count()[tail].astype(int).to_numpy(), "mean": roll.mean()[tail].to_numpy(), "min": roll.min()[tail].to_numpy(), "max": roll.max()[tail].to_numpy(), "std_dev": roll.std()[tail].fillna(0.0).to_numpy()})
        self.held.put([(v,) for v in both.tail(self.size).tolist()])
        yield out

    def close(self) -> None:
        pass


def rolling_stream(stream: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """(key, idx, length, mean, min, max, std_dev) after every row.  Needs the RocksDB state store."""
    kinds = dict(stream.dtypes)
    shape = f"key {kinds[key]}, idx {kinds[order]}, length long, mean double, min double, max double, std_dev double"
    return stream.select(key, order, value).groupBy(key).transformWithStateInPandas(RollingWindow(max(1, size), key, order, value), shape, "Append", "None")


def redraw(path: str, x: str, y: str, tie: str, keep: int, target: int, show: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: appends to a bounded buffer at ``path``, then shows its LTTB.

    Each batch writes the buffer anew beside the one before, so that a batch that is run again
    starts from the same buffer.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(batch.schema).parquet(f"{path}/{number - 1}") if number else spark.createDataFrame([], batch.schema)
        batch.unionByName(old).orderBy(F.desc(x), F.desc(tie)).limit(keep).write.mode("overwrite").parquet(f"{path}/{number}")
        held = spark.read.parquet(f"{path}/{number}")
        show(append_and_downsample(held, spark.createDataFrame([], batch.schema), x, y, keep, target, tie), number)

    return run


def flag_batches(value: str, order: tuple[str, ...], sensitivity: float, show: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that looks for anomalies in each batch."""
    return lambda batch, number: show(anomalies(batch, value, list(order), sensitivity=sensitivity), number)
