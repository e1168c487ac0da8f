"""Generated inputs for benchmarks and demonstrations, made on the executors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def random_walk(spark: SparkSession, n: int, seed: int = 0, keys: int = 1, step: float = 10.0, bias: float = 0.498) -> DataFrame:
    """(key, idx, x, y): walks of uniform steps about a slight drift, one for each key."""
    rows = spark.range(n * keys).select((F.col("id") % keys).alias("key"), F.floor(F.col("id") / keys).alias("idx"), ((F.rand(seed) - bias) * step).alias("d"))
    return rows.select("key", "idx", F.col("idx").cast("double").alias("x"), F.sum("d").over(Window.partitionBy("key").orderBy("idx")).alias("y"))


def uniform_points(spark: SparkSession, n: int, seed: int = 0, size: float = 1000.0, dims: int = 2) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), *((F.rand(seed + i) * size).alias(a) for i, a in enumerate("xyz"[:dims])))


def clustered_points(spark: SparkSession, n: int, seed: int = 0, clusters: int = 8, spread: float = 20.0, size: float = 1000.0) -> DataFrame:
    """(idx, cluster, x, y, z): normal clouds about centres on a helix."""
    c = F.col("id") % clusters
    turn = c * (2 * math.pi / clusters)
    middle = [F.cos(turn) * size / 3 + size / 2, F.sin(turn) * size / 3 + size / 2, (c + 0.5) * size / clusters]
    return spark.range(n).select(F.col("id").alias("idx"), c.alias("cluster"), *((m + F.randn(seed + i) * spread).alias(a) for i, (a, m) in enumerate(zip("xyz", middle))))


def price_walk(spark: SparkSession, n: int, seed: int = 0, start: float = 40_000.0, volatility: float = 0.002) -> DataFrame:
    """(idx, x, y): a geometric walk, x in seconds."""
    rows = spark.range(n).select(F.col("id").alias("idx"), (F.col("id") * 60.0).alias("x"), (F.randn(seed) * volatility).alias("d"))
    return rows.select("idx", "x", (start * F.exp(F.sum("d").over(Window.orderBy("idx")))).alias("y"))


def sensor_stream(spark: SparkSession, rows_per_second: int = 100, period: float = 60.0, noise: float = 0.1) -> DataFrame:
    """A stream of (ts, idx, value): a sine with noise."""
    src = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return src.select(F.col("timestamp").alias("ts"), F.col("value").alias("idx"), (F.sin(F.col("value") * (2 * math.pi / period / rows_per_second)) + (F.rand() - 0.5) * noise).alias("value"))
