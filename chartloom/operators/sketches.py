"""Mergeable sketches: partial aggregates that Spark combines before and after the shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import col, finite
from .stats import attach


def distinct_count(df: DataFrame, value: str, precision: int = 14, by: Sequence[str] = ()) -> DataFrame:
    """(estimate): HyperLogLog++ with a standard error of 1.04 / sqrt(2 ** precision); precision is held in 4..18."""
    p = min(18, max(4, precision))
    return df.groupBy(*by).agg(F.approx_count_distinct(value, 1.04 / math.sqrt(2**p)).alias("estimate"))


def distinct_sketch(df: DataFrame, value: str, precision: int = 14, by: Sequence[str] = ()) -> DataFrame:
    """(sketch): the binary state, to be merged with ``merge_distinct``."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, F.lit(min(18, max(4, precision)))).alias("sketch"))


def merge_distinct(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def hll_registers(df: DataFrame, value: str, precision: int = 10) -> DataFrame:
    """(bucket, rank): the registers themselves, over md5, so that any engine gives the same."""
    h = F.conv(F.substring(F.md5(F.encode(F.col(value).cast("string"), "UTF-8")), 1, 15), 16, 10).cast("long")
    rest = 60 - precision
    tail = h.bitwiseAND(F.lit((1 << rest) - 1))
    # The place of the highest bit that is set; a tail of zeros has rank rest + 1.
    rank = F.when(tail == 0, rest + 1).otherwise(rest - F.length(F.bin(tail)) + 1)
    return df.where(F.col(value).isNotNull()).groupBy(F.shiftright(h, rest).cast("int").alias("bucket")).agg(F.max(rank).cast("int").alias("rank"))


def hll_estimate(registers: DataFrame, precision: int = 10) -> DataFrame:
    """(estimate): the harmonic mean over all registers, or linear counting where many are empty."""
    m = 1 << precision
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    one = registers.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("s"))
    raw = alpha * m * m / (F.col("s") + (m - F.col("n")))
    empty = m - F.col("n")
    return one.select(F.when((raw <= 2.5 * m) & (empty > 0), m * F.ln(m / empty)).otherwise(raw).alias("estimate"))


def count_min(df: DataFrame, value: str, width: int = 1024, depth: int = 5, weight: str | None = None) -> DataFrame:
    """(depth, cell, total): the counter table of a count-min sketch, without empty cells."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    width, depth = width or 1024, depth or 5
    # Each task sums at most width x depth counters before anything is dealt out.
    rows = df.where(F.col(value).isNotNull()).select(w.alias("w"), value)
    rows = rows.select("w", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("depth"), F.col(value))
    return rows.groupBy("depth", cell(value, width, F.col("depth")).alias("cell")).agg(F.sum("w").alias("total"))


def cell(value: str, width: int, depth) -> F.Column:
    """The cell of a value in a row of the sketch; md5, so that any engine gives the same."""
    text = F.concat_ws(":", depth.cast("string"), F.col(value).cast("string"))
    return (F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 12), 16, 10).cast("long") % (width or 1024)).cast("int")


def count_min_estimate(probes: DataFrame, value: str, sketch: DataFrame, width: int = 1024, depth: int = 5) -> DataFrame:
    """(value, estimate): never below the true count.  The sketch has width * depth rows at most and is broadcast."""
    wide = probes.select(value).distinct().withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit((depth or 5) - 1))))
    wide = wide.withColumn("cell", cell(value, width, F.col("depth")))
    return wide.join(F.broadcast(sketch), ["depth", "cell"], "left").groupBy(value).agg(F.min(F.coalesce("total", F.lit(0))).alias("estimate"))


def top_k(df: DataFrame, value: str, k: int = 10) -> DataFrame:
    """(value, count): exact heavy hitters, of equals the least value."""
    return df.groupBy(value).agg(F.count("*").alias("count")).orderBy(F.desc("count"), value).limit(k)


def kll(df: DataFrame, value: str, at: Sequence[float], k: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """(q, value): quantiles of a KLL sketch of the finite values."""
    sketch = df.where(finite(value)).groupBy(*by).agg(F.kll_sketch_agg_double(col(value), F.lit(max(8, k or 200))).alias("s"))
    pairs = F.array(*(F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_double("s", F.lit(float(q))).alias("value")) for q in at))
    return sketch.select(*by, F.explode(pairs).alias("e")).select(*by, "e.*")


def kll_ranks(df: DataFrame, value: str, at: Sequence[float], k: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """(value, rank): inclusive ranks of given values in a KLL sketch, which is its distribution function there."""
    sketch = df.where(finite(value)).groupBy(*by).agg(F.kll_sketch_agg_double(col(value), F.lit(max(8, k or 200))).alias("s"))
    pairs = F.array(*(F.struct(F.lit(float(v)).alias("value"), F.kll_sketch_get_rank_double("s", F.lit(float(v))).alias("rank")) for v in at))
    return sketch.select(*by, F.explode(pairs).alias("e")).select(*by, "e.*")


def approx_percentiles(df: DataFrame, value: str, at: Sequence[float], accuracy: int = 10_000, by: Sequence[str] = ()) -> DataFrame:
    """(q, value) by Greenwald-Khanna summaries."""
    v = F.when(finite(value), col(value))
    one = df.groupBy(*by).agg(F.percentile_approx(v, [float(q) for q in at], accuracy).alias("__v"))
    pairs = F.array(*(F.struct(F.lit(float(q)).alias("q"), F.col("__v")[i].alias("value")) for i, q in enumerate(at)))
    return one.select(*by, F.explode(pairs).alias("e")).select(*by, "e.*")


def _merge_centroids(mean, weight, compression: float):
    """Neighbouring centroids joined while their share of the scale k(q) = d asin(2 q - 1) / (2 pi) is below one step."""
    import numpy as np

    order = np.argsort(mean, kind="stable")
    mean, weight = mean[order], weight[order]
    total = weight.sum()
    right = np.cumsum(weight) / total
    scale = lambda q: compression * np.arcsin(np.clip(2 * q - 1, -1, 1)) / (2 * np.pi)
    at = scale(right)
    start, left = [0], scale(0.0)
    for i in np.searchsorted(at, np.arange(np.floor(left), np.ceil(at[-1]) + 1), "right").tolist():
        # A group begins at the first centroid that would take it past a step.
        if start[-1] < i < len(mean):
            start.append(i)
    sums = np.add.reduceat(weight, start)
    return np.add.reduceat(mean * weight, start) / sums, sums


def _digests(compression: float, raw: bool, keys: int):
    def run(t):
        import numpy as np
        import pyarrow as pa

        values = t.column(keys).to_numpy(zero_copy_only=False).astype(float)
        weights = np.ones(len(values)) if raw else t.column(keys + 1).to_numpy(zero_copy_only=False).astype(float)
        low, high = (values.min(), values.max()) if raw else (t.column(keys + 2).to_numpy().min(), t.column(keys + 3).to_numpy().max())
        mean, weight = _merge_centroids(values, weights, compression)
        same = [pa.array([t.column(i)[0].as_py()] * len(mean), t.schema.field(i).type) for i in range(keys)]
        return pa.Table.from_arrays([*same, pa.array(mean), pa.array(weight), pa.array([low] * len(mean)), pa.array([high] * len(mean))], names=[*t.column_names[:keys], "mean", "weight", "low", "high"])

    return run


def tdigest(df: DataFrame, value: str, compression: float = 100.0, by: Sequence[str] = (), parts: int = 64) -> DataFrame:
    """(by..., mean, weight, low, high): the centroids of a t-digest of each group, with its least and greatest value.

    Rows are dealt by hash into ``parts`` digests of a group, which are then merged: no task holds a group.
    A compression of 0 or less counts as 100.
    """
    c = compression if compression > 0 else 100.0
    src = df.where(finite(value)).select(*by, col(value).cast("double").alias("__v"))
    kinds = "".join(f"`{k}` {t}, " for k, t in src.dtypes if k in by)
    dealt = src.select(*by, F.pmod(F.monotonically_increasing_id(), F.lit(parts)).alias("__p"), "__v")
    some = dealt.groupBy(*by, "__p").applyInArrow(_digests(c, True, len(by) + 1), f"{kinds}__p long, mean double, weight double, low double, high double")
    return tdigest_merge(some.drop("__p"), c, by)


def tdigest_merge(digests: DataFrame, compression: float = 100.0, by: Sequence[str] = ()) -> DataFrame:
    """One digest of each group from the centroids of several."""
    rows = digests.select(*by, "mean", "weight", "low", "high")
    kinds = "".join(f"`{k}` {t}, " for k, t in rows.dtypes if k in by)
    return rows.groupBy(*by).applyInArrow(_digests(compression, False, len(by)), f"{kinds}mean double, weight double, low double, high double")


def tdigest_quantiles(digest: DataFrame, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., q, value): between the middles of neighbouring centroids, and between the ends and the outer middles; exact at 0 and 1."""
    whole = Window.partitionBy(*by)
    run = digest.withColumn("__c", F.sum("weight").over(whole.orderBy("mean").rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight") / 2)
    run = run.withColumns({"__n": F.sum("weight").over(whole), "__pc": F.lag("__c").over(whole.orderBy("mean")), "__pm": F.lag("mean").over(whole.orderBy("mean"))})
    run = run.select("*", F.explode(F.array(*(F.lit(float(q)) for q in at))).alias("q")).withColumn("__t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("q"))) * F.col("__n"))
    before, mean = F.coalesce("__pc", F.lit(0.0)), F.coalesce("__pm", "low")
    inside = mean + (F.col("mean") - mean) * F.coalesce(F.try_divide(F.col("__t") - before, F.col("__c") - before), F.lit(0.0))
    hit = run.where(F.col("__c") >= F.col("__t")).groupBy(*by, "q").agg(F.min_by(inside, "__c").alias("__v"))
    top = run.groupBy(*by, "q").agg(F.max_by("mean", "__c").alias("__m"), F.max("__c").alias("__c"), F.first("__n").alias("__n"), F.first("__t").alias("__t"), F.first("low").alias("low"), F.first("high").alias("high"))
    both = attach(top, hit, [*by, "q"], "left")
    tail = F.col("__m") + (F.col("high") - F.col("__m")) * F.coalesce(F.try_divide(F.col("__t") - F.col("__c"), F.col("__n") - F.col("__c")), F.lit(0.0))
    return both.select(*by, "q", F.when(F.col("q") <= 0, F.col("low")).when(F.col("q") >= 1, F.col("high")).otherwise(F.coalesce("__v", tail)).alias("value"))


def ddsketch(df: DataFrame, value: str, alpha: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    """(sign, key, count, lo, hi): logarithmic buckets of the finite values.

    Negative values have sign -1 and zeros sign 0 with key 0.  Rows of several sketches merge
    by summing counts.  An alpha outside (0, 1) counts as 0.01.
    """
    alpha = alpha if 0 < alpha < 1 else 0.01
    step = math.log((1 + alpha) / (1 - alpha))
    v = col(value)
    key = F.when(v == 0, F.lit(0)).otherwise(F.ceil(F.ln(F.abs(v)) / step)).cast("int")
    good = df.where(finite(value))
    return good.groupBy(*by, F.signum(v).cast("int").alias("sign"), key.alias("key")).agg(F.count("*").alias("count"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def ddsketch_quantiles(sketch: DataFrame, at: Sequence[float], alpha: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    """(q, value): the bucket whose running count reaches ceil(q n), from the lowest value up; exact at 0 and 1.

    The buckets of a group are few: a few thousand span all doubles, whatever the data.
    """
    alpha = alpha if 0 < alpha < 1 else 0.01
    gamma = (1 + alpha) / (1 - alpha)
    order = Window.partitionBy(*by).orderBy("sign", F.col("sign") * F.col("key"))
    whole = Window.partitionBy(*by)
    run = sketch.withColumns({"cum": F.sum("count").over(order), "n": F.sum("count").over(whole), "least": F.min("lo").over(whole), "most": F.max("hi").over(whole)})
    middle = F.col("sign") * F.pow(F.lit(gamma), F.col("key")) * 2.0 / (1.0 + gamma)
    run = run.withColumn("v", F.when(F.col("sign") == 0, 0.0).otherwise(middle))
    run = run.select("*", F.explode(F.array(*(F.lit(float(q)) for q in at))).alias("q"))
    hit = run.where(F.col("cum") >= F.ceil(F.col("q") * F.col("n")))
    one = hit.groupBy(*by, "q").agg(F.min_by("v", "cum").alias("v"), F.first("least").alias("least"), F.first("most").alias("most"))
    return one.select(*by, "q", F.when(F.col("q") <= 0, F.col("least")).when(F.col("q") >= 1, F.col("most")).otherwise(F.col("v")).alias("value"))


def reservoir(df: DataFrame, value: str, order: str, k: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """A uniform sample of k rows with finite values: those with the least hashes of their position and a seed."""
    h = F.md5(F.encode(F.concat_ws(":", F.col(order).cast("string"), F.lit(str(seed))), "UTF-8"))
    good = df.where(finite(value)).withColumn("__h", h)
    if not by:
        return good.orderBy("__h", order).limit(max(1, k)).drop("__h")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("__h", order))
    return good.withColumn("__r", rank).where(F.col("__r") <= max(1, k)).drop("__r", "__h")


