"""Row-wise transforms that need a range, orderings, and quantile normalisation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources.scratch import written
from .stats import attach, finite_range


def normalize(df: DataFrame, value: str, bounds: tuple[float, float] | None = None, by: Sequence[str] = (), out: str = "normalized") -> DataFrame:
    """``df`` with the value in [0, 1] over its finite range, or over bounds that are finite and of some width."""
    if bounds and all(map(math.isfinite, bounds)) and bounds[1] > bounds[0]:
        return df.withColumn(out, S.normalize(value, F.lit(float(bounds[0])), F.lit(float(bounds[1]))))
    box = finite_range(df, value, by).select(*by, F.col("min").alias("__lo"), F.col("max").alias("__hi"))
    return attach(df, box, by).withColumn(out, S.normalize(value, F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def filter_range(df: DataFrame, x: str, low: float, high: float) -> DataFrame:
    """Rows with low <= x <= high.  The bare comparison reaches the Parquet scan; NaN is dropped beside it."""
    return df.where(F.col(x).between(low, high) & ~F.isnan(S.col(x)))


def sort_values(df: DataFrame, value: str, index: str, descending: bool = False) -> DataFrame:
    """Rows by value: NaN last ascending and first descending, equals by index."""
    key = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    return df.orderBy(key, index)


def sort_by_keys(df: DataFrame, keys: Sequence[str], index: str, descending: bool = False) -> DataFrame:
    """Rows by keys, stable: equals by index in both directions."""
    return df.orderBy(*((F.desc if descending else F.asc)(k) for k in keys), index)


def global_running(df: DataFrame, order: Sequence[str], sums: dict[str, Column], position: str = "position", ranges: int | None = None) -> DataFrame:
    """Numbers all rows from 0 in an order and adds running sums, without one task for all.

    Rows are dealt into ranges of all ordering columns, as many as shuffles have partitions or ``ranges``, so that
    a frequent value of the first is split by the others; they are sorted there and written once.  Numbers and sums are those
    within the range plus those of the ranges before, of which there is one row each.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select("*", *(c.alias(f"__s_{k}") for k, c in sums.items())).repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Fixed value: the number of the partition is above bit 33 and the row's number there below.
    held = written(dealt.withColumn("__id", F.monotonically_increasing_id()), "ranges")
    part, row = F.shiftrightunsigned("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    held = held.withColumn("__p", part)
    each = held.groupBy("__p").agg(F.count("*").alias("__n"), *(F.sum(f"__s_{k}").alias(f"__t_{k}") for k in sums))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    start = each.select(F.col("__p").alias("__q"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__b{c}") for c in ("__n", *(f"__t_{k}" for k in sums))))
    out = held.join(F.broadcast(start), F.col("__p") == F.col("__q"))
    inside = Window.partitionBy("__p").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0)
    made = [(F.col("__b__n") + row).alias(position), *((F.col(f"__b__t_{k}") + F.sum(f"__s_{k}").over(inside)).alias(k) for k in sums)]
    return out.select(*df.columns, *made)


def global_position(df: DataFrame, order: Sequence[str], out: str = "position", ranges: int | None = None) -> DataFrame:
    """Numbers all rows from 0 in an order, without one task for all (see ``global_running``)."""
    return global_running(df, order, {}, out, ranges)


def quantile_normalize(df: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """(row, columns...): the value of each rank becomes the mean of that rank over the columns.

    Columns are ranked each for itself, NaN last and equals by row; a rank with a NaN has the mean NaN.
    """
    parts = []
    for i, c in enumerate(columns):
        one = df.select(F.col(row), F.lit(i).alias("c"), F.coalesce(S.col(c), F.lit(S.NAN)).alias("v"))
        parts.append(global_position(one, ["v", row], "rank"))
    ranked = reduce(DataFrame.unionByName, parts)
    means = ranked.groupBy("rank").agg(F.avg("v").alias("m"))
    back = ranked.join(means, "rank").groupBy(row).agg(*(F.max(F.when(F.col("c") == i, F.col("m"))).alias(c) for i, c in enumerate(columns)))
    return back
