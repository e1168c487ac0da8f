"""Operators on ordered series: rolling statistics, differences, anomalies, change points, periodicity.

``order`` names the ordering columns; equals must not remain, so that positions are defined.
Each key of ``by`` is a series.  The folds that carry state run once for each series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scalar import col, finite, half_up
from .stats import attach, medians
from .transform import global_running


def _over(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def rolling(df: DataFrame, value: str, order: Sequence[str], size: int, by: Sequence[str] = ()) -> DataFrame:
    """length, mean, min, max, std_dev and variance of the last ``size`` finite values at every row."""
    w = _over(by, order).rowsBetween(-(max(1, size) - 1), 0)
    good = df.where(finite(value)).withColumn("__v", col(value))
    one = F.count("__v").over(w) < 2
    return good.withColumns(
        {
            "length": F.count("__v").over(w), "mean": F.avg("__v").over(w), "min": F.min("__v").over(w), "max": F.max("__v").over(w),
            "std_dev": F.when(one, 0.0).otherwise(F.stddev_samp("__v").over(w)), "variance": F.when(one, 0.0).otherwise(F.var_samp("__v").over(w)),
        }
    ).drop("__v")


def monotonic(df: DataFrame, x: str, order: Sequence[str], by: Sequence[str] = (), first: int | None = None) -> DataFrame:
    """(monotonic): no value is below the one before; with ``first``, of so many rows only."""
    w = _over(by, order)
    rows = df.select(*by, (col(x) < F.lag(col(x)).over(w)).alias("down"), F.row_number().over(w).alias("n"))
    down = F.col("down") & (F.lit(True) if first is None else F.col("n") <= first)
    return rows.groupBy(*by).agg((~F.coalesce(F.bool_or(down), F.lit(False))).alias("monotonic"))


def even_spacing(df: DataFrame, x: str, order: Sequence[str], by: Sequence[str] = (), share: float = 0.1, least: int = 1000) -> DataFrame:
    """(count, even): steps deviate by less than a share of their mean, in series of more than ``least`` rows."""
    rows = df.select(*by, (col(x) - F.lag(col(x)).over(_over(by, order))).alias("d"))
    even = (F.coalesce(F.stddev_samp("d"), F.lit(0.0)) < share * F.avg("d")) & (F.count("*") > least)
    return rows.groupBy(*by).agg(F.count("*").alias("count"), F.coalesce(even, F.lit(False)).alias("even"))


def spike_ratio(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(max_diff, mean_diff, ratio) of the absolute steps; a series without steps has ratio 1."""
    rows = df.select(*by, F.abs(col(value) - F.lag(col(value)).over(_over(by, order))).alias("d"))
    top, mean = F.coalesce(F.max("d"), F.lit(0.0)), F.coalesce(F.avg("d"), F.lit(0.0))
    return rows.groupBy(*by).agg(top.alias("max_diff"), mean.alias("mean_diff"), F.when(mean == 0, 1.0).otherwise(F.try_divide(top, mean)).alias("ratio"))


def second_difference(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(roughness): mean absolute second difference; 0 for fewer than three rows."""
    w = _over(by, order)
    d = F.lead(col(value)).over(w) - 2 * col(value) + F.lag(col(value)).over(w)
    return df.select(*by, F.abs(d).alias("d")).groupBy(*by).agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("roughness"))


def autocorrelation(df: DataFrame, value: str, order: Sequence[str], lags: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(lag, correlation); 0 where the series is constant or not longer than the lag."""
    w = _over(by, order)
    good = df.where(finite(value)).withColumn("__v", col(value))
    mean = good.groupBy(*by).agg(F.avg("__v").alias("__m"))
    dev = attach(good, mean, by).withColumn("__d", F.col("__v") - F.col("__m"))
    rows = dev.select(*by, "__d", *(F.lead("__d", k).over(w).alias(f"__{k}") for k in lags))
    total = F.sum(F.col("__d") * F.col("__d"))
    cells = [F.coalesce(F.when(total > 0, F.try_divide(F.sum(F.col("__d") * F.col(f"__{k}")), total)), F.lit(0.0)) for k in lags]
    one = rows.groupBy(*by).agg(F.array(*(F.struct(F.lit(k).alias("lag"), c.alias("correlation")) for k, c in zip(lags, cells))).alias("e"))
    return one.select(*by, F.explode("e").alias("e")).select(*by, "e.lag", "e.correlation")


def _first_peak(v, most: int | None) -> int:
    """The period of one series in order; all lags at once by Fourier transforms, and those that decide again by plain sums."""
    import numpy as np

    n = len(v)
    d = v - v.mean() if n else v
    total = float(d @ d)
    last = min(n // 2 - 1, n if most is None else most)
    if n < 10 or total < 2.220446049250313e-16:
        return 0
    size = 1 << (n + last).bit_length()
    f = np.fft.rfft(d, size)
    c = np.fft.irfft(f.real**2 + f.imag**2, size)[: last + 1] / total
    c[0] = 1.0
    exact = lambda k: float(d[: n - k] @ d[k:]) / total if k else 1.0
    # Without a fall yet, the correlation is 1; after the first lag below that it has fallen.
    near = np.flatnonzero((c[1:] >= c[:-1] - 1e-12) & (c[1:] > 0.3 - 1e-12)) + 1
    for k in near.tolist():
        if k > 1 and exact(k) > 0.3 and exact(k) >= exact(k - 1):
            return k
    return 0


def periodicity(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """(period): the first lag at which the autocorrelation stops rising after a fall, above 0.3; 0 for none.

    All lags below half the length, rounded down, count, or those up to ``most``.  Series of fewer than
    ten values have none.  A task holds the values of one series.
    """
    import pandas as pd

    good = df.where(finite(value)).select(*by, F.row_number().over(_over(by, order)).alias("__i"), col(value).cast("double").alias("__v"))

    def peak(key, t):
        return pd.DataFrame([[*key, _first_peak(t.sort_values("__i")["__v"].to_numpy(), most)]], columns=[*by, "period"])

    found = good.groupBy(*by).applyInPandas(peak, StructType([*(good.schema[k] for k in by), StructField("period", IntegerType())]))
    if by:
        return found
    # A row where there are no values, too.
    return found.agg(F.coalesce(F.max("period"), F.lit(0)).cast("int").alias("period"))


def anomalies(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), sensitivity: float = 3.0, mode: str = "typed") -> DataFrame:
    """Rows whose modified z-score passes the sensitivity: position, value, z_score and type.

    ``typed``: fewer than five values have none; without spread about the median the mean distance
    from it stands in; a shift has more than w of the values w before to w - 1 after beyond half
    the sensitivity, w = max(5, n / 20); else a spike or a dip by sign.  ``strict_mad``: z is
    unsigned and without spread there is none.
    """
    w = _over(by, order)
    good = df.where(finite(value)).withColumn("__v", col(value))
    count = good.groupBy(*by).agg(F.count("*").alias("__n"))
    med = attach(count, medians(good, "__v", by, "__med"), by)
    dev = attach(good, med, by).withColumn("__a", F.abs(F.col("__v") - F.col("__med")))
    spread = attach(dev.groupBy(*by).agg(F.avg("__a").alias("__aad")), medians(dev, "__a", by, "__mad"), by)
    unit = F.when(F.col("__mad") == 0, F.col("__aad")).otherwise(F.col("__mad"))
    z = F.when(unit != 0, 0.6745 * (F.col("__v") - F.col("__med")) / unit)
    if mode == "strict_mad":
        z = F.when(F.col("__mad") > 2.220446049250313e-16, 0.6745 * F.col("__a") / F.col("__mad"))
    rows = attach(dev, spread, by).withColumn("__z", z)
    # The window's width grows with the series: prefix counts give it without a frame of that size.
    half = F.when(F.abs("__z") > sensitivity / 2, 1).otherwise(0)
    if by:
        rows = rows.withColumns({"position": F.row_number().over(w) - 1, "__c": F.sum(half).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    else:
        rows = global_running(rows, order, {"__c": half})
    rows = rows.withColumn("position", F.col("position").cast("int"))
    if mode == "strict_mad":
        return rows.where(F.col("__z") > sensitivity).select(*df.columns, "position", F.col("__z").alias("z_score"))
    rows = rows.withColumn("__w", F.greatest(F.lit(5), F.floor(F.col("__n") / 20)))
    hits = rows.where((F.abs("__z") > sensitivity) & (F.col("__n") >= 5))
    ends = rows.select(*by, F.col("position").cast("long").alias("__p"), F.col("__c").alias("__e"))
    keyed = hits.withColumns({"__hi": F.least(F.col("__n"), F.col("position") + F.col("__w")) - 1, "__lo": F.col("position") - F.col("__w") - 1})
    top = attach(keyed, ends.withColumnsRenamed({"__p": "__hi", "__e": "__top"}), [*by, "__hi"], "left")
    low = attach(top, ends.withColumnsRenamed({"__p": "__lo", "__e": "__bottom"}), [*by, "__lo"], "left")
    near = F.col("__top") - F.coalesce("__bottom", F.lit(0))
    kind = F.when((F.col("position") >= F.col("__w")) & (near > F.col("__w")), "shift").when(F.col("__z") > 0, "spike").otherwise("dip")
    return low.withColumns({"z_score": half_up(F.col("__z"), 3), "type": kind}).select(*df.columns, "position", "z_score", "type")


def change_points(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), min_segment: int = 10, mode: str = "range") -> DataFrame:
    """(position) of level changes by cumulative sums that start anew at each change.

    ``range``: the running sum of deviations leaves the band of 1.5 deviations about its extremes;
    series shorter than two segments have none.  ``two_sided``: either arm, with a drift of half a
    deviation, passes four.  Both fold a series in order, as each change resets the sums.
    """
    good = df.where(finite(value)).withColumn("__v", col(value))
    w = _over(by, order)
    one = good.groupBy(*by).agg(F.avg("__v").alias("__m"), F.stddev_pop("__v").alias("__s"), F.count("*").alias("__n"))
    rows = attach(good, one, by).withColumn("__i", F.row_number().over(w) - 1)
    folded = rows.groupBy(*by, "__m", "__s", "__n").agg(F.array_sort(F.collect_list(F.struct(F.col("__i").alias("i"), F.col("__v").alias("v")))).alias("__p"))
    empty = "cast(array() as array<int>)"
    if mode == "range":
        fold = f"""aggregate(__p, named_struct('c', 0.0D, 'lo', 0.0D, 'hi', 0.0D, 'last', 0, 'out', {empty}), (s, e) ->
            CASE WHEN (s.c + e.v - __m - s.lo > 1.5D * __s OR s.hi - (s.c + e.v - __m) > 1.5D * __s) AND e.i - s.last >= {int(min_segment)}
            THEN named_struct('c', 0.0D, 'lo', 0.0D, 'hi', 0.0D, 'last', e.i, 'out', array_append(s.out, e.i))
            ELSE named_struct('c', s.c + e.v - __m, 'lo', least(s.lo, s.c + e.v - __m), 'hi', greatest(s.hi, s.c + e.v - __m), 'last', s.last, 'out', s.out) END, s -> s.out)"""
        some = F.col("__n") >= 2 * min_segment
    else:
        p, n = "greatest(0.0D, s.p + e.v - __m - __s / 2)", "greatest(0.0D, s.n - (e.v - __m) - __s / 2)"
        fold = f"""aggregate(slice(__p, 2, greatest(size(__p) - 1, 0)), named_struct('p', 0.0D, 'n', 0.0D, 'last', 0, 'out', {empty}), (s, e) ->
            CASE WHEN ({p} > 4 * __s OR {n} > 4 * __s) AND e.i - s.last >= {int(min_segment)}
            THEN named_struct('p', 0.0D, 'n', 0.0D, 'last', e.i, 'out', array_append(s.out, e.i))
            ELSE named_struct('p', {p}, 'n', {n}, 'last', s.last, 'out', s.out) END, s -> s.out)"""
        some = F.col("__s") >= 2.220446049250313e-16
    return folded.where(some).select(*by, F.explode(F.expr(fold)).alias("position"))
