"""Exact aggregates.  Each takes optional grouping columns ``by``; without them it is one group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import NAN, col, finite


def _named(**columns: Column) -> list[Column]:
    return [c.alias(k) for k, c in columns.items()]


def stats(df: DataFrame, value: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """count, min, max, mean, std_dev and variance of the finite values.

    The variance is the sample's, 0 for one value.  Without values count is 0 and the rest NaN.
    """
    v = F.when(finite(value), col(value))
    some = lambda c: F.coalesce(c, F.lit(NAN))
    one = F.count(v) == 1
    return df.groupBy(*by).agg(
        *_named(
            count=F.count(v), min=some(F.min(v)), max=some(F.max(v)), mean=some(F.avg(v)),
            std_dev=some(F.when(one, 0.0).otherwise(F.stddev_samp(v))), variance=some(F.when(one, 0.0).otherwise(F.var_samp(v))),
        )
    )


def ranked(df: DataFrame, value: str | Column, ranks: Sequence[int], bins: int = 4096) -> dict[int, float]:
    """The finite values of given ranks, from 0, in order: exact, and in passes that count.

    A pass counts the rows in ``bins`` equal parts of each stretch that still holds a rank asked for, and leaves the part
    with it, narrowed to its own least and greatest value; it is done when these are one.  The driver gets
    one row a part, so that its share does not grow with the data; a pass makes stretches some thousand times shorter.
    """
    v = df.where(finite(value)).select(col(value).cast("double").alias("__v"))
    n, low, high = v.agg(F.count("*"), F.min("__v"), F.max("__v")).first()
    # Stretches by bounds: the number of rows below, and the ranks in them.
    todo = {(low, high): (0, sorted({k for k in ranks if 0 <= k < n}))} if n else {}
    found: dict[int, float] = {}
    while todo:
        for (lo, hi), (_, ks) in list(todo.items()):
            if lo == hi:
                found |= dict.fromkeys(ks, lo)
                del todo[lo, hi]
        if not todo:
            break
        spans = sorted(todo)
        part = F.lit(None).cast("int")
        for i, (lo, hi) in reversed(list(enumerate(spans))):
            # Halves first, as the width of the widest stretch is no finite number.
            at = F.floor((F.col("__v") / 2 - lo / 2) / (hi / 2 - lo / 2) * bins)
            part = F.when(F.col("__v").between(lo, hi), F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)) + i * bins).otherwise(part).cast("int")
        rows = v.select(part.alias("p"), "__v").where("p is not null").groupBy("p").agg(F.count("*").alias("n"), F.min("__v").alias("a"), F.max("__v").alias("b")).collect()
        todo = {k: x for k, x in todo.items() if k not in spans} | _narrowed(rows, spans, todo, bins)
    return found


def _narrowed(rows: list, spans: list[tuple[float, float]], todo: dict, bins: int) -> dict:
    out = {}
    for i, span in enumerate(spans):
        below, ks = todo[span]
        for r in sorted((r for r in rows if r["p"] // bins == i), key=lambda r: r["p"]):
            if mine := [k for k in ks if below <= k < below + r["n"]]:
                out[r["a"], r["b"]] = below, mine
            below += r["n"]
    return out


ONE_BUFFER = 200_000
"""Values (3 MB) up to which one aggregate holds them all; more are selected by counting.  Results are the same."""


def quantiles(df: DataFrame, value: str | Column, at: Sequence[float]) -> list[float]:
    """Exact quantiles of the finite values with linear interpolation; NaN without values."""
    good = df.where(finite(value))
    n = good.count()
    if n <= ONE_BUFFER:
        found = good.agg(F.percentile(col(value), F.array(*(F.lit(float(q)) for q in at)))).first()[0]
        return list(found) if found else [NAN] * len(at)
    place = [q * (n - 1) for q in at]
    have = ranked(df, value, [k for p in place for k in (math.floor(p), math.ceil(p))])
    return [have[math.floor(p)] if p == math.floor(p) else (math.ceil(p) - p) * have[math.floor(p)] + (p - math.floor(p)) * have[math.ceil(p)] for p in place]


def percentiles(df: DataFrame, value: str | Column, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(p, value): exact percentiles of the finite values with linear interpolation; NaN without values.

    Without ``by`` by counting (see ``ranked``); with it, one aggregate holds the values of a group.
    """
    held = [min(100.0, max(0.0, float(p))) for p in at]
    if not by:
        return df.sparkSession.createDataFrame([(float(p), v) for p, v in zip(at, quantiles(df, value, [p / 100 for p in held]))], "p double, value double")
    v = F.when(finite(value), col(value))
    one = df.groupBy(*by).agg(F.percentile(v, F.array(*(F.lit(p / 100) for p in held))).alias("__q"))
    pairs = F.array(*(F.struct(F.lit(float(p)).alias("p"), F.coalesce(F.col("__q")[i], F.lit(NAN)).alias("value")) for i, p in enumerate(at)))
    return one.select(*by, F.explode(pairs).alias("__e")).select(*by, "__e.*")


def medians(df: DataFrame, value: str | Column, by: Sequence[str] = (), out: str = "median") -> DataFrame:
    """The median of the finite values of each group; one row without ``by``, null without values."""
    if by:
        return df.where(finite(value)).groupBy(*by).agg(F.median(col(value)).alias(out))
    v = quantiles(df, value, [0.5])[0]
    return df.sparkSession.createDataFrame([(None if v != v else v,)], f"`{out}` double")


def finite_range(df: DataFrame, value: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """(min, max) of the finite values; NULL without any."""
    v = F.when(finite(value), col(value))
    return df.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"))


def padded_bounds(df: DataFrame, axes: Sequence[str], by: Sequence[str] = (), share: float = 0.001) -> DataFrame:
    """Range of each axis over the points that are finite in all, widened by a share of its own span."""
    good = df.where(finite(*axes))
    out = []
    for a in axes:
        pad = (F.max(col(a)) - F.min(col(a))) * share
        out += [(F.min(col(a)) - pad).alias(f"{a}_min"), (F.max(col(a)) + pad).alias(f"{a}_max")]
    return good.groupBy(*by).agg(*out)


def attach(df: DataFrame, small: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Puts the row of each group beside its rows; a null key is a group as any other.

    Without ``by`` there is one such row, which is broadcast.
    """
    if not by:
        return df.join(F.broadcast(small))
    names = {k: f"__by_{k}" for k in by}
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return df.join(small.withColumnsRenamed(names), on, how).drop(*names.values())


def mad(df: DataFrame, value: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """(median, mad): the median, and the median distance from it, of the finite values."""
    good = df.where(finite(value)).withColumn("__v", col(value))
    med = medians(good, "__v", by)
    if by:
        return attach(good, med, by).groupBy(*by).agg(F.first("median").alias("median"), F.median(F.abs(F.col("__v") - F.col("median"))).alias("mad"))
    middle = med.first()["median"]
    return med.withColumn("mad", F.lit(None if middle is None else quantiles(good, F.abs(F.col("__v") - F.lit(middle)), [0.5])[0]).cast("double"))


def moments(df: DataFrame, value: str | Column, by: Sequence[str] = (), mode: str = "population") -> DataFrame:
    """count, mean, std_dev, skewness and excess kurtosis.

    ``population`` divides by n throughout.  ``mixed`` takes the sample deviation and
    divides the powers by n; then skewness needs 3 values and kurtosis 4, else they are 0.
    """
    v = F.when(finite(value), col(value))
    n = F.count(v)
    if mode == "population":
        sd, skew, kurt = F.stddev_pop(v), F.skewness(v), F.kurtosis(v)
    else:
        part = (n - 1) / n
        sd = F.coalesce(F.stddev_samp(v), F.lit(0.0))
        skew = F.when(n >= 3, F.skewness(v) * F.pow(part, 1.5))
        kurt = F.when(n >= 4, (F.kurtosis(v) + 3) * part * part - 3)
    zero = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    return df.groupBy(*by).agg(n.alias("count"), F.avg(v).alias("mean"), sd.alias("std_dev"), zero(skew).alias("skewness"), zero(kurt).alias("kurtosis"))


def regression(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """slope, intercept and r2 of least squares; 0 where x does not vary."""
    good = df.where(finite(x, y))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return good.groupBy(*by).agg(
        F.count("*").alias("count"), zero(F.regr_slope(col(y), col(x))).alias("slope"), zero(F.regr_intercept(col(y), col(x))).alias("intercept"), zero(F.regr_r2(col(y), col(x))).alias("r2")
    )


def correlation(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation; 0 where an axis does not vary."""
    good = df.where(finite(x, y))
    return good.groupBy(*by).agg(F.coalesce(F.nanvl(F.corr(col(x), col(y)), F.lit(0.0)), F.lit(0.0)).alias("correlation"))


def spikes(df: DataFrame, value: str, by: Sequence[str] = (), factor: float = 2.0, sample: bool = False) -> DataFrame:
    """(count, spikes): values further from the mean than ``factor`` deviations."""
    good = df.where(finite(value)).withColumn("__v", col(value))
    sd = F.coalesce(F.stddev_samp("__v"), F.lit(0.0)) if sample else F.stddev_pop("__v")
    one = good.groupBy(*by).agg(F.avg("__v").alias("__m"), sd.alias("__s"))
    return attach(good, one, by).groupBy(*by).agg(F.count("*").alias("count"), F.count_if(F.abs(F.col("__v") - F.col("__m")) > factor * F.col("__s")).alias("spikes"))


def outliers_2d(df: DataFrame, x: str, y: str, by: Sequence[str] = (), factor: float = 2.0) -> DataFrame:
    """(count, outliers): points beyond ``factor`` sample deviations in both axes."""
    good = df.where(finite(x, y)).withColumns({"__x": col(x), "__y": col(y)})
    one = good.groupBy(*by).agg(*(f(c).alias(n) for c in ("__x", "__y") for f, n in ((F.avg, f"{c}m"), (F.stddev_samp, f"{c}s"))))
    far = [F.abs(F.col(c) - F.col(f"{c}m")) > factor * F.coalesce(f"{c}s", F.lit(0.0)) for c in ("__x", "__y")]
    return attach(good, one, by).groupBy(*by).agg(F.count("*").alias("count"), F.count_if(far[0] & far[1]).alias("outliers"))


def density_grid(df: DataFrame, x: str, y: str, by: Sequence[str] = (), size: int = 10) -> DataFrame:
    """(gx, gy, count, x_center, y_center) of the occupied cells of a grid whose lines round to the points.

    Where an axis does not vary all points are in one cell.
    """
    good = df.where(finite(x, y)).withColumns({"__x": col(x), "__y": col(y)})
    box = good.groupBy(*by).agg(*(f(c).alias(f"{c}{n}") for c in ("__x", "__y") for f, n in ((F.min, "lo"), (F.max, "hi"))))
    both = (F.col("__xhi") > F.col("__xlo")) & (F.col("__yhi") > F.col("__ylo"))
    cell = [F.when(both, F.round(F.try_divide(F.col(c) - F.col(f"{c}lo"), F.col(f"{c}hi") - F.col(f"{c}lo")) * (size - 1))).otherwise(0.0).cast("int") for c in ("__x", "__y")]
    out = attach(good, box, by).groupBy(*by, cell[0].alias("gx"), cell[1].alias("gy"))
    return out.agg(F.count("*").alias("count"), F.avg("__x").alias("x_center"), F.avg("__y").alias("y_center"))


def hotspots(df: DataFrame, x: str, y: str, by: Sequence[str] = (), k: int = 3) -> DataFrame:
    """The k fullest cells of the density grid; of equals the one of the least gx, then gy."""
    grid = density_grid(df, x, y, by)
    if not by:
        return grid.orderBy(F.desc("count"), "gx", "gy").limit(k)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "gx", "gy"))
    return grid.withColumn("__r", rank).where(F.col("__r") <= k).drop("__r")


def clusters(df: DataFrame, x: str, y: str, size: int = 10) -> int:
    """Eight-connected groups of cells that hold half the mean count at least.

    The grid has at most size * size cells, which are read to the driver.
    """
    cells = {(r["gx"], r["gy"]): r["count"] for r in density_grid(df, x, y, size=size).collect()}
    if not cells:
        return 0
    least = max(1, sum(cells.values()) // len(cells) // 2)
    open_, groups = {c for c, n in cells.items() if n >= least}, 0
    while open_:
        todo, groups = [open_.pop()], groups + 1
        while todo:
            a, b = todo.pop()
            near = {(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & open_
            open_ -= near
            todo.extend(near)
    return max(1, groups)
