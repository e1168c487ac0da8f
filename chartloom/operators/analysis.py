"""Heuristic analysis: summaries, automatic configuration, shape vectors, text queries.

Figures come from one or two aggregates; what remains, words and choices over a handful of
numbers, is Python on the driver, or Column expressions where each group has its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import col, cosine, finite, half_up
from . import downsample, series
from .stats import attach, clusters, correlation, hotspots, medians, moments, outliers_2d, regression, spikes


def summarize(df: DataFrame, x: str, y: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """trend, slope, range, distribution, spikes and anomalies of a series, with a sentence.

    The trend is volatile where deviation over mean is above 1, else by the slope over the span in
    deviations, beyond a half either way.  x counts as seconds.
    """
    good = df.where(finite(x, y)).select(*by, *order, col(x).alias("__x"), col(y).alias("__y"))
    point = F.struct(*order)
    one = good.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("__y").alias("min"), F.max("__y").alias("max"), F.avg("__y").alias("mean"), F.stddev_pop("__y").alias("stddev"),
        F.coalesce(F.nanvl(F.skewness("__y"), F.lit(0.0)), F.lit(0.0)).alias("skewness"), F.coalesce(F.regr_slope("__y", "__x"), F.lit(0.0)).alias("slope"), (F.max_by("__x", point) - F.min_by("__x", point)).alias("span"),
    )
    one = attach(one, medians(good, "__y", by), by)
    spike = attach(good, one.select(*by, "mean", "stddev"), by).groupBy(*by).agg(F.count_if(F.abs(F.col("__y") - F.col("mean")) > 2 * F.col("stddev")).alias("spikes"))
    odd = series.anomalies(good, "__y", order, by).groupBy(*by).agg(F.count("*").alias("anomalies"))
    out = attach(one, spike, by)
    out = attach(out, odd, by, "left")
    out = out.withColumn("anomalies", F.coalesce("anomalies", F.lit(0).cast("long"))).where("n > 0")
    cv = F.when(F.col("mean") == 0, 0.0).otherwise(F.try_divide(F.col("stddev"), F.abs("mean")))
    steep = F.when(F.col("stddev") == 0, 0.0).otherwise(F.try_divide(F.col("slope") * F.col("span"), F.col("stddev")))
    out = out.withColumn("trend", F.when(cv > 1, "volatile").when(steep > 0.5, "increasing").when(steep < -0.5, "decreasing").otherwise("stable"))
    hours = F.col("span") / 3600
    span = F.when(F.col("span") <= 0, "").when(hours >= 24, F.format_string(" spanning %.1f days", hours / 24)).when(hours >= 1, F.format_string(" spanning %.1f hours", hours)).otherwise(F.format_string(" spanning %.1f minutes", F.col("span") / 60))
    text = F.concat(
        F.format_string("Dataset: %d points", "n"), span, F.format_string(". Trend: %s (slope %.4f). Range: [%.2f, %.2f], mean %.2f, stddev %.2f. ", "trend", "slope", "min", "max", "mean", "stddev"),
        F.format_string("%d spikes, %d anomalies detected.", "spikes", "anomalies"),
    )
    return out.select(*by, "n", "trend", half_up(F.col("slope"), 4).alias("slope"), "min", "max", (F.col("max") - F.col("min")).alias("range"), *(half_up(F.col(c), 4).alias(c) for c in ("mean", "median", "stddev", "skewness")), "spikes", "anomalies", "span", text.alias("summary"))


def summarize_for_prompt(df: DataFrame, x: str, y: str, order: Sequence[str], screen: int = 1920) -> str:
    """A paragraph on one series for a language model; above 5000 points with a recommendation."""
    s = summarize(df, x, y, order).first()
    if s is None:
        return "Empty dataset."
    hours = s["span"] / 3600
    span = "" if not s["span"] > 0 else f" spanning {hours / 24:.1f} days" if hours >= 24 else f" spanning {hours:.1f} hours" if hours >= 1 else f" spanning {s['span'] / 60:.1f} minutes"
    more = ""
    if s["n"] > 5000:
        c = auto_optimize(df, x, y, order, screen=screen).first()
        more = f" Recommended: {c['algorithm'].upper()} downsampling to {c['target']} points ({c['speedup']:g}x reduction)."
    return (
        f"This dataset contains {s['n']:,} time-series points{span}. {s['trend'].capitalize()} trend (slope {s['slope']:g}/unit). Mean: {s['mean']:g}, "
        f"range: [{s['min']:.2f}, {s['max']:.2f}]. {s['spikes']} spike events exceeding 2 stddev. {s['anomalies']} anomalies detected.{more}"
    )


def auto_optimize(df: DataFrame, x: str, y: str, order: Sequence[str], by: Sequence[str] = (), screen: int = 1920, stream_above: int | None = 500_000) -> DataFrame:
    """algorithm, target, bins, index, streaming window and speed-up for a series of each key.

    Not ascending over its first 1000 rows: M4, a quadtree and a grid; largest step more than ten
    mean steps: MinMax + LTTB; else LTTB.  Above ``stream_above`` points streaming is advised; never with None.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.select(*by, F.row_number().over(w).alias("i"), (col(x) < F.lag(col(x)).over(w)).alias("down"), F.abs(col(y) - F.lag(col(y)).over(w)).alias("d"))
    top, mean = F.coalesce(F.max("d"), F.lit(0.0)), F.coalesce(F.avg("d"), F.lit(0.0))
    one = rows.groupBy(*by).agg(F.count("*").alias("n"), (~F.coalesce(F.bool_or(F.col("down") & (F.col("i") <= 1000)), F.lit(False))).alias("monotonic"), F.when(mean == 0, 1.0).otherwise(F.try_divide(top, mean)).alias("spike_ratio"))
    up = F.col("monotonic")
    target = F.least("n", F.lit(2 * screen)).cast("long")
    return one.select(
        *by, "n", F.when(~up, "m4").when(F.col("spike_ratio") > 10, "minmax_lttb").otherwise("lttb").alias("algorithm"), target.alias("target"),
        F.when(~up, F.least(F.lit(256), F.ceil(F.sqrt("n")))).cast("long").alias("bins"), F.when(~up, "quadtree").otherwise("none").alias("spatial_index"),
        F.when(F.lit(False) if stream_above is None else F.col("n") > stream_above, F.least(F.lit(100_000), F.col("n"))).cast("long").alias("window"),
        F.when(F.col("n") > target, half_up(F.try_divide(F.col("n").cast("double"), target), 1)).otherwise(1.0).alias("speedup"), "spike_ratio",
    )


def auto_configure(df: DataFrame, x: str, y: str, order: Sequence[str], screen: int = 1920) -> dict:
    """The other rule set: spikes as a share of points beyond 2 deviations, streaming for even spacing."""
    n = df.count()
    up = series.monotonic(df, x, order).first()["monotonic"] if n else True
    s = spikes(df, y, sample=True).first()
    spiky = bool(s["count"]) and s["spikes"] / s["count"] > 0.05
    even = bool(n) and series.even_spacing(df, x, order).first()["even"]
    bins = min(500, max(50, math.ceil(math.sqrt(n)))) if not up and n > 50_000 else None
    return {"algorithm": "m4" if not up else "minmax_lttb" if spiky else "lttb", "target": screen, "bins": bins, "spatial_index": "quadtree" if n > 100_000 else "none", "streaming": bool(even), "n": n}


def summarize_series(df: DataFrame, x: str, y: str, order: Sequence[str]) -> dict:
    """Moments, fit, periodicity and words for one series by the sample-deviation rules."""
    m = moments(df, y, mode="mixed").first()
    n = m["count"]
    if not n:
        return {"n": 0, "trend": "stable", "text": "Empty dataset."}
    fit, s = regression(df, x, y).first(), spikes(df, y, sample=True).first()
    period = series.periodicity(df, y, order).first()["period"]
    share = s["spikes"] / n
    trend = "volatile" if share > 0.1 else ("increasing" if fit["slope"] > 0 else "decreasing") if fit["r2"] > 0.3 else "stable"
    ratio = m["std_dev"] / abs(m["mean"]) if m["mean"] else 0.0
    word = "high" if ratio > 0.5 else "moderate" if ratio > 0.2 else "low"
    return {"n": n, "trend": trend, "slope": fit["slope"], "r2": fit["r2"], "skewness": m["skewness"], "kurtosis": m["kurtosis"], "period": period, "volatility": word, "spikes": s["spikes"], "text": f"{n} points, {trend} trend, {word} volatility, {s['spikes']} spikes" + (f", period {period}" if period else "") + "."}


def summarize_scatter(df: DataFrame, x: str, y: str) -> dict:
    """Correlation, outliers, fullest cells and a cluster count of a point cloud."""
    out = outliers_2d(df, x, y).first()
    if not out["count"]:
        return {"n": 0, "text": "Empty dataset."}
    r = correlation(df, x, y).first()["correlation"]
    groups = clusters(df, x, y)
    spots = [h.asDict() for h in hotspots(df, x, y).collect()]
    word = "strong" if abs(r) > 0.7 else "moderate" if abs(r) > 0.3 else "weak"
    return {"n": out["count"], "correlation": r, "outliers": out["outliers"], "clusters": groups, "hotspots": spots, "text": f"{out['count']} points, {word} correlation ({r:.2f}), {groups} clusters, {out['outliers']} outliers."}


LAGS = (1, 2, 4, 8)


def shape_vector(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), dimensions: int = 16) -> DataFrame:
    """(by..., shape): the form of each series as an array.

    0-7 shares of eight bins over its range; 8 the slope by position of the value over its range,
    within [-1, 1]; 9 the mean absolute step over the range; 10 the share beyond two deviations;
    11-14 autocorrelations at lags 1, 2, 4 and 8; 15 the mean's place in the range.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    good = df.where(finite(value)).select(*by, *order, col(value).alias("__v"))
    one = good.groupBy(*by).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.avg("__v").alias("m"), F.stddev_pop("__v").alias("s"))
    rows = attach(good, one.withColumn("r", F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)), by)
    rows = rows.withColumns({"i": (F.row_number().over(w) - 1).cast("double"), "u": (F.col("__v") - F.col("lo")) / F.col("r"), "d": F.col("__v") - F.col("m")})
    rows = rows.withColumns({"step": F.abs(F.col("u") - F.lag("u").over(w)), **{f"l{k}": F.lead("d", k).over(w) for k in LAGS}})
    n, total = F.count("*"), F.sum(F.col("d") * F.col("d"))
    share = [F.count_if(F.least(F.floor(F.col("u") * 8), F.lit(7)) == b) / n for b in range(8)]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    slope = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), zero(F.regr_slope("u", "i"))))
    lags = [zero(F.when(total > 0, F.try_divide(F.sum(F.col("d") * F.col(f"l{k}")), total))) for k in LAGS]
    parts = [*share, slope, zero(F.avg("step")), F.count_if(F.abs("d") > 2 * F.col("s")) / n, *lags, zero(F.avg("u"))]
    pad = [F.lit(0.0)] * max(0, dimensions - len(parts))
    return rows.groupBy(*by).agg(F.array(*(p.cast("double") for p in (parts + pad)[:dimensions])).alias("shape"))


def feature_vector(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), dimensions: int = 16) -> DataFrame:
    """(by..., features): the form of each series with the shares of its steps.

    A quarter of the dimensions are shares of bins of the value over its range, three eighths shares of bins of the
    step to the next value over the steps' range; then the trend and the volatility (both through tanh), the share
    beyond two deviations, the smoothness by second differences, and absolute autocorrelations at lags of
    equal parts of a quarter of the length.  A task holds the rows of a series in order.
    """
    bins, steps = dimensions // 4, dimensions * 3 // 8
    lags = max(0, dimensions - bins - steps - 4)
    w, tiny = Window.partitionBy(*by).orderBy(*order), 2.220446049250313e-16
    good = df.where(finite(value)).select(*by, *order, col(value).cast("double").alias("__v"))
    one = good.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), (F.max("__v") - F.min("__v")).alias("__r"), F.avg("__v").alias("__m"), F.coalesce(F.stddev_samp("__v"), F.lit(0.0)).alias("__s"))
    rows = attach(good, one, by).withColumns({"__i": F.row_number().over(w) - 1, "__u": F.when(F.col("__r") > tiny, (F.col("__v") - F.col("__lo")) / F.col("__r")).otherwise(0.5)})
    rows = rows.withColumns({"__d": F.when(F.col("__n") == 1, 0.0).otherwise(F.col("__u") - F.lag("__u").over(w)), "__c": F.abs(F.lead("__u").over(w) - 2 * F.col("__u") + F.lag("__u").over(w))})
    box = rows.groupBy(*by).agg(F.min("__d").alias("__dlo"), (F.max("__d") - F.min("__d")).alias("__dr"))
    held = attach(rows, box, by).withColumn("__du", F.when(F.col("__dr") > tiny, (F.col("__d") - F.col("__dlo")) / F.col("__dr")).when(F.col("__d").isNotNull(), 0.5))
    n, first = F.count("*"), lambda c: F.any_value(c)
    share = [F.count_if(F.least(F.floor(F.col("__u") * bins), F.lit(bins - 1)) == b) / n for b in range(bins)]
    share += [F.count_if(F.col("__du").isNotNull() & (F.least(F.floor(F.col("__du") * steps), F.lit(steps - 1)) == b)) / F.count("__du") for b in range(steps)]
    s, m = first("__s"), first("__m")
    trend = F.when((n > 1) & (s > tiny), F.tanh(F.try_divide(F.regr_slope("__v", "__i"), s))).otherwise(0.0)
    volatile = F.when(F.abs(m) > tiny, F.tanh(F.try_divide(s, F.abs(m)))).when(s > tiny, 1.0).otherwise(0.0)
    spikes = F.when(s > tiny, F.count_if(F.abs(F.col("__v") - F.col("__m")) > 2 * F.col("__s")) / n).otherwise(0.0)
    smooth = F.when(n > 2, 1 / (1 + F.avg("__c") * 100)).otherwise(0.5)
    parts = [*share, (trend + 1) / 2, volatile, spikes, smooth]
    out = held.groupBy(*by).agg(F.array(*(p.cast("double") for p in parts)).alias("__head"))
    if lags:
        # Each lag is one step of an equi-join of the series with itself.
        dev = rows.select(*by, "__i", "__n", (F.col("__v") - F.col("__m")).alias("__e"))
        far = dev.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(lags))))
        far = far.withColumn("__j", F.col("__i") + F.greatest(F.least(F.ceil(F.col("__k") / lags * F.floor(F.col("__n") / 4)), F.col("__n") - 1), F.lit(1)))
        pairs = attach(far, dev.select(*by, F.col("__i").cast("long").alias("__j"), F.col("__e").alias("__f")), [*by, "__j"], "left")
        total = dev.groupBy(*by).agg(F.sum(F.col("__e") * F.col("__e")).alias("__t"))
        each = pairs.groupBy(*by, "__k").agg(F.coalesce(F.sum(F.col("__e") * F.col("__f")), F.lit(0.0)).alias("__x"))
        each = attach(each, total, by).withColumn("__x", F.when(F.col("__t") > tiny, F.abs(F.try_divide("__x", "__t"))).otherwise(0.0))
        tail = each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__x"))), lambda e: e["__x"]).alias("__tail"))
        out = attach(out, tail, by, "left")
    else:
        out = out.withColumn("__tail", F.array().cast("array<double>"))
    both = F.concat("__head", F.coalesce("__tail", F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), max(0, dimensions)))
    return out.select(*by, F.slice(both, 1, dimensions).alias("features")) if dimensions > 0 else out.select(*by, F.array().cast("array<double>").alias("features"))


def shape_similarity(shapes: DataFrame, key: str) -> DataFrame:
    """(a, b, similarity) of each two keys, a before b, to four places."""
    left = shapes.select(F.col(key).alias("a"), F.col("shape").alias("__p"))
    right = shapes.select(F.col(key).alias("b"), F.col("shape").alias("__q"))
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", half_up(cosine(F.col("__p"), F.col("__q")), 4).alias("similarity"))


_RULES: list[tuple[str, str]] = [
    (r"(?:above|greater than|over|exceeding)\s+(\d+(?:\.\d+)?)", "above"),
    (r"(?:below|less than|under)\s+(\d+(?:\.\d+)?)", "below"),
    (r"last\s+hour", "hour"),
    (r"last\s+(\d+)\s+min", "minutes"),
    (r"anomal|outlier|unusual|abnormal", "anomaly"),
    (r"downsample.*?(\d+)", "downsample"),
    (r"trend|direction|slope|going up|going down", "trend"),
]
"""Fixed values: the phrases understood, tried in this order; anything else is a summary."""


def parse_query(text: str) -> dict:
    """{operation, params, description} of a phrase."""
    for pattern, kind in _RULES:
        if m := re.search(pattern, text.lower().strip()):
            said = m[1] if m.groups() else None
            made = {
                "above": lambda: ("filter", {"min": float(said)}, f"Filter values above {said}"),
                "below": lambda: ("filter", {"max": float(said)}, f"Filter values below {said}"),
                "hour": lambda: ("filter", {"timeRange": "last_hour"}, "Filter to last hour"),
                "minutes": lambda: ("filter", {"timeRange": f"last_{said}m"}, f"Filter to last {said} minutes"),
                "anomaly": lambda: ("anomaly", {"sensitivity": 3}, "Detect statistical anomalies"),
                "downsample": lambda: ("downsample", {"target": int(said)}, f"LTTB downsample to {said}"),
                "trend": lambda: ("summarize", {"focus": "trend"}, "Analyze data trend"),
            }[kind]()
            return dict(zip(("operation", "params", "description"), made))
    return {"operation": "summarize", "params": {}, "description": "Generate data summary"}


def run_query(text: str, df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """Does what a phrase asks for: strict comparisons, and time ranges back from the last x, in seconds."""
    asked = parse_query(text)
    p = asked["params"]
    if asked["operation"] == "filter":
        if "min" in p:
            return df.where(finite(y) & (F.col(y) > p["min"]))
        if "max" in p:
            return df.where(finite(y) & (F.col(y) < p["max"]))
        seconds = 3600 if p["timeRange"] == "last_hour" else 60 * int(p["timeRange"][5:-1])
        last = df.where(finite(x)).agg(F.max(col(x)).alias("__last"))
        return df.join(F.broadcast(last)).where(finite(x) & (col(x) >= F.col("__last") - seconds)).drop("__last")
    if asked["operation"] == "anomaly":
        return series.anomalies(df, y, [x, tie], sensitivity=p["sensitivity"])
    if asked["operation"] == "downsample":
        return downsample.lttb(df, x, y, p["target"], tie)
    return summarize(df, x, y, [x, tie])


def auto_downsample(df: DataFrame, x: str, y: str, target: int, tie: str, hint: str = "time_series", by: Sequence[str] = ()) -> DataFrame:
    """LTTB for time series, MinMax + LTTB for financial and sensor data, M4 for scatter."""
    if hint not in ("time_series", "financial", "sensor", "scatter"):
        raise ValueError(f"unknown hint {hint!r}")
    f = {"scatter": downsample.m4, "time_series": downsample.lttb}.get(hint, downsample.min_max_lttb)
    return f(df, x, y, target, tie, by)


