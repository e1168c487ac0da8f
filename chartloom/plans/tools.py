"""The tool façade: named operations over plain arrays, with checked arguments and JSON results.

Each tool makes a DataFrame of its arrays, runs the operator of the same name, and returns
plain values with ``elapsed_ms`` and ``engine``.  Large data should call the operators on
DataFrames instead; this façade is for agents and small requests.
"""

from __future__ import annotations

import json
import math
import statistics
import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, binning, downsample, series, spatial, stats, transform
from ..sources import files

TOOLS: dict[str, Callable[..., Any]] = {}


class ToolError(ValueError):
    """Arguments that a tool cannot take."""


def tool(f):
    TOOLS[f.__name__] = f
    return f


def frame(spark: SparkSession, **columns: Sequence[float]) -> DataFrame:
    """(idx, columns...) from arrays of one length."""
    sizes = {len(c) for c in columns.values()}
    if len(sizes) != 1:
        raise ToolError(f"arrays of one length are needed; these have {sorted(sizes)}")
    names = list(columns)
    rows = [(i, *(None if v is None else float(v) for v in r)) for i, r in enumerate(zip(*columns.values()))]
    return spark.createDataFrame(rows, "idx long, " + ", ".join(f"{n} double" for n in names))


def _xy(df: DataFrame) -> dict:
    rows = df.orderBy("i").collect()
    return {"x": [r["x"] for r in rows], "y": [r["y"] for r in rows], "count": len(rows)}


def _plain(v: Any) -> Any:
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def call(spark: SparkSession, which: str, registry: spatial.IndexRegistry | None = None, /, **args: Any) -> dict:
    """Runs a tool; unknown names and wrong arguments give ToolError."""
    if which not in TOOLS:
        raise ToolError(f"no tool {which!r}; there are {', '.join(sorted(TOOLS))}")
    began = time.perf_counter()
    try:
        out = TOOLS[which](spark, registry, **args) if which in INDEXED else TOOLS[which](spark, **args)
    except TypeError as e:
        raise ToolError(str(e)) from e
    return _plain({**out, "elapsed_ms": round((time.perf_counter() - began) * 1000, 3), "engine": f"spark {spark.version}"})


def call_json(spark: SparkSession, which: str, registry: spatial.IndexRegistry | None = None, /, **args: Any) -> str:
    return json.dumps(call(spark, which, registry, **args), indent=2, default=str)


@tool
def lttb(spark, x, y, threshold):
    return _xy(downsample.lttb(frame(spark, x=x, y=y), "x", "y", int(threshold), "idx", reduce=False))


@tool
def minmax_lttb(spark, x, y, threshold):
    return _xy(downsample.min_max_lttb(frame(spark, x=x, y=y), "x", "y", int(threshold), "idx"))


@tool
def auto_downsample(spark, x, y, threshold, hint="time_series"):
    return _xy(analysis.auto_downsample(frame(spark, x=x, y=y), "x", "y", int(threshold), "idx", hint)) | {"hint": hint}


@tool
def histogram(spark, data, bins=50, min=None, max=None):
    rows = binning.histogram(frame(spark, v=data), "v", int(bins), (min, max)).orderBy("bin").collect()
    return {"counts": [r["count"] for r in rows], "edges": [r["lo"] for r in rows] + [rows[-1]["hi"]]}


@tool
def bin2d(spark, x, y, x_bins=256, y_bins=256):
    df = frame(spark, x=x, y=y)
    grid = [[0] * int(x_bins) for _ in range(int(y_bins))]
    for r in binning.bin2d(df, "x", "y", int(x_bins), int(y_bins)).collect():
        grid[r["yi"]][r["xi"]] = r["count"]
    edges = binning.bin2d_edges(df, "x", "y", int(x_bins), int(y_bins)).first()
    return {"grid": grid, "x_edges": edges["x_edges"], "y_edges": edges["y_edges"], "max_count": edges["max_count"] or 0}


@tool
def bin3d(spark, x, y, z, bins=32):
    rows = binning.bin3d(frame(spark, x=x, y=y, z=z), "x", "y", "z", (int(bins),) * 3).orderBy("zi", "yi", "xi").collect()
    return {"voxels": [r.asDict() for r in rows], "max_count": max((r["count"] for r in rows), default=0)}


@tool
def build_index(spark, registry, name, x, y):
    return registry.build(name, frame(spark, x=x, y=y), ("x", "y"), "idx")


@tool
def query_range(spark, registry, name, low, high):
    return {"indices": sorted(r["idx"] for r in registry.query_range(name, low, high).collect())}


@tool
def build_index_3d(spark, registry, name, x, y, z):
    return registry.build(name, frame(spark, x=x, y=y, z=z), ("x", "y", "z"), "idx")


@tool
def query_range_3d(spark, registry, name, low, high):
    return query_range(spark, registry, name, low, high)


@tool
def query_nearest(spark, registry, name, probe, k=1):
    return {"indices": [r["idx"] for r in registry.query_nearest(name, probe, int(k)).collect()]}


INDEXED = {"build_index", "query_range", "build_index_3d", "query_range_3d", "query_nearest"}


@tool
def frustum_cull(spark, x, y, z, mvp):
    return {"indices": sorted(r["idx"] for r in spatial.frustum_cull(frame(spark, x=x, y=y, z=z), ("x", "y", "z"), mvp).collect())}


@tool
def compute_stats(spark, data, percentiles=(50,)):
    df = frame(spark, v=data)
    held = stats.percentiles(df, "v", percentiles).collect()
    return stats.stats(df, "v").first().asDict() | {"percentiles": {f"{r['p']:g}": r["value"] for r in held}}


@tool
def normalize(spark, data, min=None, max=None):
    bounds = None if min is None or max is None else (min, max)
    return {"data": [r["normalized"] for r in transform.normalize(frame(spark, v=data), "v", bounds).orderBy("idx").collect()]}


@tool
def sort(spark, data, descending=False):
    return {"data": [r["v"] for r in transform.sort_values(frame(spark, v=data), "v", "idx", descending).collect()]}


@tool
def capabilities(spark):
    return {"version": spark.version, "cores": spark.sparkContext.defaultParallelism, "master": spark.sparkContext.master, "adaptive": spark.conf.get("spark.sql.adaptive.enabled"), "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"), "tools": sorted(TOOLS)}


@tool
def benchmark(spark, size=100_000, runs=5):
    from ..sources.synthetic import random_walk

    df = random_walk(spark, int(size)).cache()
    df.count()
    out = {}
    for name, f in (("lttb", lambda: downsample.lttb(df, "x", "y", 1000, "idx")), ("bin2d", lambda: binning.bin2d(df, "x", "y"))):
        took = []
        for _ in range(int(runs)):
            began = time.perf_counter()
            f().write.format("noop").mode("overwrite").save()
            took.append((time.perf_counter() - began) * 1000)
        out[name] = round(statistics.median(took), 2)
    df.unpersist()
    return {"median_ms": out, "size": int(size)}


@tool
def load_file(spark, path, x_column=None, y_column=None, delimiter=",", allowed=()):
    rows, skipped = files.load_delimited(spark, files.guard(path, allowed), x_column, y_column, delimiter)
    found = rows.collect()
    return {"x": [r["x"] for r in found], "y": [r["y"] for r in found], **skipped.first().asDict()}


@tool
def inspect_file(spark, path, delimiter=",", allowed=()):
    return files.inspect_delimited(spark, files.guard(path, allowed), delimiter)


@tool
def summarize(spark, y):
    df = frame(spark, y=y).withColumn("x", F.col("idx").cast("double"))
    one = analysis.summarize(df, "x", "y", ["idx"]).first()
    return {"summary": one.asDict() if one else None, "text": analysis.summarize_for_prompt(df, "x", "y", ["idx"])}


@tool
def detect_anomalies(spark, data, sensitivity=3):
    rows = series.anomalies(frame(spark, v=data), "v", ["idx"], sensitivity=float(sensitivity)).orderBy("position").collect()
    return {"anomalies": [{"index": r["position"], "value": r["v"], "z_score": r["z_score"], "type": r["type"]} for r in rows]}


@tool
def ai_auto_optimize(spark, x, y, screen_width=1920):
    return analysis.auto_optimize(frame(spark, x=x, y=y), "x", "y", ["idx"], screen=int(screen_width)).first().asDict()


@tool
def parse_query(spark, query):
    return analysis.parse_query(query)


@tool
def shape_similarity(spark, a, b):
    both = frame(spark, v=a).withColumn("k", F.lit("a")).unionByName(frame(spark, v=b).withColumn("k", F.lit("b")))
    shapes = analysis.shape_vector(both, "v", ["idx"], ["k"])
    got = analysis.shape_similarity(shapes, "k").first()
    return {"similarity": got["similarity"] if got else 0.0, "shapes": {r["k"]: r["shape"] for r in shapes.collect()}}


PROMPTS = {
    "optimize_chart": """A chart {chart_width} pixels wide is to show {data_size} points. Find out how to draw it:
1. Ask `capabilities` what this session runs on.
2. Run `auto_downsample` with {chart_width} as the threshold, to see which algorithm suits the series.
3. For a point cloud rather than a series, run `bin2d` for a density map too.
4. Run `stats` for the range and the spread of the values.
5. Say which algorithm to use, how many times fewer points it leaves, and whether a density map shows more than points.""",
    "profile_data": """The data: {data_description}
Describe it and say how to show it:
1. Run `stats` with the percentiles 10, 25, 50, 75, 90, 95 and 99.
2. For two axes, run `bin2d` for the density.
3. From skew, outliers and clusters conclude the kind of chart (line, points, density map or histogram), whether and how to
   downsample, and the ranges and scales (linear or logarithmic) of the axes.""",
    "migration_guide": """Data is prepared for charts like this today: {current_approach}
Move it to this engine:
1. Name the tool or operator that takes the place of each step.
2. Show the code before and after.
3. Run `benchmark` for what to expect of the speed.
4. Point out where results or arguments differ.
5. Say what changes between one machine and a cluster.""",
    "analyze_series": "Load {path}, summarize it, look for anomalies and change points, and say what stands out.",
    "compare_series": "Compare the shapes of {a} and {b} and describe how they differ.",
}
"""Prompts offered beside the tools."""


def prompt(name: str, **args: Any) -> str:
    if name not in PROMPTS:
        raise ToolError(f"no prompt {name!r}; there are {', '.join(sorted(PROMPTS))}")
    return PROMPTS[name].format(**args)


def resources(registry: spatial.IndexRegistry, name: str | None = None) -> dict:
    """The named indexes, or the first ten points of one."""
    return {"indexes": registry.list()} if name is None else {"id": name, "points": registry.detail(name)}


