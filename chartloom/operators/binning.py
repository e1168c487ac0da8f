"""Binning in one, two and three dimensions, and hexagons.

Values outside a given range count in the edge bins; the last edge is inclusive.
A range given for one bound only is ignored, as half a range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col, finite
from .stats import attach


def _given(bounds) -> tuple[float, float] | None:
    if bounds is None or any(b is None or not math.isfinite(b) for b in bounds):
        return None
    return float(bounds[0]), float(bounds[1])


def _edges(df: DataFrame, axes: dict[str, tuple[float, float] | None], by: Sequence[str], widen: tuple[float, float]) -> DataFrame:
    """(axis_lo, axis_hi) of each axis: given, or of its own finite values; an axis of no width is widened."""
    out = []
    for a, bounds in axes.items():
        v = F.when(finite(a), col(a))
        lo, hi = (F.lit(b) for b in bounds) if bounds else (F.min(v), F.max(v))
        out += [lo.alias(f"{a}_lo"), hi.alias(f"{a}_hi")]
    box = df.groupBy(*by).agg(*out)
    for a in axes:
        flat = F.col(f"{a}_lo") == F.col(f"{a}_hi")
        box = box.withColumns({f"{a}_lo": F.when(flat, F.col(f"{a}_lo") - widen[0]).otherwise(F.col(f"{a}_lo")), f"{a}_hi": F.when(flat, F.col(f"{a}_hi") + widen[1]).otherwise(F.col(f"{a}_hi"))})
    return box


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    at = F.floor((v - lo) / ((hi - lo) / bins))
    return F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, value: str, bins: int = 50, bounds=None, by: Sequence[str] = ()) -> DataFrame:
    """(bin, lo, hi, count) of every bin, empty ones too.

    Without finite values counts are 0 and edges NULL.
    """
    src = df.select(*by, col(value).alias("v"))
    box = _edges(src, {"v": _given(bounds)}, by, (0.0, 1.0))
    counts = attach(src.where(finite("v")), box, by).groupBy(*by, _bin(F.col("v"), F.col("v_lo"), F.col("v_hi"), bins).alias("bin")).agg(F.count("*").alias("count"))
    width = (F.col("v_hi") - F.col("v_lo")) / bins
    grid = box.select(*by, "v_lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = attach(grid, counts, [*by, "bin"], "left")
    return out.select(*by, "bin", (F.col("v_lo") + F.col("bin") * F.col("w")).alias("lo"), (F.col("v_lo") + (F.col("bin") + 1) * F.col("w")).alias("hi"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def bin2d(df: DataFrame, x: str, y: str, x_bins: int = 256, y_bins: int = 256, x_bounds=None, y_bounds=None, by: Sequence[str] = (), dense: bool = False) -> DataFrame:
    """(yi, xi, count) of the occupied cells, or of all cells.

    Points count when finite in both axes; each axis takes its own range from its own finite values.
    """
    src = df.select(*by, col(x).alias("x"), col(y).alias("y"))
    box = _edges(src, {"x": _given(x_bounds), "y": _given(y_bounds)}, by, (0.0, 1.0))
    held = attach(src.where(finite("x", "y")), box, by)
    cells = held.groupBy(*by, _bin(F.col("y"), F.col("y_lo"), F.col("y_hi"), y_bins).alias("yi"), _bin(F.col("x"), F.col("x_lo"), F.col("x_hi"), x_bins).alias("xi")).agg(F.count("*").alias("count"))
    if not dense:
        return cells
    grid = box.select(*by, F.explode(F.sequence(F.lit(0), F.lit(x_bins * y_bins - 1))).alias("c"))
    grid = grid.select(*by, F.floor(F.col("c") / x_bins).cast("int").alias("yi"), (F.col("c") % x_bins).alias("xi"))
    return attach(grid, cells, [*by, "yi", "xi"], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))


def bin2d_edges(df: DataFrame, x: str, y: str, x_bins: int = 256, y_bins: int = 256, x_bounds=None, y_bounds=None, by: Sequence[str] = ()) -> DataFrame:
    """(x_edges, y_edges, max_count) beside the cells of ``bin2d``."""
    src = df.select(*by, col(x).alias("x"), col(y).alias("y"))
    box = _edges(src, {"x": _given(x_bounds), "y": _given(y_bounds)}, by, (0.0, 1.0))
    most = bin2d(df, x, y, x_bins, y_bins, x_bounds, y_bounds, by).groupBy(*by).agg(F.max("count").alias("max_count"))

    def lines(a: str, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.col(f"{a}_lo") + i * ((F.col(f"{a}_hi") - F.col(f"{a}_lo")) / n)).alias(f"{a}_edges")

    edges = [lines("x", x_bins), lines("y", y_bins)]
    return attach(box, most, by).select(*by, *edges, "max_count")


def bin3d(df: DataFrame, x: str, y: str, z: str, bins: tuple[int, int, int] = (32, 32, 32), bounds=(None, None, None), by: Sequence[str] = ()) -> DataFrame:
    """(zi, yi, xi, count) of the occupied voxels; an axis of no width is widened by a half both ways."""
    axes = dict(zip("xyz", map(_given, bounds)))
    src = df.select(*by, *(col(c).alias(a) for a, c in zip("xyz", (x, y, z))))
    box = _edges(src, axes, by, (0.5, 0.5))
    held = attach(src.where(finite("x", "y", "z")), box, by)
    at = {a: _bin(F.col(a), F.col(f"{a}_lo"), F.col(f"{a}_hi"), n).alias(f"{a}i") for a, n in zip("xyz", bins)}
    return held.groupBy(*by, at["z"], at["y"], at["x"]).agg(F.count("*").alias("count"))


def hexbin(df: DataFrame, x: str, y: str, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """(row, col, cx, cy, count) of the occupied hexagons of a radius; none for a radius of 0 or less.

    Columns are two radii apart and rows the root of three; odd rows are shifted by one radius.
    """
    src = df.select(*by, col(x).alias("x"), col(y).alias("y")).where(finite("x", "y"))
    if not radius > 0:
        return src.select(*by, F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.lit(0).cast("long").alias("count")).where("false")
    dx, dy = 2.0 * radius, math.sqrt(3.0) * radius
    origin = src.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    held = attach(src, origin, by).withColumn("row", F.round((F.col("y") - F.col("y0")) / dy).cast("int"))
    shift = F.when(F.col("row") % 2 != 0, F.lit(float(radius))).otherwise(0.0)
    held = held.withColumn("off", shift).withColumn("col", F.round((F.col("x") - F.col("x0") - F.col("off")) / dx).cast("int"))
    held = held.groupBy(*by, "row", "col", "off", "x0", "y0").agg(F.count("*").alias("count"))
    return held.select(*by, "row", "col", (F.col("x0") + F.col("off") + F.col("col") * dx).alias("cx"), (F.col("y0") + F.col("row") * dy).alias("cy"), "count")
