"""Shape-preserving downsampling of series: LTTB, MinMax + LTTB, LTOB, M4.

Points that are not finite go first.  Positions follow (x, tie).  Bucket bounds are floors of
float products, recovered exactly from the position (see ``bucket``).  All but the
last step of LTTB is parallel over buckets; that step folds one row for each bucket, in
which each bucket has been reduced to its convex hull where asked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import col, finite
from .stats import attach
from .transform import global_position


def _points(df: DataFrame, x: str, y: str, tie: str, by: Sequence[str]) -> DataFrame:
    """(by..., x, y, tie, i, n): finite points, their position in the series and its length."""
    src = df.where(finite(x, y)).select(*by, col(x).alias("x"), col(y).alias("y"), F.col(tie).alias("tie"))
    if not by:
        src = global_position(src, ["x", "tie"], "i")
        # A literal, so that the branch for short series or that for long ones leaves the plan.
        return src.withColumn("n", F.lit(src.count()).cast("long"))
    src = src.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("x", "tie")) - 1)
    return attach(src, src.groupBy(*by).agg(F.count("*").alias("n")), by)


def bucket(i: str, buckets: str) -> Column:
    """The b with floor(b s) + 1 <= i < floor((b + 1) s) + 1 for the float s = (n - 2) / buckets.

    floor((i - 1) / s) is that or its neighbour below or above.
    """
    s = f"(cast(n - 2 as double) / cast({buckets} as double))"
    g = f"floor(({i} - 1) / {s})"
    return F.expr(f"cast(CASE WHEN {i} - 1 < floor({g} * {s}) THEN {g} - 1 WHEN {i} - 1 >= floor(({g} + 1) * {s}) THEN {g} + 1 ELSE {g} END as int)")


def m4(df: DataFrame, x: str, y: str, target: int, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """First, last, least and greatest point of each of target / 4 buckets of positions, each once."""
    p = _points(df, x, y, tie, by)
    if target < 4:
        return p.select(*by, "i", "x", "y", "tie")
    k = target // 4
    # Bucket b holds [floor(b n / k), floor((b + 1) n / k)): whole numbers throughout.
    b = F.expr(f"cast(floor((({k} * (i + 1)) - 1) / n) as int)")
    point = F.struct("i", "x", "y", "tie")
    cut = p.where(F.col("n") > target).withColumn("b", b).groupBy(*by, "b").agg(
        F.array_distinct(F.array(F.min_by(point, "i"), F.max_by(point, "i"), F.min_by(point, F.struct("y", "i")), F.max_by(point, F.struct(F.col("y"), -F.col("i"))))).alias("e")
    )
    cut = cut.select(*by, F.explode("e").alias("e")).select(*by, "e.*")
    return p.where(F.col("n") <= target).select(*by, "i", "x", "y", "tie").unionByName(cut)


def min_max(df: DataFrame, x: str, y: str, target: int, tie: str, by: Sequence[str] = (), factor: int = 4) -> DataFrame:
    """Least and greatest point of 2 target - 1 buckets and both ends; series of no more than 4 target points stay whole."""
    p = _points(df, x, y, tie, by)
    return _min_max(p, target, by, factor)


def _min_max(p: DataFrame, target: int, by: Sequence[str], factor: int = 4) -> DataFrame:
    m = factor * target
    whole = p.where(F.col("n") <= m).select(*by, "i", "x", "y", "tie")
    big = p.where(F.col("n") > m)
    ends = big.where((F.col("i") == 0) | (F.col("i") == F.col("n") - 1)).select(*by, "i", "x", "y", "tie")
    inner = big.where((F.col("i") > 0) & (F.col("i") < F.col("n") - 1)).withColumn("b", bucket("i", str(m // 2 - 1)))
    # A tail that rounding leaves after the last bucket is in none.
    inner = inner.where(F.col("b") < m // 2 - 1)
    point = F.struct("i", "x", "y", "tie")
    cut = inner.groupBy(*by, "b").agg(F.array_distinct(F.array(F.min_by(point, F.struct("y", "i")), F.max_by(point, F.struct(F.col("y"), -F.col("i"))))).alias("e"))
    return whole.unionByName(ends).unionByName(cut.select(*by, F.explode("e").alias("e")).select(*by, "e.*"))


def ltob(df: DataFrame, x: str, y: str, target: int, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """Both ends, and of each bucket the point of the largest triangle with the bucket's own ends."""
    p = _points(df, x, y, tie, by)
    if target < 3:
        return _short(p, target, by)
    whole = p.where(F.col("n") <= target).select(*by, "i", "x", "y", "tie")
    big = p.where(F.col("n") > target)
    ends = big.where((F.col("i") == 0) | (F.col("i") == F.col("n") - 1)).select(*by, "i", "x", "y", "tie")
    inner = big.where((F.col("i") > 0) & (F.col("i") < F.col("n") - 1)).withColumn("b", bucket("i", str(target - 2))).where(F.col("b") < target - 2)
    w = Window.partitionBy(*by, "b").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inner = inner.withColumns({"fx": F.first("x").over(w), "fy": F.first("y").over(w), "lx": F.last("x").over(w), "ly": F.last("y").over(w)})
    area = F.abs((F.col("fx") - F.col("lx")) * (F.col("y") - F.col("fy")) - (F.col("fx") - F.col("x")) * (F.col("ly") - F.col("fy")))
    cut = inner.groupBy(*by, "b").agg(F.max_by(F.struct("i", "x", "y", "tie"), F.struct(area, -F.col("i"))).alias("e")).select(*by, "e.*")
    return whole.unionByName(ends).unionByName(cut)


def _short(p: DataFrame, target: int, by: Sequence[str]) -> DataFrame:
    """Targets below three: all points below two, both ends for two."""
    keep = F.lit(True) if target < 2 else (F.col("n") <= target) | (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    return p.where(keep).select(*by, "i", "x", "y", "tie")


def hulls(inner: DataFrame, by: Sequence[str]) -> DataFrame:
    """The points of each bucket on its convex hull, points along its edges included.

    The area of a triangle on a fixed side is the absolute value of a linear function of
    its tip, so its greatest value, and the first point that has it, is on the hull.
    """
    import numpy as np
    import pandas as pd

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["x", "y", "i"])
        xs, ys = t["x"].to_numpy(), t["y"].to_numpy()
        keep = np.zeros(len(t), bool)
        for sign in (1.0, -1.0):
            chain: list[int] = []
            for j in range(len(t)):
                while len(chain) > 1:
                    a, b = chain[-2], chain[-1]
                    if sign * ((xs[b] - xs[a]) * (ys[j] - ys[a]) - (ys[b] - ys[a]) * (xs[j] - xs[a])) < 0:
                        chain.pop()
                    else:
                        break
                chain.append(j)
            keep[chain] = True
        return t[keep]

    return inner.groupBy(*by, "b").applyInPandas(run, inner.schema)


_FOLD = """aggregate(array_sort(collect_list(struct(b, ax, ay, pts))),
    named_struct('px', max(x0), 'py', max(y0), 'out', cast(array() as array<struct<i:bigint,x:double,y:double,tie:{tie}>>)),
    (s, e) -> aggregate(e.pts, named_struct('area', -1.0D, 'p', e.pts[0]), (m, q) ->
        CASE WHEN abs((s.px - e.ax) * (q.y - s.py) - (s.px - q.x) * (e.ay - s.py)) > m.area
        THEN named_struct('area', abs((s.px - e.ax) * (q.y - s.py) - (s.px - q.x) * (e.ay - s.py)), 'p', q) ELSE m END,
        m -> named_struct('px', m.p.x, 'py', m.p.y, 'out', array_append(s.out, m.p))),
    s -> s.out)"""


def _lttb(p: DataFrame, target: int, by: Sequence[str], reduce: bool) -> DataFrame:
    if target < 3:
        return _short(p, target, by)
    k = target - 2
    shape = [*by, "i", "x", "y", "tie"]
    whole = p.where(F.col("n") <= target).select(*shape)
    big = p.where(F.col("n") > target)
    first, last = (big.where(F.col("i") == e) for e in (F.lit(0), F.col("n") - 1))
    dealt = big.where(F.col("i") > 0).withColumn("b", F.when(F.col("i") == F.col("n") - 1, F.lit(k)).otherwise(F.least(bucket("i", str(k)), F.lit(k))))
    means = dealt.groupBy(*by, "b").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    means = means.withColumn("b", F.col("b") - 1).where(F.col("b") >= 0).withColumnsRenamed({"mx": "ax", "my": "ay"})
    inner = dealt.where(F.col("b") < k).select(*by, "b", "i", "x", "y", "tie")
    inner = hulls(inner, by) if reduce else inner
    groups = inner.groupBy(*by, "b").agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), "x", "y", "tie"))).alias("pts"))
    start = first.select(*by, F.col("x").alias("x0"), F.col("y").alias("y0"))
    rows = attach(attach(groups, means, [*by, "b"]), start, by)
    tie = dict(p.dtypes)["tie"]
    picked = rows.groupBy(*by).agg(F.expr(_FOLD.format(tie=tie)).alias("out"))
    picked = picked.select(*by, F.explode("out").alias("e")).select(*by, "e.*")
    return whole.unionByName(first.select(*shape)).unionByName(picked).unionByName(last.select(*shape))


def lttb(df: DataFrame, x: str, y: str, target: int, tie: str, by: Sequence[str] = (), reduce: bool | None = None) -> DataFrame:
    """Both ends, and of each bucket the point of the largest triangle with the point picked before and the next bucket's mean.

    ``reduce`` sends each bucket through its convex hull first, so that the fold sees a few points
    of each; by default for a series without ``by``, which may be of any length.
    """
    return _lttb(_points(df, x, y, tie, by), target, by, not by if reduce is None else reduce)


def min_max_lttb(df: DataFrame, x: str, y: str, target: int, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """LTTB of the points that ``min_max`` keeps: at most 4 target reach the fold."""
    kept = _min_max(_points(df, x, y, tie, by), target, by)
    w = Window.partitionBy(*by)
    kept = kept.select(*by, "x", "y", "tie", (F.row_number().over(w.orderBy("i")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return _lttb(kept, target, by, False)


def append_and_downsample(old: DataFrame, new: DataFrame, x: str, y: str, keep: int, target: int, tie: str) -> DataFrame:
    """LTTB of the last ``keep`` points of two parts of a series."""
    both = old.unionByName(new).orderBy(F.desc(x), F.desc(tie)).limit(keep)
    return lttb(both, x, y, target, tie, reduce=False)
