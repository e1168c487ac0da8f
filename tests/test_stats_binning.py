import math

import pytest
from pyspark.sql import functions as F

from chartloom.operators import binning, sketches, stats, transform


def values(spark, data):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(data)], "idx long, v double")


def points(spark, data):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(data)], "idx long, " + ", ".join(f"{a} double" for a in "xyz"[: len(data[0])]))


def test_stats_skip_what_is_not_finite(spark):
    r = stats.stats(values(spark, [1, 2, 3, 4, 5, math.nan, math.inf, None]), "v").first()
    assert (r["count"], r["min"], r["max"], r["mean"], r["variance"]) == (5, 1, 5, 3, 2.5)
    one = stats.stats(values(spark, [42]), "v").first()
    assert (one["count"], one["std_dev"], one["variance"]) == (1, 0, 0)
    none = stats.stats(values(spark, [math.nan]), "v").first()
    assert none["count"] == 0 and math.isnan(none["mean"]) and math.isnan(none["min"])


@pytest.mark.parametrize("data,at,want", [(range(101), [25, 50, 75], [25, 50, 75]), ([42], [0, 50, 100], [42] * 3), ([1, 2], [50, 150, -5], [1.5, 2, 1])])
def test_percentiles(spark, data, at, want):
    assert [r["value"] for r in stats.percentiles(values(spark, data), "v", at).collect()] == want


def test_percentiles_of_nothing(spark):
    assert math.isnan(stats.percentiles(values(spark, []), "v", [50]).first()["value"])


def test_histogram_is_dense_and_clamps(spark):
    rows = stats_rows = binning.histogram(values(spark, range(100)), "v", 10).orderBy("bin").collect()
    assert len(rows) == 10 and sum(r["count"] for r in stats_rows) == 100
    held = binning.histogram(values(spark, [-5, 0, 5, 10, 99]), "v", 2, (0, 10)).orderBy("bin").collect()
    assert [r["count"] for r in held] == [2, 3]
    flat = binning.histogram(values(spark, [7, 7]), "v", 4).orderBy("bin").collect()
    assert [r["count"] for r in flat] == [2, 0, 0, 0] and flat[0]["lo"] == 7 and flat[3]["hi"] == 8
    empty = binning.histogram(values(spark, [math.nan]), "v", 3).collect()
    assert [r["count"] for r in empty] == [0, 0, 0] and empty[0]["lo"] is None


def test_bins_in_two_and_three_dimensions(spark):
    p = points(spark, [(i, i) for i in range(5)])
    assert binning.bin2d(p, "x", "y", 2, 2).agg(F.sum("count")).first()[0] == 5
    e = binning.bin2d_edges(p, "x", "y", 2, 2).first()
    assert len(e["x_edges"]) == 3 and e["max_count"] == 3
    assert binning.bin2d(p, "x", "y", 3, 2, dense=True).count() == 6
    q = points(spark, [(i, i, i) for i in range(10)] + [(math.nan, 1, 1)])
    assert binning.bin3d(q, "x", "y", "z", (4, 4, 4)).agg(F.sum("count")).first()[0] == 10
    assert binning.bin3d(points(spark, [(1, 1, 1)]), "x", "y", "z", (2, 2, 2)).first().asDict() == {"zi": 1, "yi": 1, "xi": 1, "count": 1}


def test_hexbin(spark):
    p = points(spark, list(zip([0, 1, 1.1, 5, 5.1], [0, 0.1, 0.2, 5, 5])))
    out = binning.hexbin(p, "x", "y", 1.0)
    assert out.agg(F.sum("count")).first()[0] == 5 and binning.hexbin(p, "x", "y", 0).count() == 0


def test_clusters_and_hotspots(spark):
    p = points(spark, [(cx + 0.01 * i, cy + 0.01 * (i % 5)) for cx, cy in ((0, 0), (10, 10), (0, 10)) for i in range(30)])
    assert stats.clusters(p, "x", "y") == 3
    assert stats.hotspots(p, "x", "y").first()["count"] == 30


def test_padded_bounds(spark):
    p = points(spark, [(1, 1), (2, math.nan), (math.nan, 3)])
    assert stats.padded_bounds(p, ["x", "y"]).first().asDict() == {"x_min": 1, "x_max": 1, "y_min": 1, "y_max": 1}


def test_normalize_and_transforms(spark):
    from chartloom.functions import scalar as S

    got = [r["normalized"] for r in transform.normalize(values(spark, [0, 50, 100]), "v").orderBy("idx").collect()]
    assert got == [0, 0.5, 1]
    with_nan = [r["normalized"] for r in transform.normalize(values(spark, [1, math.nan, 3]), "v").orderBy("idx").collect()]
    assert with_nan[0] == 0 and math.isnan(with_nan[1]) and with_nan[2] == 1
    held = [round(r["normalized"], 9) for r in transform.normalize(values(spark, [10, 20, 30]), "v", (0, 100)).orderBy("idx").collect()]
    assert held == [0.1, 0.2, 0.3]
    r = values(spark, [0, -1, 8]).select("idx", S.log_transform("v", 2).alias("a"), S.power_transform("v", 0.5).alias("b")).orderBy("idx").collect()
    assert math.isnan(r[0]["a"]) and math.isnan(r[1]["a"]) and round(r[2]["a"], 9) == 3 and math.isnan(r[1]["b"])


def test_sorts_and_positions(spark):
    v = values(spark, [3, math.nan, -1, 3])
    assert [r["idx"] for r in transform.sort_values(v, "v", "idx").collect()] == [2, 0, 3, 1]
    assert [r["idx"] for r in transform.sort_values(v, "v", "idx", descending=True).collect()] == [1, 0, 3, 2]
    many = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), "id")
    out = transform.global_position(many, ["k", "id"], ranges=16).orderBy("k", "id").collect()
    assert [r["position"] for r in out] == list(range(5000))


def test_quantile_normalize(spark):
    m = spark.createDataFrame([(0, 5.0, 4.0), (1, 3.0, 2.0), (2, 1.0, 4.0)], "r long, a double, b double")
    got = {r["r"]: (r["a"], r["b"]) for r in transform.quantile_normalize(m, "r", ["a", "b"]).collect()}
    assert got == {0: (4.5, 3.5), 1: (3.5, 1.5), 2: (1.5, 4.5)}


def test_sketches(spark):
    n = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    assert abs(sketches.distinct_count(n, "v").first()["estimate"] - 10_000) < 500
    assert abs(sketches.hll_estimate(sketches.hll_registers(n, "v", 10), 10).first()["estimate"] - 10_000) < 1000
    assert abs(sketches.kll(n, "v", [0.5]).first()["value"] - 5000) < 500
    d = sketches.ddsketch_quantiles(sketches.ddsketch(n.where("v > 0"), "v"), [0, 0.5, 0.99, 1])
    q = {r["q"]: r["value"] for r in d.collect()}
    assert q[0] == 1 and q[1] == 9999 and abs(q[0.5] - 5000) < 60 and abs(q[0.99] - 9900) < 110
    signed = spark.range(-50, 51).select(F.col("id").cast("double").alias("v"))
    assert abs(sketches.ddsketch_quantiles(sketches.ddsketch(signed, "v"), [0.5]).first()["value"]) < 1.5
    same = spark.range(100).select(F.lit(42).alias("v"))
    assert sketches.count_min_estimate(same, "v", sketches.count_min(same, "v")).first()["estimate"] == 100
    assert sketches.reservoir(n.withColumn("i", F.col("v")), "v", "i", 10).count() == 10
