import math
import random

import pytest
from pyspark.sql import functions as F

from chartloom.operators import analysis, downsample, series


def make(spark, ys, xs=None):
    xs = xs or range(len(ys))
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys))], "idx long, x double, y double")


def twin(xs, ys, t):
    """LTTB as one sequential pass: positions picked."""
    n = len(xs)
    if t >= n or t < 2:
        return list(range(n))
    if t == 2:
        return [0, n - 1]
    s, out, p = (n - 2) / (t - 2), [0], 0
    for i in range(t - 2):
        a, b, c = int(i * s) + 1, int((i + 1) * s) + 1, min(int((i + 2) * s) + 1, n)
        mx, my = sum(xs[b:c]) / (c - b), sum(ys[b:c]) / (c - b)
        best, pick = -1.0, a
        for j in range(a, min(b, n - 1)):
            area = abs((xs[p] - mx) * (ys[j] - ys[p]) - (xs[p] - xs[j]) * (my - ys[p]))
            if area > best:
                best, pick = area, j
        out.append(pick)
        p = pick
    return [*out, n - 1]


@pytest.mark.parametrize("n,t,reduce", [(1000, 50, False), (1000, 50, True), (333, 40, False), (57, 19, True)])
def test_lttb_equals_the_sequential_pass(spark, n, t, reduce):
    ys = [100 * math.sin(0.05 * i) + 17 * math.cos(0.013 * i) for i in range(n)]
    got = [r["i"] for r in downsample.lttb(make(spark, ys), "x", "y", t, "idx", reduce=reduce).orderBy("i").collect()]
    assert got == twin(list(map(float, range(n))), ys, t)


def test_lttb_on_noise_by_key(spark):
    rng = random.Random(4)
    ys = [rng.gauss(0, 1) for _ in range(400)]
    df = make(spark, ys).withColumn("k", F.col("idx") % 2)
    got = downsample.lttb(df, "x", "y", 20, "idx", ["k"])
    for k in (0, 1):
        want = twin([float(i) for i in range(k, 400, 2)], ys[k::2], 20)
        assert [r["i"] for r in got.where(F.col("k") == k).orderBy("i").collect()] == want


def test_small_targets_and_inputs(spark):
    three = make(spark, [4, 5, 6])
    for f in (downsample.lttb, downsample.ltob, downsample.m4, downsample.min_max_lttb):
        assert f(three, "x", "y", 10, "idx").count() == 3
        assert f(make(spark, [1]).where("false"), "x", "y", 10, "idx").count() == 0
    ends = [r["x"] for r in downsample.lttb(make(spark, range(100)), "x", "y", 2, "idx").orderBy("x").collect()]
    assert ends == [0, 99]


def test_min_max_keeps_the_spike(spark):
    ys = [0.0] * 100
    ys[50] = 1000.0
    out = [r["y"] for r in downsample.min_max_lttb(make(spark, ys), "x", "y", 10, "idx").collect()]
    assert len(out) == 10 and max(out) == 1000
    wave = make(spark, [100 * math.sin(0.05 * i) for i in range(1000)])
    assert downsample.min_max_lttb(wave, "x", "y", 50, "idx").count() == 50
    assert downsample.ltob(wave, "x", "y", 50, "idx").count() == 50
    assert 2 <= downsample.m4(wave, "x", "y", 20, "idx").count() <= 20


def test_append_and_downsample(spark):
    a, b = make(spark, [math.sin(0.1 * i) for i in range(100)]), make(spark, [math.sin(0.1 * i) for i in range(100, 200)], range(100, 200))
    out = [r["x"] for r in downsample.append_and_downsample(a, b, "x", "y", 150, 10, "idx").orderBy("x").collect()]
    assert len(out) == 10 and (out[0], out[-1]) == (50, 199)


def test_rolling(spark):
    r = series.rolling(make(spark, [1, 2, 3, 10]), "y", ["idx"], 3).orderBy("idx").collect()[-1]
    assert (r["length"], r["min"], r["max"], r["mean"]) == (3, 2, 10, 5) and round(r["variance"], 9) == 19


def test_anomalies(spark):
    ys = [10.0] * 101
    ys[50] = 1000.0
    r = series.anomalies(make(spark, ys), "y", ["idx"]).collect()
    assert [(x["position"], x["type"]) for x in r] == [(50, "spike")]
    wave = [math.sin(0.1 * i) for i in range(100)]
    wave[25], wave[75] = 50, -50
    assert {x["position"] for x in series.anomalies(make(spark, wave), "y", ["idx"], mode="strict_mad").collect()} >= {25, 75}
    assert series.anomalies(make(spark, [1, 2, 99]), "y", ["idx"]).count() == 0


def test_change_points(spark):
    a = [10.0] * 100 + [50.0] * 100
    found = [r["position"] for r in series.change_points(make(spark, a), "y", ["idx"], min_segment=10).collect()]
    assert any(abs(p - 100) <= 30 for p in found)
    b = [10.0] * 200 + [50 + 0.5 * math.sin(0.37 * i) for i in range(200)]
    found = [r["position"] for r in series.change_points(make(spark, b), "y", ["idx"], min_segment=50, mode="two_sided").collect()]
    assert any(abs(p - 200) <= 60 for p in found)


def test_periodicity_and_spacing(spark):
    wave = make(spark, [math.sin(2 * math.pi * i / 20) for i in range(400)])
    # The first lag above 0.3 on the way up, not the peak at 20.
    assert series.periodicity(wave, "y", ["idx"], most=64).first()["period"] == 17
    assert series.even_spacing(make(spark, [0] * 1500), "x", ["idx"]).first()["even"]
    assert not series.monotonic(make(spark, [1, 3, 2]), "y", ["idx"]).first()["monotonic"]


def test_periodicity_beyond_256_equals_brute_force(spark):
    def brute(y):
        n, m = len(y), sum(y) / len(y)
        var, prev, fell = sum((v - m) ** 2 for v in y), 1.0, False
        for lag in range(1, n // 2):
            c = sum((y[i] - m) * (y[i + lag] - m) for i in range(n - lag)) / var
            if c < prev:
                fell = True
            elif fell and c > 0.3:
                return lag
            prev = c
        return 0

    values = {"long": [math.sin(2 * math.pi * i / 400) for i in range(1300)], "noise": [float(i * 7919 % 101) for i in range(300)], "short": [0.0, 1.0] * 6}
    rows = [(k, i, y) for k, v in values.items() for i, y in enumerate(v)]
    got = {r["k"]: r["period"] for r in series.periodicity(spark.createDataFrame(rows, "k string, idx long, y double"), "y", ["idx"], ["k"]).collect()}
    assert got == {k: brute(v) for k, v in values.items()} and got["long"] > 256
    assert series.periodicity(make(spark, values["short"]).where("false"), "y", ["idx"]).first()["period"] == 0


def test_shapes(spark):
    rows = [(k, i, f(i)) for k, f in (("a", lambda i: math.sin(i / 10)), ("b", lambda i: math.sin(i / 10 + 0.3)), ("c", lambda i: 50.0)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, idx long, y double")
    sim = {(r["a"], r["b"]): r["similarity"] for r in analysis.shape_similarity(analysis.shape_vector(df, "y", ["idx"], ["k"]), "k").collect()}
    assert sim["a", "b"] > 0.8 and sim["a", "c"] < 0.8


@pytest.mark.parametrize("text,operation,params", [("show spikes above 50", "filter", {"min": 50.0}), ("find anomalies", "anomaly", {"sensitivity": 3}), ("downsample to 500 points", "downsample", {"target": 500}), ("values under 3.5", "filter", {"max": 3.5}), ("last 15 minutes", "filter", {"timeRange": "last_15m"}), ("what is the trend", "summarize", {"focus": "trend"}), ("hello", "summarize", {})])
def test_parse_query(text, operation, params):
    got = analysis.parse_query(text)
    assert (got["operation"], got["params"]) == (operation, params)


def test_summaries_and_configuration(spark):
    line = make(spark, [2 * i + 5 for i in range(100)])
    s = analysis.summarize(line, "x", "y", ["idx"]).first()
    assert s["trend"] == "increasing" and s["slope"] == 2 and s["summary"].startswith("Dataset: 100 points")
    assert analysis.summarize_series(line, "x", "y", ["idx"])["trend"] == "increasing"
    smooth = make(spark, [math.sin(i / 100) for i in range(3000)])
    assert analysis.auto_optimize(smooth, "x", "y", ["idx"]).first()["algorithm"] == "lttb"
    spiky = make(spark, [1000 if i % 100 == 0 else math.sin(i / 100) for i in range(3000)])
    assert analysis.auto_optimize(spiky, "x", "y", ["idx"]).first()["algorithm"] == "minmax_lttb"
    assert "3,000 time-series points" in analysis.summarize_for_prompt(smooth, "x", "y", ["idx"])
    assert analysis.auto_configure(spiky, "x", "y", ["idx"])["n"] == 3000
    assert analysis.summarize_scatter(line, "x", "y")["correlation"] > 0.99
