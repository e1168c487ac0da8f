import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.functions import scalar
from chartloom.operators import analysis, binning, downsample, series, sketches, stats, transform
from chartloom.plans import catalogue
from chartloom.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_registered_query_equals_its_sql(spark, duck, name):
    """Every registered query, streams too, on the smallest tables."""
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name])
        at = [want.columns.index(c) for c in names]
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_auto_optimize_of_long_series_equals_its_sql(spark, tmp_path):
    """Series of more than 500,000 events too; the operator itself advises streaming for these."""
    c = duckdb.connect()
    c.sql(f"""COPY (SELECT e.* REPLACE (event_id + i * 1000000 AS event_id) FROM read_parquet('{SF}/events.parquet') e, range(1 + 501000 // (SELECT count(*) FROM read_parquet('{SF}/events.parquet') WHERE event_type = 'view')) r(i)
              WHERE event_type = 'view' OR i = 0) TO '{tmp_path}/events.parquet'""")
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    df = catalogue.QUERIES["auto_optimize"](spark, str(tmp_path))
    columns = ", ".join(f'"{n}"' for n in df.columns)
    want = c.sql(f"SELECT {columns} FROM ({catalogue.ORACLES['auto_optimize']})").fetchall()
    assert max(r[1] for r in want) > 500_000 and len(want) > 1
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in want)
    advised = analysis.auto_optimize(catalogue.events(spark, str(tmp_path)), "x", "value", ["ts", "event_id"], ["event_type"])
    assert {r["event_type"]: r["window"] for r in advised.collect()} == {r[0]: 100_000 if r[1] > 500_000 else None for r in want}


def test_null_keys_are_groups(spark):
    """A null key is a group of its own wherever a group's figures are put beside its rows."""
    rows = [(i, "a" if i % 2 else None, float(i % 7), float(i * i % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, k string, x double, y double")
    filled = df.withColumn("k", F.coalesce("k", F.lit("none")))
    for run in (
        lambda d: stats.mad(d, "x", ["k"]), lambda d: stats.spikes(d, "x", ["k"]), lambda d: stats.outliers_2d(d, "x", "y", ["k"]), lambda d: stats.density_grid(d, "x", "y", ["k"]),
        lambda d: binning.histogram(d, "x", 4, by=["k"]), lambda d: binning.bin2d(d, "x", "y", 3, 3, by=["k"], dense=True), lambda d: binning.hexbin(d, "x", "y", 1.5, ["k"]),
        lambda d: transform.normalize(d, "x", by=["k"]), lambda d: series.anomalies(d, "y", ["i"], ["k"], sensitivity=1.0), lambda d: series.autocorrelation(d, "x", ["i"], [1, 2], ["k"]),
        lambda d: series.change_points(d, "y", ["i"], ["k"], 3), lambda d: downsample.lttb(d, "i", "y", 8, "i", ["k"]), lambda d: downsample.m4(d, "i", "y", 8, "i", ["k"]),
        lambda d: analysis.feature_vector(d, "y", ["i"], ["k"]), lambda d: sketches.tdigest_quantiles(sketches.tdigest(d, "y", by=["k"]), [0.5], ["k"]),
    ):
        got = sorted(tuple(plain("none" if v is None and c == "k" else v) for c, v in r.asDict().items()) for r in run(df).collect())
        assert got and got == sorted(tuple(map(plain, r)) for r in run(filled).collect())


def test_positions_of_frequent_values_and_nulls(spark):
    rows = [(None if i % 9 == 0 else float(i % 3), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "v double, i long").repartition(5)
    got = {r["i"]: (r["position"], r["below"]) for r in transform.global_running(df, ["v", "i"], {"below": F.when(F.col("v") == 1, 1).otherwise(0)}, ranges=7).collect()}
    below = 0
    for n, (v, i) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0.0, r[1]))):
        below += v == 1
        assert got[i] == (n, below)
    assert transform.global_position(df.limit(0), ["v", "i"]).count() == 0


def test_quantiles_by_counting(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(0, 4, 3000), np.full(500, 7.25), -rng.random(400) * 1e-300, [1e308, -1e308, 0.0]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(float("nan"),), (math.inf,), (None,)], "v double").repartition(3)
    order = np.sort(values)
    assert stats.ranked(df, "v", [0, 1, 450, 2000, len(values) - 1, len(values)]) == {k: order[k] for k in (0, 1, 450, 2000, len(values) - 1)}
    want = [r["value"] for r in stats.percentiles(df, "v", [0, 12.5, 50, 99, 100]).collect()]
    monkeypatch.setattr(stats, "ONE_BUFFER", 0)
    assert [r["value"] for r in stats.percentiles(df, "v", [0, 12.5, 50, 99, 100]).collect()] == want
    assert math.isnan(stats.percentiles(df.limit(0), "v", [50]).first()["value"]) and stats.mad(df.limit(0), "v").first()["median"] is None
    got = stats.mad(df, "v").first()
    assert got["median"] == np.median(values) and abs(got["mad"] - np.median(np.abs(values - np.median(values)))) < 1e-12


def test_morton_codes_and_back(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(int(x) for x in rng.integers(0, 1 << 21, 3)) for _ in range(300)] + [(0, 0, 0), ((1 << 21) - 1,) * 3]
    df = spark.createDataFrame(rows, "x long, y long, z long")
    code2, code3 = scalar.morton2(F.col("x"), F.col("y")), scalar.morton3(F.col("x"), F.col("y"), F.col("z"))
    back = [c.alias(f"b{i}") for i, c in enumerate((*scalar.unmorton2(F.col("c2")), *scalar.unmorton3(F.col("c3"))))]
    for r in df.select("*", code2.alias("c2"), code3.alias("c3")).select("*", *back).collect():
        assert r["c2"] == sum((r["x"] >> i & 1) << 2 * i | (r["y"] >> i & 1) << 2 * i + 1 for i in range(32))
        assert r["c3"] == sum((r[a] >> i & 1) << 3 * i + k for k, a in enumerate("xyz") for i in range(21))
        assert [r[f"b{i}"] for i in range(5)] == [r["x"], r["y"], r["x"], r["y"], r["z"]]


def test_digests_of_parts_merge(spark):
    df = spark.range(10_000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    one = sketches.tdigest(df, "v")
    assert one.count() < 500 and one.agg(F.sum("weight")).first()[0] == 10_000
    got = {r["q"]: r["value"] for r in sketches.tdigest_quantiles(one, [0.0, 0.5, 0.99, 1.0]).collect()}
    assert got[0.0] == 0 and got[1.0] == 9999 and abs(got[0.5] - 5000) < 200 and abs(got[0.99] - 9900) < 200
    both = sketches.tdigest_merge(sketches.tdigest(df, "v", by=["k"]).drop("k"))
    assert abs(sketches.tdigest_quantiles(both, [0.5]).first()["value"] - 5000) < 200
    odd = spark.createDataFrame([(float("nan"),), (math.inf,), (5.0,), (None,)], "v double")
    assert sketches.tdigest(odd, "v").count() == 1 and sketches.tdigest(odd.limit(0), "v").count() == 0


def test_guard_and_packed_arrays(spark, tmp_path):
    for name in ("server.key", "a.P12", "b.pfx", "secrets.csv", "My_Secret.txt", "Credentials.csv", "x.PEM"):
        (tmp_path / name).write_text("a,b")
        with pytest.raises(files.PathError):
            files.guard(str(tmp_path / name))
    for folder in (".git", ".ssh", ".AWS"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text("a,b")
        with pytest.raises(files.PathError):
            files.guard(str(tmp_path / folder / "x.csv"))
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "i int, x double, y double")
    back = files.deinterleave(files.interleave(df, ["i"], ["x", "y"]), "packed", ["x", "y"]).first()
    assert (back["x"], back["y"]) == ([1.0, 3.0], [2.0, 4.0])
