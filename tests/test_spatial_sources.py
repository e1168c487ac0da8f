import math
import random

import pytest
from pyspark.sql import functions as F

from chartloom.functions import scalar as S
from chartloom.operators import spatial
from chartloom.sources import files, synthetic


def points(spark, rows):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rows)], "idx long, " + ", ".join(f"{a} double" for a in "xyz"[: len(rows[0])]))


CLOUD = [(500 * math.sin(0.07 * i) + 73 * math.cos(0.011 * i) + 500, 500 * math.cos(0.05 * i) + 91 * math.sin(0.017 * i) + 500) for i in range(333)]


def test_ranges_and_neighbours(spark):
    line = points(spark, [(i, i) for i in range(100)])
    assert sorted(r["idx"] for r in spatial.bbox(line, ("x", "y"), (10, 10), (20, 20)).collect()) == list(range(10, 21))
    assert spatial.knn(points(spark, [(10 * i, 10 * i) for i in range(5)]), ("x", "y"), (11, 11), 1, "idx").first()["idx"] == 1
    cloud = points(spark, CLOUD)
    for r in (5, 20, 80):
        want = {i for i, (x, y) in enumerate(CLOUD) if (x - 500) ** 2 + (y - 400) ** 2 <= r * r}
        assert {p["idx"] for p in spatial.radius(cloud, "x", "y", 500, 400, r).collect()} == want


def test_knn_join_equals_brute_force(spark):
    rng = random.Random(1)
    probes = [(rng.uniform(-200, 1200), rng.uniform(-200, 1200)) for _ in range(12)] + [(5000.0, 5000.0)]
    a = points(spark, probes).withColumnRenamed("idx", "p")
    got = {}
    for r in spatial.knn_join(a, points(spark, CLOUD), ("x", "y"), 4, "p", "idx").collect():
        got.setdefault(r["p"], {})[r["rank"]] = r["idx"]
    for i, (x, y) in enumerate(probes):
        want = sorted(range(len(CLOUD)), key=lambda j: ((CLOUD[j][0] - x) ** 2 + (CLOUD[j][1] - y) ** 2, j))[:4]
        assert [got[i][k] for k in (1, 2, 3, 4)] == want


def test_radius_join_equals_brute_force(spark):
    got = {(r["p"], r["idx"]) for r in spatial.radius_join(points(spark, CLOUD[:40]).withColumnRenamed("idx", "p"), points(spark, CLOUD), "x", "y", 25.0, "p", "idx").collect()}
    assert got == {(i, j) for i in range(40) for j in range(len(CLOUD)) if math.dist(CLOUD[i], CLOUD[j]) <= 25}


def joined_rows(df):
    """Rows that the joins of the last stage of a plan that ran made."""
    todo, found = [df._jdf.queryExecution().executedPlan().executedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("ResultQueryStage"):
            todo.append(node.plan())
        if "Join" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return sum(found)


def test_radius_join_compares_equal_points_once(spark):
    """Copies are no pairs before the join is over: rows of the join do not grow with their square."""
    a, b = points(spark, [(3, 4)] * 300 + [(90, 90)]).withColumnRenamed("idx", "p"), points(spark, [(3, 5)] * 400 + [(4, 4)] * 100 + [(50, 50)])
    pairs = spatial.radius_join(a, b, "x", "y", 1.0, "p", "idx")
    assert sorted((r["p"], r["idx"], r["d2"]) for r in pairs.collect()) == [(i, j, 1.0) for i in range(300) for j in range(500)]
    assert joined_rows(pairs) == 2


def test_radius_join_deals_copies_and_full_cells(spark, monkeypatch):
    monkeypatch.setattr(spatial, "ALIKE", 16)
    monkeypatch.setattr(spatial, "BLOCK", 1000)
    rows = [(p[0] / 10, p[1] / 10) for p in CLOUD] + [(50.0, 50.0)] * 70 + [(0.0, -0.0), (-0.0, 0.0)]
    a = points(spark, rows).selectExpr("if(idx = 400, null, concat('p', idx)) AS p", "x", "y").unionByName(spark.createDataFrame([("bad", math.nan, 1.0), ("none", None, 1.0)], "p string, x double, y double"))
    name = lambda i: None if i == 400 else f"p{i}"
    for r in (0.0, 3.0, 12.5):
        got = [(q["p"], q["idx"]) for q in spatial.radius_join(a, points(spark, rows), "x", "y", r, "p", "idx").collect()]
        want = [(name(i), j) for i, (u, v) in enumerate(rows) for j, (x, y) in enumerate(rows) if (u - x) * (u - x) + (v - y) * (v - y) <= r * r]
        assert len(got) == len(want) and set(got) == set(want)
    assert spatial.radius_join(a.limit(0), points(spark, rows), "x", "y", 3.0, "p", "idx").count() == 0


def test_morton_round_trip(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 2, 3), (2097151, 5, 1 << 20)], "a long, b long, c long")
    two = S.unmorton2(S.morton2(F.col("a"), F.col("b")))
    three = S.unmorton3(S.morton3(F.col("a"), F.col("b"), F.col("c")))
    for r in df.select("a", "b", "c", *(c.alias(f"t{i}") for i, c in enumerate((*two, *three)))).collect():
        assert (r["t0"], r["t1"]) == (r["a"], r["b"]) and (r["t2"], r["t3"], r["t4"]) == (r["a"], r["b"], r["c"])
    assert df.limit(0).count() == 0
    order = [r["idx"] for r in spatial.morton_order(points(spark, [(0, 0), (1, 1), (0, 1), (1, 0), (math.nan, 0)]), ("x", "y"), "idx").collect()]
    assert order == [0, 3, 2, 1, 4]


def test_frustum(spark):
    p = points(spark, [(0, 0, 0), (-2, 0, 0), (2, 0, 0), (0.5, 0.5, 0.5), (0, 0, -3), (math.nan, 0, 0)])
    identity = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
    assert S.frustum_planes(identity)[0] == (1, 0, 0, 1)
    assert sorted(r["idx"] for r in spatial.frustum_cull(p, ("x", "y", "z"), identity).collect()) == [0, 3]
    with pytest.raises(ValueError):
        S.frustum_planes([1.0])


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([], []), ([0.0], [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [1, 0, 0, 0, 0]


def test_registry(spark):
    reg = spatial.IndexRegistry()
    info = reg.build("cloud", points(spark, CLOUD), ("x", "y"), "idx")
    assert info["count"] == 333 and reg.list() == ["cloud"] and len(reg.detail("cloud")) == 10
    assert reg.query_nearest("cloud", CLOUD[7], 1).first()["idx"] == 7
    with pytest.raises(KeyError):
        reg.query_range("none", (0, 0), (1, 1))
    reg.drop("cloud")


def test_clustered_files_prune(spark, tmp_path):
    path = str(tmp_path / "z")
    spatial.write_clustered(points(spark, CLOUD), ("x", "y"), path, 4)
    assert spatial.bbox(spark.read.parquet(path), ("x", "y"), (0, 0), (2000, 2000)).count() == sum(0 <= x <= 2000 and 0 <= y <= 2000 for x, y in CLOUD)


def test_delimited(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(" t , v ,name\n1,10,a\n2,12abc,b\n\n3,oops,c\n4,,d\n5,-1.5e2,e\n")
    rows, skipped = files.load_delimited(spark, str(path))
    assert sorted((r["x"], r["y"]) for r in rows.collect()) == [(1, 10), (2, 12), (5, -150)]
    assert skipped.first()["skipped_rows"] == 2
    assert files.inspect_delimited(spark, str(path))["columns"] == ["t", "v", "name"]
    with pytest.raises(files.PathError, match="no column"):
        files.load_delimited(spark, str(path), x="nope")
    with pytest.raises(files.PathError, match="does not exist"):
        files.guard(str(tmp_path / "missing.csv"))
    with pytest.raises(files.PathError, match="outside"):
        files.guard(str(path), [str(tmp_path / "other")])
    assert files.guard(str(path), [str(tmp_path)]) == str(path)


def test_output_forms(spark):
    df = points(spark, [(1, 2), (3, math.nan)])
    assert [r["json"] for r in files.to_json(df.orderBy("idx")).collect()] == ['{"idx":0,"x":1.0,"y":2.0}', '{"idx":1,"x":3.0,"y":null}']
    assert files.interleave(df.where("idx = 0"), ["idx"], ["x", "y"]).first()["packed"] == [1, 2]
    assert files.pack(df, ["idx"], ["x"]).first()["x"] == [1, 3]


def test_generators(spark):
    assert synthetic.random_walk(spark, 50, keys=2).count() == 100
    assert synthetic.uniform_points(spark, 20, dims=3).columns == ["idx", "x", "y", "z"]
    assert synthetic.clustered_points(spark, 64).select("cluster").distinct().count() == 8
    assert synthetic.price_walk(spark, 30).where("y > 0").count() == 30
