import json

import pytest

from chartloom.operators.spatial import IndexRegistry
from chartloom.plans import tools


def test_every_tool_runs(spark, tmp_path):
    x, y = list(range(60)), [float(i % 7) for i in range(60)]
    csv = tmp_path / "t.csv"
    csv.write_text("x,y\n" + "\n".join(f"{a},{b}" for a, b in zip(x, y)))
    reg = IndexRegistry()
    args = {
        "lttb": dict(x=x, y=y, threshold=10), "minmax_lttb": dict(x=x, y=y, threshold=5), "auto_downsample": dict(x=x, y=y, threshold=8, hint="scatter"), "histogram": dict(data=y, bins=7),
        "bin2d": dict(x=x, y=y, x_bins=4, y_bins=4), "bin3d": dict(x=x, y=y, z=y, bins=2), "build_index": dict(name="a", x=x, y=y), "query_range": dict(name="a", low=(0, 0), high=(9, 9)),
        "build_index_3d": dict(name="b", x=x, y=y, z=y), "query_range_3d": dict(name="b", low=(0, 0, 0), high=(9, 9, 9)), "query_nearest": dict(name="a", probe=(3, 3), k=2),
        "frustum_cull": dict(x=[0.0, 5.0], y=[0.0, 0.0], z=[0.0, 0.0], mvp=[1.0 if i % 5 == 0 else 0.0 for i in range(16)]), "compute_stats": dict(data=[1, 2, 3, 4, 5]), "normalize": dict(data=[0, 50, None]),
        "sort": dict(data=[3, 1, 2], descending=True), "capabilities": {}, "benchmark": dict(size=2000, runs=1), "load_file": dict(path=str(csv)), "inspect_file": dict(path=str(csv)), "summarize": dict(y=y),
        "detect_anomalies": dict(data=[10.0] * 50 + [1000.0] + [10.0] * 50), "ai_auto_optimize": dict(x=x, y=y), "parse_query": dict(query="values above 5"), "shape_similarity": dict(a=y, b=y),
    }
    assert set(args) == set(tools.TOOLS)
    got = {n: tools.call(spark, n, reg, **a) for n, a in args.items()}
    assert got["lttb"]["count"] == 10 and got["histogram"]["counts"][0] == 9 and sum(map(sum, got["bin2d"]["grid"])) == 60
    assert got["query_range"]["indices"] == list(range(10)) and got["frustum_cull"]["indices"] == [0]
    assert got["compute_stats"]["mean"] == 3 and got["compute_stats"]["percentiles"]["50"] == 3
    assert got["normalize"]["data"] == [0, 1, None] and got["sort"]["data"] == [3, 2, 1]
    assert got["detect_anomalies"]["anomalies"][0]["index"] == 50 and got["load_file"]["skipped_rows"] == 0
    assert got["shape_similarity"]["similarity"] == 1 and len(got["shape_similarity"]["shapes"]["a"]) == 16
    json.loads(tools.call_json(spark, "parse_query", query="trend"))
    assert tools.resources(reg)["indexes"] == ["a", "b"] and "100 pixels wide" in tools.prompt("optimize_chart", data_size=5, chart_width=100)


def test_errors(spark):
    for bad in (dict(name="nope"), dict(name="lttb", x=[1]), dict(name="lttb", x=[1], y=[1, 2], threshold=3)):
        with pytest.raises(tools.ToolError):
            tools.call(spark, bad.pop("name"), None, **bad)
    with pytest.raises(ValueError):
        tools.call(spark, "auto_downsample", x=[1, 2], y=[1, 2], threshold=1, hint="what")
    with pytest.raises(tools.ToolError):
        tools.prompt("nope")
