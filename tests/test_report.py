from weftgraph import report
from weftgraph.project import BOUNDARY_SCHEMA, EDGE_SCHEMA, NODE_SCHEMA, Project


def test_golden_files(spark, tmp_path, monkeypatch):
    nodes = [("res://b.gd", "script", "res://b.gd", None, None, None), ("res://a.gd", "script", "res://a.gd", 2, '{"b": 1, "a": [2]}', "{}")]
    edges = [(n, "calls", "res://a.gd", "res://b.gd", "code", False, 1.0, "f", n, None) for n in (7, 3)]
    p = Project(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA), spark.createDataFrame([(1, "ingress", "editor_connection", "", "signal:*:x", "f", 1, None)], BOUNDARY_SCHEMA))
    rows = report.golden_rows(p)
    assert [r["id"] for r in rows["nodes"]] == ["res://a.gd", "res://b.gd"] and rows["nodes"][0]["identity"] == {"a": [2], "b": 1} and "line" not in rows["nodes"][1]
    assert [r["ev_line"] for r in rows["edges"]] == [3, 7] and rows["edges"][0]["resolved"] is False and rows["boundaries"][0]["node_id"] == ""
    at = str(tmp_path / "g.json")
    assert report.matches_golden(at, rows) and report.matches_golden(at, rows)
    rows["nodes"].pop()
    assert not report.matches_golden(at, rows)
    monkeypatch.setenv("WEFT_UPDATE_GOLDEN", "1")
    assert report.matches_golden(at, rows)


def test_views(spark):
    nodes = [("class:Node", "class", None, None, '{"name": "Node"}', None), ("res://a.gd", "script", "res://a.gd", None, None, None)]
    edges = [(1, "extends", "res://a.gd", "class:Node", "code", False, 1.0, "f", 1, None), (2, "calls", "res://a.gd", "res://a.gd", "code", True, 1.0, "f", 1, None)]
    p = Project(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA), spark.createDataFrame([], BOUNDARY_SCHEMA))
    view = report.node_view(p, "res://a.gd")
    assert report.node_text(view).split("\n") == ["res://a.gd  [script]", "  outbound (2):", "    -calls-> res://a.gd  (code)", "    -extends-> class:Node  (code, unresolved)", "  inbound (1):", "    <-calls- res://a.gd  (code)"]
    assert report.node_view(p, "nobody") is None
    stats = report.stats_view(p)
    assert stats == {"nodes": 2, "edges": 2, "boundaries": 0, "unresolved": 1, "top_fan_in": [{"id": "class:Node", "kind": "class", "fan_in": 1}]}
    assert "top fan-in:\n     1  class:Node  [class]" in report.stats_text(stats)
    assert report.impact(p, "class:Node") == {"id": "class:Node", "by_kind": {"script": 1}, "by_depth": {1: 1}, "on_cycle": False}
    assert "2 nodes" in report.summary(p, "d", "s") and "1 unresolved edges" in report.summary(p, "d", "s")
