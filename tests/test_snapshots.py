from datetime import datetime

from weftgraph.operators import hotkeys, snapshot_diff

NODE = "snapshot_no int, taken_at timestamp_ntz, delivered_at timestamp_ntz, id string, kind string, path string, line int, identity string, spare string"
EDGE = "snapshot_no int, taken_at timestamp_ntz, delivered_at timestamp_ntz, type string, source_id string, target_id string, origin string, resolved boolean, confidence double, ev_file string, ev_line int"
T = [datetime(2024, 1, d) for d in range(1, 10)]


def node(no, at, key, line=1, identity=None, path="p"):
    return (no, T[0], T[at], key, "script", path, line, identity, "x")


def edge(no, at, target, confidence=1.0, resolved=True, line=1):
    return (no, T[0], T[at], "calls", "res://a", target, "code", resolved, confidence, "f", line)


def changes(spark, nodes, edges):
    got = snapshot_diff.graph_changes(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)).collect()
    return {(r["entity"], r["snapshot_no"], r["node_id"] or r["target_id"], r["change"]) for r in got}


def test_added_removed_changed_and_spellings(spark):
    nodes = [
        node(1, 0, "res://a"), node(2, 1, " res://./a"), node(1, 0, "res://b", identity='{"x": 1, "y": [2]}'), node(2, 1, "res://b", identity='{"y":[2],"x":1.0}'), node(1, 0, "res://c", None), node(2, 1, "res://c", 0), node(1, 0, "res://d", path=None),
        node(2, 1, "res://d", path=""), node(1, 0, "res://old"), node(2, 1, "res://new"), node(1, 0, "res://e", 1), node(2, 1, "res://e", 2), node(2, 2, "res://e", 1), node(1, 0, "res://g", identity=None), node(2, 1, "res://g", identity="{}"), node(1, 0, None), node(None, 0, "res://z"),
    ]
    edges = [edge(1, 0, "x", None), edge(2, 1, "x", 1.0 + 1e-9), edge(1, 0, "y", 0.5), edge(2, 1, "y", 0.6), edge(1, 0, "w", resolved=None), edge(2, 1, "w", resolved=False)]
    assert changes(spark, nodes, edges) == {("node", 2, "res://old", "removed"), ("node", 2, "res://new", "added"), ("edge", 2, "y", "changed")}


def test_a_gap_in_the_numbers_is_no_empty_snapshot(spark):
    nodes = [node(n, 0, "res://a") for n in (1, 2, 4)] + [node(4, 0, "res://b")]
    assert changes(spark, nodes, []) == {("node", 4, "res://b", "added")}


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [edge(1, 0, "x", 0.9), edge(2, 1, "x", 0.2), edge(2, 1, "x", 0.9)]
    assert changes(spark, [], rows) == changes(spark, [], rows[::-1]) == set()


def test_one_snapshot_and_none(spark):
    assert changes(spark, [node(1, 0, "res://a")], []) == set() == changes(spark, [], [])


def test_hot_keys(spark):
    kind = "edge_id long, type string, origin string, observed_at timestamp_ntz, loaded_at timestamp_ntz, source_id string, target_id string, endpoint string"
    rows = [(i, "calls", "code", T[i % 9], T[0], f"res://s{i}", "class:Node" if i < 30 else None if i < 40 else f"res://t{i}", "clash") for i in range(100)]
    rows += [(0, "calls", "code", T[8], T[1], "res://s0", "class:Other", "clash"), (1, "calls", "code", T[1], T[0], "res://s1", " class:Node", "clash")]
    states = hotkeys.endpoint_states(spark.createDataFrame(rows, kind))
    totals = {(r["endpoint"], r["key_id"]): r["n_edges"] for r in hotkeys.key_totals(states).collect()}
    assert totals["target", "class:Node"] == 29 and totals["target", None] == 10 and totals["target", "class:Other"] == 1 and len(totals) == 100 + 63
    assert {tuple(r) for r in hotkeys.heavy_endpoints(states).collect()} == {("target", "class:Node")}
    assert hotkeys.heavy_endpoints(hotkeys.endpoint_states(spark.createDataFrame([], kind))).count() == 0
