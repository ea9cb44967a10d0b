"""Each rule with a case that fires and one that stays silent."""

import pytest

from weftgraph.operators import integrity, resolve
from weftgraph.project import BOUNDARY_SCHEMA, EDGE_SCHEMA, NODE_SCHEMA, Project

N = [
    ("res://a.gd", "script", None), ("res://lost.gd", "script", None), ("res://a.gd::run", "method", None), ("res://a.gd::_process", "method", None), ("res://a.gd::signal:hit", "signal", None), ("res://a.gd::signal:dull", "signal", None),
    ("res://a.gd::signal:lone", "signal", None), ("action:jump", "action", None), ("action:idle", "action", None), ("res://m.tscn", "scene", '{"main_scene": true}'), ("res://l.tscn", "scene", None), ("res://x.png", "asset", None), ("res://y.png", "asset", None),
    ("res://m.tscn::.", "scene_node", '{"node_type": "Node"}'), ("res://m.tscn::A", "scene_node", None), ("res://m.tscn::A/B", "scene_node", None), ("layer:1", "layer", None), ("layer:2", "layer", None), ("autoload:Bus", "autoload", '{"path": "res://bus.gd"}'), ("res://bus.gd", "script", None),
    ("docs/a.md", "doc", '{"type": "system", "domain": "nowhere"}'), ("docs/b.md", "doc", '{"problem": "no frontmatter"}'),
]
E = [
    ("attaches_script", "res://m.tscn::A", "res://a.gd", "editor", None),
    ("connects_signal", "res://m.tscn::A", "res://a.gd::run", "editor", '{"signal": "hit", "method": "run"}'),
    ("connects_signal", "res://m.tscn::A", "res://a.gd::ran", "editor", '{"signal": "hot", "method": "ran"}'),
    ("emits_signal", "res://a.gd::run", "res://a.gd::signal:lone", "code", None),
    ("exports_var", "res://a.gd", "res://a.gd::speed", "code", '{"type": "int"}'), ("exports_var", "res://a.gd", "res://a.gd::mood", "code", '{"type": "String"}'),
    ("binds_export", "res://m.tscn::A", "res://a.gd::speed", "editor", '{"value_type": "string"}'),
    ("uses_action", "res://a.gd::run", "action:jump", "code", None), ("uses_action", "res://a.gd::run", "action:fly", "code", None),
    ("in_group", "res://a.gd", "group:foes", "code", None), ("in_group", "res://a.gd", "group:idle", "code", None), ("calls_group", "res://a.gd::run", "group:foes", "code", None), ("calls_group", "res://a.gd::run", "group:ghosts", "code", None),
    ("loads_resource", "res://a.gd::run", "res:res://x.png", "code", None), ("loads_resource", "res://a.gd::run", "res:res://none.png", "code", None), ("loads_resource", "res://a.gd::run", "where + 1", "code", '{"dynamic": true}'),
    ("references_node", "res://m.tscn::A", "nodepath:B", "editor", None), ("references_node", "res://m.tscn::A", "nodepath:../../../C", "editor", None), ("references_node", "res://a.gd::run", "nodepath:../A/B", "code", None), ("references_node", "res://a.gd::run", "nodepath:%B", "code", None),
    ("uses_layer", "res://a.gd", "layer:1", "editor", None), ("accesses_autoload", "res://a.gd::run", "autoload:Bus", "code", None), ("documents", "docs/a.md", "res://a.gd", "docs", None), ("documents", "docs/a.md", "class:Gone", "docs", None),
    ("uses_asset", "res://m.tscn", None, "editor", None),
    ("calls", "res://a.gd::_process", "res://a.gd::run", "code", None),
]
FIRES = {
    "dangling_connection": {"res://m.tscn::A"}, "connection_to_missing_signal": {"res://m.tscn::A"}, "dead_export": {"res://a.gd"}, "export_type_mismatch": {"res://m.tscn::A"}, "undefined_action": {"res://a.gd::run"}, "unused_action": {"action:idle"},
    "empty_group_call": {"res://a.gd::run"}, "unused_group": {"res://a.gd"}, "unresolved_load": {"res://a.gd::run"}, "missing_resource": {"res://a.gd::run"}, "unused_signal": {"res://a.gd::signal:dull"}, "unhandled_signal": {"res://a.gd::signal:lone"},
    "fragile_nodepath": {"res://m.tscn::A"}, "nodepath_unresolved": {"res://m.tscn::A"}, "orphan_script": {"res://lost.gd"}, "orphan_scene": {"res://l.tscn"}, "orphan_asset": {"res://y.png"}, "orphan_layer": {"layer:2"}, "per_frame_cost": {"res://a.gd::_process"},
    "large_scene": {"res://m.tscn"}, "doc_broken_anchor": {"docs/a.md"}, "doc_malformed_frontmatter": {"docs/b.md"}, "doc_unknown_domain": {"docs/a.md"}, "doc_uncovered_entity": {"autoload:Bus"},
}


@pytest.fixture(scope="module")
def project(spark):
    nodes = [(i, k, i.split("::")[0] if i.startswith("res://") else None, 1, j, None) for i, k, j in N]
    edges = [(n, t, s, x, o, False, 1.0, s.split("::")[0], n, p) for n, (t, s, x, o, p) in enumerate(E)]
    return integrity.materialised(Project(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA), spark.createDataFrame([], BOUNDARY_SCHEMA)))


def test_every_rule_is_tested():
    assert set(FIRES) == set(integrity.RULES)


@pytest.fixture(scope="module")
def found(project):
    return integrity.findings(project, integrity.Settings(large_scene=2, fan_in=1)).collect()


@pytest.mark.parametrize("rule", sorted(FIRES))
def test_rule(found, rule):
    rows = [r for r in found if r["rule"] == rule]
    assert {r["node_id"] for r in rows} == FIRES[rule]
    assert len(rows) == 1 or rule == "nodepath_unresolved"


def test_no_rule_fires_on_nothing(spark):
    empty = Project(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA), spark.createDataFrame([], BOUNDARY_SCHEMA))
    assert integrity.findings(empty).count() == 0
    assert integrity.findings(empty, only=("no_such_rule",)).count() == 0


def test_settings_and_order(project):
    s = integrity.Settings(disabled=frozenset(["orphan_asset"]), severity={"orphan_scene": "error"}, suppress=(("orphan_script", "res://lost.gd"),), entry_scenes=("res://none.tscn",))
    rows = integrity.ordered(integrity.findings(project, s, ("orphan_asset", "orphan_script", "orphan_scene", "undefined_action", "unused_action"))).collect()
    assert [integrity.SEVERITIES.index(r["severity"]) for r in rows] == sorted(integrity.SEVERITIES.index(r["severity"]) for r in rows)
    rules = {r["rule"]: r["severity"] for r in rows}
    assert "orphan_asset" not in rules and "orphan_script" not in rules and rules["orphan_scene"] == "error"


def test_suggestions(project):
    found = integrity.findings(project, only=("dangling_connection", "connection_to_missing_signal"))
    got = {r["want"]: (r["suggestion"], r["distance"]) for r in integrity.suggestions(project, found).collect()}
    assert got == {"res://a.gd::ran": ("run", 1), "res://a.gd::signal:hot": ("hit", 1)}


def test_node_paths(project):
    got = {r["path"]: (r["n_owners"], r["target_id"], r["reason"]) for r in resolve.node_paths(project).collect()}
    assert got == {
        "B": (1, "res://m.tscn::A/B", None), "../../../C": (1, None, "nodepath_unresolved"), "../A/B": (1, "res://m.tscn::A/B", None), "%B": (1, "res://m.tscn::A/B", None),
    }


def test_stitching(spark, project):
    rows = [
        (1, "egress", "signal_emit", "m1", "signal:Hero:fell"), (2, "egress", "signal_emit", "m2", "signal:*:fell"), (3, "egress", "rpc_call", "m3", "rpc:*:ping"), (4, "egress", "file_io", "m4", "res:user://x"), (5, "egress", "node_reach", "m5", None),
        (6, "ingress", "signal_handler", "h1", "signal:Hero:fell"), (7, "ingress", "signal_handler", "h2", "signal:*:fell"), (8, "ingress", "rpc_endpoint", "h3", "rpc:Hero:ping"), (9, "egress", "signal_emit", "m6", "signal:Foe:fell"), (10, "ingress", "signal_handler", "h0", "signal:Hero:fell"),
    ]
    b = spark.createDataFrame([(*r, None, None, None) for r in rows], BOUNDARY_SCHEMA)
    got = {r["boundary_id"]: (r["strategy"], r["n_partners"], r["partner_id"], r["confidence"]) for r in resolve.stitched(Project(project.nodes, project.edges, b)).collect()}
    assert got == {1: ("exact", 2, "h0", 1.0), 2: ("exact", 1, "h2", 1.0), 3: ("variant", 1, "h3", 0.7), 4: ("none", 0, None, 0.0), 9: ("variant", 1, "h2", 0.7)}


def test_hints_explain_dynamic_loads(spark, project):
    n = [(f"res://levels/level_{i}.tscn", "scene", None, None, None, None) for i in (1, 2)] + [("res://levels/deep/level_3.tscn", "scene", None, None, None, None)]
    e = [
        (1, "changes_scene_to", "a", "x", "code", False, 0.5, "f", 3, '{"dynamic": true, "expr": "\\"level_%d\\" % n"}'), (2, "loads_resource", "a", "y", "code", False, 0.5, "f", 4, '{"dynamic": true, "expr": "other"}'), (3, "loads_resource", "a", "res:res://levels/level_1.tscn", "code", True, 1.0, "f", 5, None),
    ]
    p = Project(spark.createDataFrame(n, NODE_SCHEMA), spark.createDataFrame(e, EDGE_SCHEMA), spark.createDataFrame([], BOUNDARY_SCHEMA))
    got = resolve.hinted(p, {"level_%d": "res://levels/level_*.tscn", "bad": "[x"}).edges.where("confidence = 0.7").collect()
    assert {(r["type"], r["target_id"], r["ev_line"]) for r in got} == {("changes_scene_to", f"res:res://levels/level_{i}.tscn", 3) for i in (1, 2)}
    assert resolve.hinted(p, {}) is p
