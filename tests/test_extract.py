"""A project written here, from its files to nodes, edges, boundary points and findings."""

import json

import pytest

from weftgraph.__main__ import run
from weftgraph.analyze import analyze, rule_settings
from weftgraph.operators import integrity
from weftgraph.sources import script_facts, section_facts

SETTINGS = """; a comment
config_version=5

[application]

config/name="Harbour"
run/main_scene="res://world/dock.tscn"
config/features=PackedStringArray("4.3", "Mobile")

[autoload]

Tide="*res://auto/tide.gd"
Log="res://auto/log.gd"

[input]

row={
"deadzone": 0.4,
"events": [Object(InputEventKey,"keycode":32)
]
}
anchor={
"events": []
}

[layer_names]

2d_physics/layer_1="water"
3d_render/layer_1="sky"
2d_physics/layer_2="quay"

[global_group]

crew="all hands"
"""
DOCK = """[gd_scene load_steps=4 format=3 uid="uid://dock1"]

[ext_resource type="Script" path="res://boats/boat.gd" id="1_boat"]
[ext_resource type="PackedScene" uid="uid://buoy1" id="2_buoy"]
[ext_resource type="Texture2D" path="res://art//sail.png" id="3_sail"]
[ext_resource type="ShaderMaterial" path="res://fx/foam.tres" id="4_foam"]

[sub_resource type="AtlasTexture" id="s1"]
atlas = ExtResource("3_sail")
[sub_resource type="Animation" id="s2"]
tracks/0/path = NodePath("Hull:rotation")

[node name="Dock" type="Node2D"]
script = ExtResource("1_boat")
draft = 2.5
crew_size = "many"
collision_layer = 5

[node name="Hull" type="Sprite2D" parent="." groups=["crew", "wet"]]
texture = ExtResource("3_sail")
layers = [ExtResource("4_foam"), {"goal": NodePath("../Mast")}]

[node name="Rope" type="Line2D" parent="Hull"]

[node name="Buoy" parent="." instance=ExtResource("2_buoy")]

[connection signal="ready" from="Hull" to="." method="_on_hull_ready" flags=3]
[connection signal="gone" from="Nowhere" to="Hull" method="sink"]

[editable path="Buoy"]
"""
BUOY = '[gd_scene format=3 uid="uid://buoy1"]\n\n[node name="Buoy" type="Area2D"]\n'
FOAM = '[gd_resource type="ShaderMaterial" format=3 uid="uid://foam1"]\n\n[ext_resource type="Shader" path="res://fx/foam.gdshader" id="1"]\n\n[resource]\nshader = ExtResource("1")\n'
SAIL_IMPORT = '[remap]\n\nimporter="texture"\ntype="CompressedTexture2D"\nuid="uid://sail1"\n\n[deps]\n\nsource_file="res://art/sail.png"\n'
BOAT = '''class_name Boat
extends "res://boats/hull.gd"

signal launched(from, to)
const FLAG = preload("res://art/sail.png")
enum Mode { IDLE, SAIL }
@export var draft: float = 1.0
@export_range(0, 9)
var crew_size: int = 3
@onready var mast = $"Hull/Mast"
var tide_line: Area2D

class Oar:
	func pull(): pass

func _ready() -> void:
	add_to_group("crew")
	launched.connect(_on_launched)
	tide_line.entered.connect(_on_launched)
	Tide.rise()
	Tide.fall()

func _on_launched(a, b) -> void:
	emit_signal("launched", a, b)
	self.launched.emit(a, b)
	if Input.is_action_just_pressed("row") and a or b:
		for i in 3:
			steer(i if i else 1)
	elif Input.is_action_pressed("dive"):
		get_tree().change_scene_to_file("res://world/" + a)
	match a:
		1: pass
		_: pass

func steer(n: int = 0):
	load("res://world/buoy.tscn")
	load(path_of(n))
	get_tree().call_group("crew", "wave")
	get_tree().call_group_flags(2, "gulls", "cry")
	get_node_or_null("../Lamp").show()
	get_node(where)
	rpc_id(1, "ping")
	FileAccess.open("user://log.txt", FileAccess.READ)
	DirAccess.get_files_at(root)
	%Wheel.turn()

@rpc("any_peer")
static func ping(): steer()
func wave(): pass
'''
FILES = {
    "project.godot": SETTINGS, "world/dock.tscn": DOCK, "world/buoy.tscn": BUOY, "fx/foam.tres": FOAM, "fx/foam.gdshader": "", "art/sail.png": "", "art/sail.png.import": SAIL_IMPORT,
    "boats/boat.gd": BOAT, "boats/hull.gd": "extends Node2D\nfunc _process(d):\n\tpass\n", "auto/tide.gd": "extends Node\n", "auto/log.gd": "extends Node\nfunc (:\n", "world/old.scn": "RSRC\0\0", "notes.txt": "x",
    ".godot/cache.gd": "extends Node\n", "addons/kit/plugin.cfg": '[plugin]\n\nname="Kit"\nscript="kit.gd"\n', "addons/kit/kit.gd": "extends Node\n", "junk/a.gd": "extends Node\n", "lib/x.gdextension": '[configuration]\n\nentry_symbol = "go"\ncompatibility_minimum = "4.1"\n',
    "weftgraph.yml": 'ignore: ["junk", "[bad"]\nrules:\n  orphan_asset: {enabled: false}\n  unused_group: {severity: warning}\nsuppress:\n  - {rule: unused_action, node: "action:anchor"}\n',
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("harbour")
    for name, text in FILES.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def project(spark, folder):
    return analyze(spark, f"{folder}/world")  # the root is found from below


def nodes(p):
    return {r["id"]: (r["kind"], r["line"], json.loads(r["identity"] or "{}"), json.loads(r["properties"] or "{}")) for r in p.nodes.collect()}


def edges(p, kind):
    rows = p.edges.where(f"type = '{kind}'").collect()
    return sorted((r["source_id"], r["target_id"], r["origin"], r["resolved"], r["ev_line"], json.dumps(json.loads(r["properties"] or "{}"), sort_keys=True)) for r in rows)


def line_of(text, start):
    """The line of a text that begins with ``start`` (white space aside)."""
    return next(i + 1 for i, x in enumerate(text.split("\n")) if x.strip().startswith(start))


def points(p, kind):
    return sorted((r["direction"], r["node_id"], r["match_key"], r["ev_line"]) for r in p.boundaries.where(f"type = '{kind}'").collect())


def test_files_and_settings(project):
    n = nodes(project)
    files = {k: v[0] for k, v in n.items() if k.startswith("res://") and "::" not in k}
    assert files == {
        "res://world/dock.tscn": "scene", "res://world/buoy.tscn": "scene", "res://world/old.scn": "scene", "res://fx/foam.tres": "resource", "res://fx/foam.gdshader": "asset", "res://art/sail.png": "asset", "res://boats/boat.gd": "script",
        "res://boats/hull.gd": "script", "res://auto/tide.gd": "script", "res://auto/log.gd": "script", "res://addons/kit/kit.gd": "script", "res://lib/x.gdextension": "extension",
    }
    assert n["autoload:Tide"][2] == {"name": "Tide", "path": "res://auto/tide.gd", "enabled": True} and n["autoload:Log"][2]["enabled"] is False
    assert {k for k in n if k.startswith("action:")} == {"action:row", "action:anchor"} and n["group:crew"][2]["predeclared"] is True
    assert n["layer:1"][2] == {"index": 1, "names": {"2d_physics": "water", "3d_render": "sky"}} and n["layer:2"][2]["names"] == {"2d_physics": "quay"}
    assert n["res://world/dock.tscn"][2] == {"main_scene": True} and n["res://art/sail.png"][2] == {"import": "res://art/sail.png.import"}
    assert n["res://addons/kit/kit.gd"][2] == {"extends": "Node", "editor_plugin": True} and n["res://lib/x.gdextension"][2] == {"entry_symbol": "go", "compatibility_minimum": "4.1"}
    assert {r["key"]: r["value"] for r in project.meta.collect()} == {"version": "4.3", "main_scene": "res://world/dock.tscn", "root": "res://"}
    assert sorted((r["file"], r["source"]) for r in project.diagnostics.collect()) == [("res://auto/log.gd", "gdscript"), ("res://world/old.scn", "scene")]


def test_scene(project):
    n = nodes(project)
    d = "res://world/dock.tscn"
    assert n[f"{d}::."] == ("scene_node", line_of(DOCK, '[node name="Dock"'), {"name": "Dock", "scene": d, "node_type": "Node2D", "root": True, "script": "res://boats/boat.gd"}, {})
    assert n[f"{d}::Hull/Rope"][2] == {"name": "Rope", "scene": d, "node_type": "Line2D", "parent": "Hull"}
    assert n[f"{d}::Buoy"][2]["instance"] == "res://world/buoy.tscn"  # by uid
    assert edges(project, "attaches_script") == [(f"{d}::.", "res://boats/boat.gd", "editor", True, line_of(DOCK, "script ="), "{}")]
    assert edges(project, "instances") == [(d, "res://world/buoy.tscn", "editor", True, line_of(DOCK, '[node name="Buoy"'), '{"editable": true, "node": "Buoy"}')]
    assert [(s, t) for s, t, o, *_ in edges(project, "in_group") if o == "editor"] == [(f"{d}::Hull", "group:crew"), (f"{d}::Hull", "group:wet")]
    assert [e for e in edges(project, "references_node") if e[2] == "editor" and "::" in e[0]] == [(f"{d}::Hull", "nodepath:../Mast", "editor", False, line_of(DOCK, "layers ="), '{"path": "../Mast", "property": "layers"}')]
    assert [(s, t) for s, t, *_ in edges(project, "animates")] == [(d, "nodepath:Hull")] and [(s, t) for s, t, *_ in edges(project, "uses_layer")] == [(f"{d}::.", "layer:1"), (f"{d}::.", "layer:3")]
    assert [(s, t) for s, t, *_ in edges(project, "uses_asset")] == [(d, "res://art/sail.png")] * 2
    assert [(s, t) for s, t, *_ in edges(project, "uses_material")] == [(d, "res://fx/foam.tres")] and [(s, t) for s, t, *_ in edges(project, "uses_shader")] == [("res://fx/foam.tres", "res://fx/foam.gdshader")]
    assert edges(project, "imports") == [("res://art/sail.png", "res://art/sail.png.import", "config", True, 0, '{"importer": "texture", "type": "CompressedTexture2D"}')]
    assert [(p[1], p[2]) for p in points(project, "group_target")] == [("res://boats/boat.gd::wave", "group:crew")]
    got = [e for e in edges(project, "connects_signal") if e[2] == "editor"]
    assert [(s, t, r) for s, t, _, r, *_ in got] == [(f"{d}::Hull", "res://boats/boat.gd::_on_hull_ready", True), (f"{d}::Nowhere", "signal:*:gone", False)]
    assert json.loads(got[0][5])["flags"] == 3 and "flags" not in json.loads(got[1][5])
    assert points(project, "editor_connection") == [("ingress", "", "signal:*:gone", line_of(DOCK, '[connection signal="gone"')), ("ingress", "res://boats/boat.gd::_on_hull_ready", "signal:Sprite2D:ready", line_of(DOCK, '[connection signal="ready"'))]


def test_script(project):
    n = nodes(project)
    b = "res://boats/boat.gd"
    assert n[b][2] == {"extends_path": "res://boats/hull.gd", "class_name": "Boat", "is_class_name": True, "consts": ["FLAG"], "enums": ["Mode"], "exports": ["draft", "crew_size"], "onready": ["mast"], "inner_classes": ["Oar"]}
    assert n["class:Boat"][2] == {"name": "Boat", "script": b} and n["class:Node2D"][2] == {"name": "Node2D"}
    assert n[f"{b}::signal:launched"][2] == {"name": "launched", "params": ["from", "to"], "script": b}
    assert n[f"{b}::_on_launched"][2] == {"name": "_on_launched", "arity": 2, "static": False, "virtual": False, "return_type": "void"}
    # 1, if, elif, for, and, or, conditional expression, two arms
    assert n[f"{b}::_on_launched"][3] == {"complexity": 9} and n[f"{b}::steer"][3] == {"complexity": 1}
    assert n[f"{b}::ping"][2]["static"] is True and n[f"{b}::ping"][2]["rpc"] is True and n[f"{b}::_ready"][2]["virtual"] is True and f"{b}::pull" in n
    assert (b, "res://boats/hull.gd", "code", True, 2, "{}") in edges(project, "extends") and ("res://boats/hull.gd", "class:Node2D", "code", False, 1, "{}") in edges(project, "extends")
    assert [(t, p) for _, t, _, _, _, p in edges(project, "exports_var")] == [(f"{b}::crew_size", '{"type": "int", "var": "crew_size"}'), (f"{b}::draft", '{"type": "float", "var": "draft"}')]
    assert edges(project, "rpc_endpoint") == [(f"{b}::ping", "rpc:Boat:ping", "code", False, line_of(BOAT, "static func ping"), "{}")] and [t for _, t, *_ in edges(project, "rpc_call")] == ["rpc:*:ping"]
    assert [(s, t) for s, t, *_ in edges(project, "emits_signal")] == [(f"{b}::_on_launched", "signal:*:launched"), (f"{b}::_on_launched", "signal:Boat:launched")]
    assert [t for _, t, o, *_ in edges(project, "connects_signal") if o == "code"] == ["signal:*:launched", "signal:Area2D:entered"]
    assert [(t, r) for _, t, _, r, *_ in edges(project, "loads_resource")] == [("res:res://art/sail.png", True), ("path_of(n)", False), ("res:res://world/buoy.tscn", True)]
    assert [(t, r, p) for _, t, _, r, _, p in edges(project, "changes_scene_to")] == [('"res://world/" + a', False, '{"dynamic": true, "expr": "\\"res://world/\\" + a"}')]
    assert [t for _, t, o, *_ in edges(project, "references_node") if o == "code"] == ["nodepath:Hull/Mast", "nodepath:%Wheel", "nodepath:../Lamp", "nodepath:where"]
    assert [(s, t) for s, t, o, *_ in edges(project, "in_group") if o == "code"] == [(b, "group:crew")] and [t for _, t, *_ in edges(project, "calls_group")] == ["group:crew", "group:gulls"]
    assert [t for _, t, *_ in edges(project, "uses_action")] == ["action:dive", "action:row"]
    assert [(s, t) for s, t, *_ in edges(project, "calls")] == [(f"{b}::_on_launched", f"{b}::steer"), (f"{b}::ping", f"{b}::steer")]
    assert edges(project, "accesses_autoload") == [(f"{b}::_ready", "autoload:Tide", "code", True, line_of(BOAT, "Tide.rise"), "{}")]  # once
    io = project.boundaries.where("type = 'file_io'").collect()
    assert sorted((r["match_key"] or "", r["ev_line"]) for r in io) == [("", line_of(BOAT, "DirAccess")), ("res:user://log.txt", line_of(BOAT, "FileAccess"))]
    assert [p[1] for p in points(project, "lifecycle")] == [f"{b}::_ready", "res://boats/hull.gd::_process"] and [p[1] for p in points(project, "signal_handler")] == [f"{b}::_on_launched"]


def test_findings(spark, project, folder):
    s = rule_settings(folder)
    assert s.disabled == {"orphan_asset"} and s.severity == {"unused_group": "warning"} and s.suppress == (("unused_action", "action:anchor"),)
    got = {(r["rule"], r["severity"], r["node_id"]) for r in integrity.findings(project, s).collect()}
    b, d = "res://boats/boat.gd", "res://world/dock.tscn"
    assert ("dangling_connection", "error", f"{d}::Hull") in got and ("dangling_connection", "error", f"{d}::Nowhere") in got
    assert ("undefined_action", "error", f"{b}::_on_launched") in got and not any(r == "unused_action" for r, *_ in got)
    assert ("export_type_mismatch", "warning", f"{d}::.") in got and not any(r == "dead_export" for r, *_ in got)
    assert ("empty_group_call", "warning", f"{b}::steer") in got and ("unused_group", "warning", f"{d}::Hull") in got
    assert ("unresolved_load", "info", f"{b}::steer") in got and ("orphan_script", "info", "res://addons/kit/kit.gd") in got and ("per_frame_cost", "info", "res://boats/hull.gd::_process") not in got
    assert {r for r, *_ in got if r.startswith("orphan_scene")} == {"orphan_scene"} and ("orphan_scene", "info", d) not in got


def test_command_line(spark, folder, project, tmp_path, monkeypatch):
    monkeypatch.setattr("weftgraph.analyze.analyze", lambda *_: project)
    out: list[str] = []
    go = lambda *a: run(list(a), out.append, spark)
    db = str(tmp_path / "db")
    assert go("stats", "--db", db) == 1 and "no project" in out[-1]
    assert go("analyze", folder, "--db", db) == 0 and "(engine 4.3)" in out[-1]
    assert go("stats", "--db", db, "--json", "--top", "1") == 0
    view = json.loads(out[-1])
    assert len(view["top_fan_in"]) == 1 and view["nodes"] > 20
    assert go("stats", "--db", db, "--json", "--top", "0") == 0 and len(json.loads(out[-1])["top_fan_in"]) > 5
    assert go("graph", "--db", db, "--file", "res://boats/boat.gd::ping", "--json") == 0
    assert [e["peer"] for e in json.loads(out[-1])["outbound"]] == ["res://boats/boat.gd::steer", "rpc:Boat:ping"]
    assert go("graph", "--db", db, "--file", "res://none") == 1
    assert go("check", folder, "--db", db, "--severity", "error", "--exit-code") == 1 and "ERROR" in out[-1] and "INFO " not in out[-1]
    assert go("check", folder, "--db", db, "--rule", "undefined_action", "--json") == 0 and [r["rule"] for r in json.loads(out[-1])] == ["undefined_action"]
    assert go("impact", "--db", db, "--file", "res://boats/boat.gd") == 0 and json.loads(out[-1])["by_kind"]
    assert go("dance") == 2 and go("graph") == 2 and go("--help") == 0


def test_last_declaration_counts_and_broken_texts_give_what_could_be_read():
    assert [f[3] for f in script_facts.facts("func a(): pass\nfunc = 3\nsignal s\n") if f[1] in ("func", "signal")] == ["a", "s"]
    assert script_facts.facts("") == [] and script_facts.facts("\n\n# only a comment") == []
    kinds = [f[1] for f in section_facts.facts('[node name="A" type="B"]\nx = (\n[node name="C" parent="."]\n')]
    assert kinds.count("node") == 2 and "problem" in kinds


def test_facts_of_null_and_empty(spark):
    from weftgraph.operators import extract

    files = spark.createDataFrame([("res://a.gd", None, False), ("res://b.tscn", "", False), (None, "x", False), ("res://c.txt", "x", False)], "path string, content string, binary boolean")
    p = extract.extracted(files)
    assert sorted(nodes(p)) == ["res://a.gd", "res://b.tscn"] and p.edges.count() == p.boundaries.count() == 0
    none = extract.extracted(files.where("false"))
    assert none.nodes.count() == none.edges.count() == 0
