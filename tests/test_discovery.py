from pyspark.sql import functions as F

from weftgraph.operators import documents
from weftgraph.project import EDGE_SCHEMA, NODE_SCHEMA, Project
from weftgraph.sources import discovery


def test_settings_lines(spark):
    text = '[autoload]\r\nA="*res://a.gd"\n  B="res://b.gd"\n; C="x"\nD = "*b/../d.gd"\n[input]\njump={\n"deadzone": 0.5\n}\n[ odd ]\nconfig/features=PackedStringArray("Mobile", "4.2.1")\nrun/main_scene="m.tscn"\n[layer_names]\n2d_physics/layer_1="a"\n2d_physics/layer_1="b"\n2d_physics/layer_x="c"\n'
    lines = discovery.settings_lines(spark.createDataFrame([("p", text), ("q", ""), ("r", None)], "project string, content string"))
    got = {(r["section"], r["key"], r["value"]) for r in lines.where("section = 'autoload'").collect()}
    assert got == {("autoload", "A", '"*res://a.gd"'), ("autoload", "D", '"*b/../d.gd"')}
    about = {r["project"]: (r["version"], r["main_scene"]) for r in discovery.project_facts(lines).collect()}
    assert about == {"p": ("4.2.1", "res://m.tscn")}
    n = {r["id"]: r["identity"] for r in discovery.concept_nodes(lines).collect()}
    assert n == {"autoload:A": '{"name":"A","path":"res://a.gd","enabled":true}', "autoload:D": '{"name":"D","path":"res://d.gd","enabled":true}', "action:jump": '{"name":"jump"}', "layer:1": '{"index":1,"names":{"2d_physics":"b"}}'}


def test_ignoring(spark):
    paths = ["a.gd", ".godot/x", "x/.git/y", "addons/a/b.gd", "lib/gen/a.gd", "lib/gen/deep/a.gd", "libs/a.gd", "a.tmp"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    left = lambda globs: [r["p"] for r in df.where(~discovery.is_ignored("p", globs)).collect()]
    assert left([]) == ["a.gd", "addons/a/b.gd", "lib/gen/a.gd", "lib/gen/deep/a.gd", "libs/a.gd", "a.tmp"]
    assert left(["addons", "lib/gen", "*.tmp", "[bad"]) == ["a.gd", "libs/a.gd"]
    assert left(["addons/**", "lib/*/a.gd"]) == ["a.gd", "lib/gen/deep/a.gd", "libs/a.gd", "a.tmp"]


def test_kinds(spark):
    df = spark.createDataFrame([("res://A.GD",), ("res://a.b/c",), ("res://x.res",), ("res://x.png.import",), ("res://plugin.cfg",), ("res://other.cfg",), ("res://project.godot",), (None,)], "p string")
    assert [r[0] for r in df.select(discovery.kind_of("p")).collect()] == ["script", None, "resource", "import", "plugin", None, None, None]


def test_uids(spark):
    files = [
        ("res://a.tscn", "﻿\n; c\n[gd_scene uid=\"uid://a\"]\n"), ("res://b.tres", "[gd_resource]\n[x uid=\"uid://late\"]"), ("res://c.tscn", None), ("res://i.png.import", 'x\nuid="uid://i"\nsource_file="res://i.png"\nuid="uid://j"'), ("res://k.png.import", 'uid="uid://k"'),
        ("res://d.tscn", "[gd_scene uid=\"uid://i\"]"),
    ]
    df = spark.createDataFrame([(p, c, False) for p, c in files], "path string, content string, binary boolean")
    assert {r["path"]: r["uid"] for r in discovery.header_uids(df).collect()} == {"res://a.tscn": "uid://a", "res://b.tres": None, "res://c.tscn": None, "res://d.tscn": "uid://i"}
    assert {r["uid"]: r["path"] for r in discovery.uid_map(df).collect()} == {"uid://a": "res://a.tscn", "uid://i": "res://i.png"}


def test_root(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert discovery.find_root(str(tmp_path / "a")) == str(tmp_path / "a")
    (tmp_path / "project.godot").write_text("")
    assert discovery.find_root(str(tmp_path / "a" / "b")) == str(tmp_path)
    assert discovery.load_settings(str(tmp_path)) == {}


def test_documents(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("---\ntype: system\ndomain: r\ncovers:\n  - res://r/./a.gd\n  - uid://u\n  - class:Gone\n---\ntext\n")
    (tmp_path / "docs" / "b.md").write_text("no head")
    (tmp_path / "docs" / "c.md").write_text("---\ntype: [\n---\n")
    (tmp_path / "docs" / "d.md").write_text("---\ntype: poem\n---\n")
    listed = discovery.list_files(spark, str(tmp_path))
    nodes = spark.createDataFrame([("res://r/a.gd", "script", None, None, None, None), ("res://r/u.tres", "resource", None, None, None, None)], NODE_SCHEMA)
    empty = Project(nodes, spark.createDataFrame([], EDGE_SCHEMA), spark.createDataFrame([], "x int"))
    uids = spark.createDataFrame([("uid://u", "res://r/u.tres")], "uid string, path string")
    p = documents.with_documents(empty, documents.read(listed, ["docs/**"]), uids)
    assert {(r["target_id"], r["resolved"], r["ev_line"]) for r in p.edges.collect()} == {("res://r/a.gd", True, 5), ("res://r/u.tres", True, 6), ("class:Gone", False, 7)}
    problems = {r["id"]: r["x"] for r in p.nodes.where("kind = 'doc'").select("id", F.get_json_object("identity", "$.problem").alias("x")).collect()}
    assert problems == {"docs/a.md": None, "docs/b.md": "no frontmatter", "docs/c.md": "frontmatter is not valid YAML", "docs/d.md": "unknown type 'poem'"}
