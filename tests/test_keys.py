import pytest
from pyspark.sql import functions as F

from weftgraph.functions import globs, keys


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


PATHS = {
    "": "", " \t ": "", "a.gd": "res://a.gd", "res://a.gd": "res://a.gd", " res://a//b.gd\n": "res://a/b.gd", "./a/../b.tres": "res://b.tres", "../../x.gd": "res://x.gd", "user://save//a.dat": "user://save/a.dat",
    "uid://abc": "uid://abc", "res://A/b.GD": "res://A/b.GD", "/a/b": "res://a/b",
}


def test_paths_and_their_idempotence(spark):
    df = spark.createDataFrame([(k, v) for k, v in PATHS.items()], "p string, want string")
    rows = df.select("p", "want", keys.normalize_path("p").alias("once"), keys.normalize_path(keys.normalize_path("p")).alias("twice")).collect()
    for r in rows:
        assert r["once"] == r["want"] == r["twice"], r["p"]
    assert value(spark, keys.normalize_path(F.lit(None).cast("string"))) is None


def test_match_keys(spark):
    lit = F.lit
    cases = [
        (keys.signal_key(lit("Hero"), lit("fell")), "signal:Hero:fell"), (keys.signal_key(lit(""), lit("fell")), "signal:*:fell"), (keys.signal_key(lit(" Hero "), lit(" fell ")), "signal:Hero:fell"),
        (keys.resource_key(lit("a.tscn")), "res:res://a.tscn"), (keys.resource_key(lit("res://a//b.tscn")), "res:res://a/b.tscn"), (keys.resource_key(lit("./a/../b")), "res:res://b"), (keys.resource_key(lit("res://x")), "res:res://x"),
        (keys.prefixed("action", lit(" leap ")), "action:leap"), (keys.prefixed("group", lit("foes")), "group:foes"), (keys.prefixed("autoload", lit(" Bus")), "autoload:Bus"),
        (keys.rpc_key(lit("Hero"), lit("hit")), "rpc:Hero:hit"), (keys.rpc_key(lit(""), lit("hit")), "rpc:*:hit"), (keys.prefixed("nodepath", lit("%Hud")), "nodepath:%Hud"), (keys.prefixed("nodepath", lit("../A/B")), "nodepath:../A/B"),
    ]
    for column, want in cases:
        assert value(spark, column) == want


def test_ids(spark):
    lit = F.lit
    cases = [
        (keys.symbol_id(lit("./a.gd"), lit("run")), "res://a.gd::run"), (keys.signal_id(lit("a.gd"), lit("hit")), "res://a.gd::signal:hit"), (keys.scene_node_id(lit("a.tscn"), lit(".")), "res://a.tscn::."),
        (keys.concept_id("class", lit(" Hero")), "class: Hero"), (keys.concept_id("layer", lit(3)), "layer:3"), (keys.extension_id(lit("addons//x.gdextension")), "ext:res://addons/x.gdextension"), (keys.doc_id(lit("  ./docs/a.md ")), "docs/a.md"),
    ]
    for column, want in cases:
        assert value(spark, column) == want
    parts = lambda f, x: (lambda r: tuple(r) if r else None)(value(spark, f(lit(x))))
    assert parts(keys.parse_symbol_id, "res://a.gd::run") == ("res://a.gd", "run")
    assert parts(keys.parse_symbol_id, "res://a.gd::signal:hit") is None and parts(keys.parse_symbol_id, "res://a.tscn::A") is None and parts(keys.parse_symbol_id, "res://a.gd") is None
    assert parts(keys.parse_signal_id, "res://a.gd::signal:hit") == ("res://a.gd", "hit")
    assert parts(keys.parse_scene_node_id, "res://a.scn::A/B") == ("res://a.scn", "A/B") and parts(keys.parse_scene_node_id, "res://a.gd::A") is None


def test_canonical_keys(spark):
    cases = {" res://r/./a.gd ": "res://r/a.gd", "res: res://r/a.gd": "res://r/a.gd", "res:res://r//a.gd::run": "res://r/a.gd::run", "res://r/x/../a.tscn::A/./B": "res://r/a.tscn::A/./B", "signal:*:hit\t": "signal:*:hit", "": ""}
    for k, want in cases.items():
        assert value(spark, keys.canonical_key(F.lit(k))) == want, k


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [("*.gd", ["a.gd"], ["a/b.gd", "a.gdx"]), ("addons/*", ["addons/x"], ["addons/x/y", "addons"]), ("addons/**", ["addons/x"], ["addons/x/y"]), ("a?c", ["abc"], ["ac", "a/c"]), ("[a-c]x", ["bx"], ["dx"]), ("[^a]x", ["bx"], ["ax"]), (r"\*", ["*"], ["a"])],
)
def test_globs(glob, yes, no):
    import re

    regex = globs.glob_regex(glob)
    assert all(re.search(regex, x) for x in yes) and not any(re.search(regex, x) for x in no)


def test_malformed_globs_match_nothing():
    assert [globs.glob_regex(g) for g in ("[a", "a\\", "[]", "[a-]")] == [None] * 4
