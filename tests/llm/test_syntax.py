import json

import pytest

import __spark_entry__
from weftgraph.llm.syntax import check

GD = """extends "res://a/b.gd"
class_name Foo
signal hit(amount, at)
@export var speed: float = 3.5
@onready var body = $Body/Sprite2D
enum Mode { A, B = 2, }
const HELP = \"\"\"
<<<<<<< left ( [ {
\"\"\"
var table = {
\t"a": [1, 9],
}
# <<<<<<< not a marker

func run(at: Vector2, n: int = 3) -> int:
\tvar total = 2 + \\
\t\t9
\tvar f = func(x): return x * 3
\tEventBus.hit.emit(self)
\tfor i in range(4):
\t\tprint("x", i)
\tif n > 3 and not at in [1]:
\t\tqueue_free()
\telif n:
\t\tpass
\telse:
\t\tself.speed += 1.0 if n else 2.0
\tmatch n:
\t\t0:
\t\t\treturn 1
\t\t_:
\t\t\tpass
\treturn 0
"""
TSCN = """[gd_scene load_steps=2 format=3 uid="uid://x"]

[ext_resource type="Texture2D" path="res://a.png" id="1_a"]
; a comment
[node name="Root" type="Node2D" groups=["a", "b"] instance=ExtResource("1_a")]
position = Vector2(-6, 5.1)
metadata/label = "several
lines and a \\"quote\\" ]"
keys = {
"times": PackedFloat32Array(0, 0.7),
&"loop": false
}
typed = Array[int]([1, 2])
"""
IMPORT = '[remap]\n\nimporter="texture"\n\n[deps]\n\ndest_files=["res://a.ctex"]\n\n[params]\n\ncompress/mode=0\nextra={"tag": "x", "sizes": [9, 7]}\n'
JSON = '{"a": [1, -2.5e3, null, true], "b": {"c": "x \\u00e9 // ] <<<<<<<"}, "d": []}\n'
VALID = {"gd": GD, "tscn": TSCN, "tres": TSCN, "import": IMPORT, "json": JSON}

BROKEN = [
    ("gd", "func f()\n\tpass\n"),
    ("gd", "func f():\nreturn 3\n"),
    ("gd", "func f():\n\tvar q = 3]\n"),
    ("gd", 'const T := "abc\nvar x = 1\n'),
    ("gd", "func f():\n\tvar rest = 4 +\n"),
    ("gd", "<<<<<<< HEAD\nvar a = 1\n"),
    ("gd", TSCN),
    ("tscn", GD),
    ("tscn", '[node name="A"\nposition = Vector2(1, 2)\n'),
    ("tscn", '[node name="A"]\nmode = ]\n'),
    ("tscn", '[node name="A"]\nlabel = "open\n'),
    ("tscn", "[node name=]\n"),
    ("tres", "[resource]\nscale = Vector2(2, 2\n"),
    ("tres", "position = 3\n[resource]\n"),
    ("tres", "[resource]\nname\n"),
    ("import", "[remap\n\nimporter=\"a\"\n"),
    ("import", '[remap]\n\ndest=["a"\n'),
    ("json", '{"a": 1,}'),
    ("json", "{name: 1}"),
    ("json", '{"a" 3}'),
    ("json", '{"a": 01}'),
    ("json", "{}{}"),
    ("json", '{"a": NaN}'),
    ("json", '{"a": "x\ny"}'),
]


@pytest.mark.parametrize("ext", VALID)
def test_valid_texts_have_no_problems(ext):
    for text in (VALID[ext], "﻿" + VALID[ext], VALID[ext].replace("\n", "\r\n"), VALID[ext].rstrip("\n"), "", None):
        assert check(f"res://r/x.{ext}", text)[1] == []


@pytest.mark.parametrize("ext,text", BROKEN)
def test_broken_texts_have_problems(ext, text):
    assert check(f"res://r/x.{ext}", text)[1]


@pytest.mark.parametrize("ext", VALID)
def test_every_cut_text_ends(ext):
    for n in range(len(VALID[ext])):
        check(f"x.{ext}", VALID[ext][:n])
        check(f"x.{ext}", VALID[ext][n:])


def test_json_agrees_with_the_standard_library_on_cut_texts():
    for n in range(1, len(JSON)):
        try:
            json.loads(JSON[:n])
            good = True
        except ValueError:
            good = False
        assert (check("x.json", JSON[:n])[1] == []) == good


def test_deep_nesting_is_no_problem():
    n = 5000
    assert check("x.gd", f"var a = {'(' * n}1{')' * n}\n")[1] == []
    assert check("x.json", "[" * n + "]" * n)[1] == []
    assert check("x.tres", f"[resource]\na = {'[' * n}{']' * n}\n")[1] == []


def test_several_errors_are_kept():
    assert len(check("x.gd", "func f()\n\tpass\nvar = 3\nvar x = \n")[1]) >= 3
    assert len(check("x.json", '{"a" 1, "b": , "c": 3}')[1]) == 2


def test_queries(spark, tmp_path):
    rows = [(1, "r", "res://r/a.gd", GD), (2, "r", "res://r/b.gd", "func f()\n"), (3, None, "res://r/c.json", "{"), (4, "r", "res://r/d.svg.import", IMPORT), (5, "r", "res://r/e.gd", None), (6, "r", None, "{"), (7, "r", "res://r/f.TSCN", "x")]
    spark.createDataFrame(rows, "file_id long, repo string, path string, content string").write.parquet(f"{tmp_path}/source_files.parquet")
    q = __spark_entry__.queries()
    assert sorted(r[0] for r in q["p5_found"](spark, str(tmp_path)).collect()) == [2, 3, 7]
    assert {tuple(r) for r in q["p5_rates"](spark, str(tmp_path)).collect()} == {("r", "gdscript", 3, 1, 0.333333), (None, "json", 1, 1, 1.0), ("r", "import", 1, 0, 0.0), ("r", None, 1, 0, 0.0), ("r", "tscn", 1, 1, 1.0)}
    assert {r["language"]: r["n_accepted"] for r in q["p5_acceptance"](spark, str(tmp_path)).collect()} == {"gdscript": 2, "json": 0, "import": 1, None: 1, "tscn": 0}
    files = {r["file_id"]: r for r in q["p5_files"](spark, str(tmp_path)).collect()}
    assert len(files) == 7 and files[2]["first_line"] == 1 and files[2]["errors"][0]["message"] == files[2]["first_message"]
