"""Single constructs that are well-formed, or not, one by one; and that every parse ends."""

import os
import random
import time

import pytest

from weftgraph.llm.syntax import check

GD_GOOD = [
    "a.call(1)", "x = v", "await f()", "super()", "super.run(1)", "x += 1; y -= 2", "if a: pass", "if a:\n\t\tpass\n\telif b: pass\n\telse: pass", "for i in 3: print(i)", "for i: int in [1, 2]:\n\t\tpass", "while true:\n\t\tbreak",
    "match x:\n\t\t1, 2: pass\n\t\t[var a, ..]: pass\n\t\t{\"k\": 1, ..}: pass\n\t\t_ when x > 2: pass", "var f = func(a, b = 2) -> int: return a + b", "var f = func named(): pass", "f(func(): return 1, 2)", "g(func():\n\t\treturn 1\n\t)",
    "return", "return not a in b", "var a: Array[int] = []", "var a: Dictionary[String, int] = {}", "var s := &\"name\"", "var p := ^\"A/B\"", "var n = $A/B", "var n = $\"A b\"", "var n = %Unique", "var n = $/root/Main", "x = a if b else c", "x = a as Node", "x = a is not Node",
    "x = 0xFF + 0b11 + 1_000 + .5 + 1e-3 + 2.", "x = \"a\" 'b'.length()" if False else "x = \"a\".length()", "x = {a = 1, \"b\": 2}", "x = [1, 2,]", "assert(x, \"m\")", "x[0].y.z(1)[2] = 3", "x = -a ** 2", "x = not a and !b or ~c", "breakpoint", "const K = 1",
    "x = (1 +\n\t\t2)", "x = 1 + \\\n\t\t2", "x = \"\"\"a\nb\"\"\"", "print(\"a\", )", "x = preload(\"res://a.gd\").new()", "x = a not in b", "pass;", "x <<= 2", "x = func(): pass",
]
GD_TOP_GOOD = [
    "@tool\nextends Node", "class_name A extends B", "class_name A, \"res://i.svg\"", "extends \"res://a.gd\".Inner", "@export var x = 1", "@export_range(0, 1) var x: float", "@export\nvar x", "@onready var x = $A", "signal a", "signal a(b: int, c)", "enum { A, B = 2, }", "enum E { A }",
    "static var x = 1", "static func f(): pass", "@rpc(\"any_peer\")\nfunc f(): pass", "@abstract\nfunc f()", "class A:\n\tvar x\n\tclass B extends C:\n\t\tpass", "var x: int:\n\tget: return 1\n\tset(v): x = v", "var x = 1:\n\tset = set_x, get = get_x", "func f(a: int = 1, ...rest) -> void:\n\tpass",
    "const A: int = 1", "@warning_ignore(\"x\")\nvar a", "func _init(): super(1)", "# only a comment", "var a = [\n\t1,\n\t2,\n]", "var void_ = 1",
]
GD_BAD = [
    "x = ", "x = 1 +", "f(", "f(1", "x = [1, 2", "x = {\"a\": 1", "x = {\"a\" 1}", "if a\n\t\tpass", "if :\n\t\tpass", "for in x: pass", "for i x: pass", "while: pass", "match x: pass", "match x:\n\t\t1 pass", "var", "var 1 = 2", "var x: = ", "const K", "return return", "x = a if b",
    "x = )", "x = 1 2", "else: pass", "elif a: pass", "func g(): pass", "signal s", "class_name X", "x = \"open", "x = 'open", "x = \"\"\"open", "x = $", "x = a.", "x = a..b", "x == 1 = 2", "1 = x", "f() = 1", "assert x", "x = func(: pass", "x = @", "x = a ? b : c", "<<<<<<< HEAD", "=======", "x = 1;;)", "x = ]",
    "if a: pass else: pass" if False else "if a: else: pass", "x++", "x = not", "await",
]
GD_TOP_BAD = [
    "func f()\n\tpass", "func f():\nvar x", "func (): pass", "func f(a b): pass", "func f(a,: pass", "class :\n\tpass", "class A\n\tpass", "enum E", "enum E { A B }", "extends", "signal", "signal a(", "static x", "x = 1", "print(1)", "if a: pass", "@export", "@", "var x = 1\n\tvar y", "const A :=",
    "using System;", "import os", "def f(): pass", "{}", "[gd_scene]", "func f() ->: pass", "func f():\n\t\tpass\n\tpass\n  \tx = 1",
]
SECTION_GOOD = [
    "a = 1", "a = -1.5e3", "a = true", "a = null", "a = inf", "a = \"x\\\"y\"", "a = \"two\nlines\"", "a = &\"n\"", "a = Vector2(1, -2)", "a = [1, [2], {\"k\": 3}]", "a = {\n\"k\": Color(1, 1, 1, 1),\n}", "a = ExtResource(\"1\")", "a = SubResource(\"x\")", "a/b/c = 1", "metadata/_x = {}", "a = Array[int]([1])",
    "a = PackedStringArray(\"x\", \"y\")", "; comment", "a = NodePath(\"A/B\")", "a = Object(InputEventKey,\"keycode\":32,\"x\":null)", "a = Dictionary[String, int]({\"a\": 1})", "",
]
SECTION_BAD = ["a", "a =", "a = Vector2(1", "a = [1, 2", "a = {\"k\" 1}", "a = {\"k\": }", "a = \"open", "a = word", "a = 1 2", "= 1", "a = )", "a = Vector2(1,)", "[node name=\"x\"", "[node name=]", "[node =1]", "[ ]", "<<<<<<< HEAD", "a = {1}"]
JSON_GOOD = ["{}", "[]", "1", "-0.5e+3", "\"x\\u00e9\\n\"", "true", "null", "[1, {\"a\": []}]", " {\"a\" : 1 } \n", "\"\"", "[[[[]]]]"]
JSON_BAD = ["{", "[1,]", "{\"a\":1,}", "01", "1.", ".5", "+1", "'a'", "{a: 1}", "{\"a\" 1}", "[1 2]", "nul", "NaN", "\"a\nb\"", "\"\\x\"", "{} {}", "// c\n1", "\"open", "[", "]", "True"]


def body(s: str) -> str:
    return f"extends Node\nfunc f():\n\t{s}\n"


@pytest.mark.parametrize("text", [body(s) for s in GD_GOOD] + GD_TOP_GOOD)
def test_good_script(text):
    assert check("res://a.gd", text)[1] == []


@pytest.mark.parametrize("text", [body(s) for s in GD_BAD] + GD_TOP_BAD)
def test_bad_script(text):
    assert check("res://a.gd", text)[1]


@pytest.mark.parametrize("text", SECTION_GOOD)
def test_good_section(text):
    for ext in ("tscn", "tres"):
        assert check(f"res://a.{ext}", f"[gd_scene format=3]\n\n[node name=\"A\" groups=[\"x\"]]\n{text}\n")[1] == []


@pytest.mark.parametrize("text", SECTION_BAD)
def test_bad_section(text):
    assert check("res://a.tscn", f"[gd_scene format=3]\n{text}\n")[1]


@pytest.mark.parametrize("text", JSON_GOOD)
def test_good_json(text):
    assert check("res://a.json", text)[1] == []


@pytest.mark.parametrize("text", JSON_BAD)
def test_bad_json(text):
    assert check("res://a.json", text)[1]


def test_there_are_enough():
    assert len(GD_GOOD) + len(GD_TOP_GOOD) + len(SECTION_GOOD) + len(JSON_GOOD) >= 50 <= len(GD_BAD) + len(GD_TOP_BAD) + len(SECTION_BAD) + len(JSON_BAD)


TABLE = "/root/testdata/sf0.001/source_files.parquet"


@pytest.mark.skipif(not os.path.exists(TABLE), reason="no test tables")
def test_every_parse_of_a_damaged_file_ends():
    import pyarrow.parquet as pq

    rng = random.Random(5)
    for row in pq.read_table(TABLE, columns=["path", "content"]).to_pylist():
        text = row["content"] or ""
        for _ in range(12):
            a, b = sorted(rng.choices(range(len(text) + 1), k=2))
            for damaged in (text[:a], text[a:], text[:a] + text[b:], text[:a] + rng.choice("([{\"')]}:@$%\t\n\\") + text[a:], text[b:] + text[:a]):
                begun = time.perf_counter()
                check(row["path"], damaged)
                assert time.perf_counter() - begun < 1
