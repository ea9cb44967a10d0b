"""Primitive facts of a section text (scene, resource, import sidecar, extension, plugin).

Same tuples as of scripts: (line, fact, owner, a, b, c, d, e).

  ext         a: id, b: type, c: path, d: uid              an [ext_resource]
  node        a: name, b: type, c: parent, d: node path, e: id of the instanced resource
  group       owner: node path, a: name
  script      owner: node path (null in a resource), a: id of the resource; sub_script: of a [sub_resource]
  ref         owner: node path (null: the file), a: property, b: 'NodePath' or 'ExtResource', c: path or id
  value       owner: node path, a: property, b: type of a plain value, c: its text
  connection  a: signal, b: from, c: to, d: method, e: flags
  editable    a: node path
  setting     a: section, b: key, c: text                  string assignments of other sections
  problem     a: message
"""

from __future__ import annotations

import re

from weftgraph.sources.script_facts import Fact
from weftgraph.sources.section_text import Parser, parse_with

#: What binary resources begin with.
BINARY = (b"RSRC", b"RSCC")
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_SINGLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def is_binary(head: bytes) -> bool:
    return head[:4] in BINARY


def string_of(value: tuple) -> str | None:
    """The text of a string value; null for others."""
    if value[0] != "str":
        return None
    s = value[1].lstrip("&^@")[1:-1]
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _SINGLE.get(m[1], m[1]), s) if "\\" in s else s


def plain_of(value: tuple) -> str | None:
    """The text of a string, number or word."""
    return string_of(value) if value[0] == "str" else value[1] if value[0] in ("num", "word") else None


def plain_type(value: tuple) -> str | None:
    """string, int, float, bool, array or dict; null for others."""
    kind, v = value[0], value[1]
    if kind == "str":
        return "string"
    if kind == "num":
        return "int" if re.fullmatch(r"[+-]?(\d+|0x[0-9a-fA-F]+)", v) else "float"
    if kind == "word":
        return "bool" if v in ("true", "false") else None
    return kind if kind in ("array", "dict") else None


def _resource(value: tuple | None) -> str | None:
    """The id that a reference to an external resource names."""
    if value and value[0] == "ctor" and value[1] == "ExtResource" and value[2]:
        return plain_of(value[2][0])
    return None


def node_path(parent: str, name: str) -> str:
    """The path of a node in its scene: ``.`` for the root, its name below it, else parent and name."""
    return "." if not parent else name if parent == "." else f"{parent}/{name}"


def _references(value: tuple):
    """(kind, path or id) of the references in a value, in arrays and dictionaries, too."""
    if value[0] == "ctor" and value[1] == "NodePath":
        yield "NodePath", (plain_of(value[2][0]) or "") if value[2] else ""
    elif value[0] == "ctor" and value[1] == "ExtResource":
        if (found := _resource(value)) is not None:
            yield "ExtResource", found
    elif value[0] in ("array", "dict"):
        for item in value[1]:
            yield from _references(item[2] if item[0] == "pair" else item)


def facts(text: str, titles: bool = False) -> list[Fact]:
    """The facts of one text, in its order."""
    p = Parser(text, titles)
    sections, problems = parse_with(p)
    out: list[Fact] = []

    def add(at: int, fact: str, owner: str | None = None, *values: str | None) -> None:
        out.append((p.line(at), fact, owner, *values, *[None] * (5 - len(values))))

    for name, attributes, pairs, at in sections:
        attrs = dict(attributes)
        text_of = lambda k: string_of(attrs[k]) or "" if k in attrs else ""  # noqa: B023, E731
        path = None
        if name == "ext_resource":
            add(at, "ext", None, plain_of(attrs["id"]) if "id" in attrs else "", text_of("type"), text_of("path"), text_of("uid"))
            continue
        if name == "connection":
            flags = attrs.get("flags")
            add(at, "connection", None, text_of("signal"), text_of("from"), text_of("to"), text_of("method"), flags[1] if flags and plain_type(flags) == "int" else None)
            continue
        if name == "editable":
            if text_of("path"):
                add(at, "editable", None, text_of("path"))
            continue
        if name == "node":
            path = node_path(text_of("parent"), text_of("name"))
            add(at, "node", None, text_of("name"), text_of("type"), text_of("parent"), path, _resource(attrs.get("instance")))
            for g in attrs["groups"][1] if "groups" in attrs and attrs["groups"][0] == "array" else []:
                if (s := string_of(g)) is not None:
                    add(at, "group", path, s)
        elif name not in ("sub_resource", "resource"):
            for key, value, where in pairs:
                if (s := string_of(value)) is not None:
                    add(where, "setting", None, name, key, s)
            continue
        last = {key: (value, where) for key, value, where in pairs}  # a key given twice counts once, the last
        for key, (value, where) in last.items():
            if key == "script":
                if (found := _resource(value)) is not None:
                    add(where, "sub_script" if name == "sub_resource" else "script", path, found)
                continue
            for kind, what in _references(value):
                add(where, "ref", path, key, kind, what)
            if path is not None and (t := plain_type(value)):
                add(where, "value", path, key, t, plain_of(value))
    for problem in problems:
        out.append((problem.line, "problem", None, problem.message, None, None, None, None))
    return out


def header_uid(text: str) -> str | None:
    """The uid on the first line that says something; see ``discovery.header_uids`` for whole tables."""
    for line in text.split("\n"):
        s = line.strip()
        if s and not s.startswith(";"):
            m = re.search(r'uid="(uid://[^"]+)"', s)
            return m[1] if m else None
    return None


