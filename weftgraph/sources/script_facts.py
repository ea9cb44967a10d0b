"""Primitive facts of a script: what it declares, and the places where it calls or reaches something.

Facts say what stands in one file; what they mean for the graph is decided by joins and rules on
DataFrames (``operators.extract``).  A fact is a tuple (line, fact, owner, a, b, c, d, e):

  extends      a: 'path' or 'class', b: what
  class_name   a: name
  inner_class, const, enum, onready   a: name
  export       a: name, b: declared type
  signal       a: name, b: parameter names joined by ','
  func         a: name, b: return type, c: number of parameters, d: flags of 'static', 'rpc', e: complexity; owner: the class name known so far
  call         a: 'plain' or 'attr', b: method, c: head of the chain, d: JSON [part before the method, emitter type], e: JSON of the first three arguments
  reach        a: node path
  head         a: name at the head of a chain
  problem      a: message

``owner`` of calls, reaches and heads is the function around them, null at file level.  An argument is
{"s": text} for a string literal, {"x": source} for anything else.
"""

from __future__ import annotations

import json

from weftgraph.sources.gdscript import Func, SpanParser, parse_with

Fact = tuple[int, str, str | None, str | None, str | None, str | None, str | None, str | None]


def unquoted(literal: str) -> str:
    """What stands between the quotes of a literal, without unescaping."""
    s = literal[1:] if literal[:1] in ("&", "^") else literal
    if len(s) >= 6 and s.startswith(('"""', "'''")):
        return s[3:-3]
    return s[1:-1] if len(s) >= 2 and s[0] in "\"'" else s


class _Walk:
    def __init__(self, p: SpanParser):
        self.p = p
        self.facts: list[Fact] = []
        self.types: dict[str, str] = {}
        self.self_class = ""

    def add(self, line: int, fact: str, owner: str | None = None, *values: str | None) -> None:
        self.facts.append((line, fact, owner, *values, *[None] * (5 - len(values))))

    # -- declarations ----------------------------------------------------------------------

    def declare(self, members: list, top: bool) -> None:
        marks: list = []
        for m in members:
            kind, line = m[0], m[1]
            if kind == "annotation":
                marks.append(m)
                continue
            mine, marks = marks, []
            if kind == "extends" and top:
                text = m[2]
                self.add(line, "extends", None, *(("path", unquoted(text)) if text[:1] in "\"'&^r" and text[-1:] in "\"'" else ("class", text)))
            elif kind == "class_name":
                self.self_class = m[2]
                self.add(line, "class_name", None, m[2])
            elif kind == "class":
                self.add(line, "inner_class", None, m[2])
                self.declare(m[4], False)
            elif kind == "signal":
                self.add(line, "signal", None, m[2], ",".join(n for n, _, _ in m[3]))
            elif kind in ("const", "enum") and m[2]:
                self.add(line, kind, None, m[2])
            elif kind == "var":
                v = m[2]
                if v.type:
                    self.types[v.name] = v.type
                names = [x[2] for x in (*mine, *v.annotations)]
                begun = min([line, *(x[1] for x in (*mine, *v.annotations))])
                if "onready" in names:
                    self.add(line, "onready", None, v.name)
                if any(n.startswith("export") for n in names):
                    self.add(begun, "export", None, v.name, self.types.get(v.name))
            elif kind == "func":
                f: Func = m[2]
                for n, t, _ in f.params:
                    if t:
                        self.types[n] = t
                flags = ["static"] * f.static + ["rpc"] * any(x[2] == "rpc" for x in (*mine, *f.annotations))
                self.add(line, "func", self.self_class, f.name, f.returns, str(len(f.params)), ",".join(flags), str(1 + _decisions(f.body)))

    # -- places ----------------------------------------------------------------------------

    def refer(self, members: list, owner: str | None) -> None:
        for m in members:
            if m[0] == "func" and isinstance(m[2], Func):
                self.parts(m[2].params, m[2].name)
                self.refer(m[2].body, m[2].name)
            elif m[0] == "class":
                self.refer(m[4], owner)
            elif m[0] == "var":
                self.parts(m[2].annotations, owner)
                self.place(m[2].value, owner)
                for a in m[2].accessors:
                    self.refer(a[2].body, owner)
            else:
                self.parts(m, owner)

    def parts(self, x, owner: str | None) -> None:
        """Whatever lies within lists and nodes."""
        if isinstance(x, tuple) and x and isinstance(x[0], str) and len(x) > 1 and isinstance(x[1], int) and not isinstance(x[1], bool):
            self.place(x, owner)
        elif isinstance(x, (list, tuple)):
            for y in x:
                self.parts(y, owner)

    def place(self, x, owner: str | None) -> None:
        if not isinstance(x, tuple) or not x:
            return
        kind = x[0]
        if kind == "var" and len(x) > 2 and hasattr(x[2], "accessors"):
            self.refer([x], owner)
        elif kind == "nodepath":
            self.add(x[1], "reach", owner, unquoted(x[2][1:]))
        elif kind == "unique":
            self.add(x[1], "reach", owner, "%" + unquoted(x[2]))
        elif kind == "call" and x[2][0] == "name":
            self.call(x[1] if x[2][1] is None else x[2][1], "plain", owner, x[2][2], "", "", "*", x[3])
            self.parts(x[3], owner)
        elif kind == "attr" or (kind in ("call", "index") and x[2][0] == "attr"):
            self.chain(x, owner)
        else:
            for y in x[2:]:
                self.parts(y, owner)

    def chain(self, x: tuple, owner: str | None) -> None:
        """``a.b(..).c`` is one place: only its last call counts, and the name at its head."""
        links: list[tuple[str, str, list]] = []  # (form, name, arguments), the last first
        at = x
        while True:
            if at[0] == "attr":
                links.append(("attr", at[3], []))
                at = at[2]
            elif at[0] in ("call", "index") and at[2][0] == "attr":
                links.append((at[0], at[2][3], at[3] if at[0] == "call" else [at[3]]))
                at = at[2][2]
            else:
                break
        head = at[2] if at[0] == "name" else ""
        if head:
            self.add(at[1], "head", owner, head)
        form, method, args = links[0]
        if form == "call":
            before = links[1][1] if len(links) > 1 else head or self.p.source(at)
            kind = self.self_class or "*" if head == "self" else self.types.get(head, "*") if head else "*"
            self.call(_first_line(at), "attr", owner, method, head, before, kind, args)
        for _, _, inner in links:
            self.parts(inner, owner)
        if at[0] != "name":
            self.place(at, owner)

    def call(self, line: int, form: str, owner: str | None, method: str, head: str, before: str, emitter: str, args: list) -> None:
        given = [{"s": unquoted(a[2])} if a[0] == "str" else {"x": self.p.source(a)} for a in args[:3]]
        self.add(line, "call", owner, form, method, head, json.dumps([before, emitter]), json.dumps(given))


def _first_line(x: tuple) -> int:
    while x[0] in ("call", "index", "attr") and isinstance(x[2], tuple):
        x = x[2]
    return x[1]


def _decisions(x) -> int:
    """Branches below a node: conditions, loops, arms of a match, conditional expressions, and / or."""
    n = 0
    if isinstance(x, tuple) and x and isinstance(x[0], str):
        if x[0] in ("if", "for", "while", "ternary", "arm"):
            n += 1
        if x[0] == "if":
            n += len(x[4])
        if x[0] == "binary" and x[2] in ("and", "or"):
            n += 1
    if isinstance(x, (list, tuple)):
        for y in x:
            n += _decisions(y)
    return n


def facts(text: str) -> list[Fact]:
    """The facts of one script, in the order of declaration, then of places."""
    p = SpanParser(text)
    tree, problems = parse_with(p)
    w = _Walk(p)
    w.declare(tree, True)
    w.refer(tree, None)
    if problems:
        w.add(1, "problem", None, "source contains parse errors; extraction is best-effort")
    return w.facts
