"""JSON (RFC 8259) that keeps going after errors.

Recursive descent over tokens.  An error is recorded and the parser skips to the next comma or closing
bracket of the container that it is in (panic mode).
"""

from __future__ import annotations

import re
import sys

from weftgraph.sources.gdscript import Problem

_TOKEN = re.compile(
    r"""[ \t\r\n]*(?:(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")
    |(?P<num>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.+-]))
    |(?P<word>(?:true|false|null)(?!\w))|(?P<op>[\[\]{},:])|(?P<bad>"(?:[^"\\\n]|\\[^\n])*"?|[^\s\[\]{},:"]+|.)|(?P<end>$))""",
    re.X,
)


class _Panic(Exception):
    pass


class Parser:
    def __init__(self, text: str):
        self.text = text.removeprefix("﻿")
        self.problems: list[Problem] = []
        self.stop = 0
        self.advance()

    def advance(self) -> str:
        """Take the current token; the next becomes current."""
        took = getattr(self, "tok", "")
        m = _TOKEN.match(self.text, self.stop)
        self.kind = m.lastgroup if m else "end"
        self.tok = m.group(self.kind) if m else ""
        self.start, self.stop = (m.start(self.kind), m.end()) if m else (len(self.text), len(self.text))
        return took

    def fail(self, message: str) -> None:
        found = "end of file" if self.kind == "end" else repr(self.tok[:20])
        self.problems.append(Problem(len(re.findall(r"\r\n|\r|\n", self.text[: self.start])) + 1, f"{message}, found {found}"))
        raise _Panic

    def document(self) -> tuple | None:
        try:
            out = self.value()
            if self.kind != "end":
                self.fail("expected the end of the file")
            return out
        except _Panic:
            return None

    def value(self) -> tuple:
        if self.kind in ("str", "num", "word"):
            kind = self.kind
            return (kind, self.advance())
        if self.kind == "op" and self.tok == "[":
            return ("array", self.items("]", self.value))
        if self.kind == "op" and self.tok == "{":
            return ("object", self.items("}", self.pair))
        self.fail("expected a value")
        return ()

    def pair(self) -> tuple:
        if self.kind != "str":
            self.fail("expected a name in quotes")
        name = self.advance()
        if self.kind != "op" or self.tok != ":":
            self.fail("expected ':'")
        self.advance()
        return (name, self.value())

    def items(self, last: str, one) -> list:
        """Items up to a closing bracket; after an error it goes on behind the next comma of this container."""
        self.advance()
        out: list = []
        if self.kind == "op" and self.tok == last:
            self.advance()
            return out
        while True:
            try:
                out.append(one())
                if self.kind != "op" or self.tok not in (",", last):
                    self.fail(f"expected ',' or {last!r}")
            except _Panic:
                self.recover()
                if self.kind == "end" or self.tok not in (",", last):
                    raise
            if self.advance() == last:
                return out

    def recover(self) -> None:
        depth = 0
        while self.kind != "end" and not (self.kind == "op" and not depth and self.tok in (",", "]", "}")):
            depth += (self.kind == "op") * ((self.tok in "[{") - (self.tok in "]}"))
            self.advance()


def parse(text: str) -> tuple[tuple | None, list[Problem]]:
    """The value of a text and all problems, in order of lines."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 6 * len(re.findall(r"[\[{]", text)) + 1000))
    try:
        p = Parser(text)
        return p.document(), sorted(p.problems)
    finally:
        sys.setrecursionlimit(limit)
