"""The engine's section texts (``tscn``, ``tres``, ``import``): headers, assignments and values.

Recursive descent over the characters.  An error is recorded and the parser skips to the next line
that starts a header or an assignment (panic mode), so one file can report several errors.

  document    header (header | key "=" value)*      comments run from ";" to the end of the line
  header      "[" name (name "=" value)* "]"        ``import``: any words between the brackets
  value       string | &string | ^string | number | true false null nil inf nan
              | "[" values "]" | "{" value ":" value, ... "}" | name [types] "(" arguments ")"
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left

from weftgraph.sources.gdscript import Problem

WORDS = frozenset(("true", "false", "null", "nil", "inf", "inf_neg", "nan", "-inf"))

_SPACE = re.compile(r"(?:[ \t\r\n]|;[^\n]*)*")
_STRING = re.compile(r'[&^@]?"(?:[^"\\]|\\.)*"', re.S)
_NUMBER = re.compile(r"[+-]?(?:0x[0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![\w.])|#[0-9a-fA-F]{3,8}(?!\w)|-inf(?!\w)")
_NAME = re.compile(r"[^\W\d]\w*")
_KEY = re.compile(r'"(?:[^"\\\n]|\\.)*"|[^\s="\[\];][^="\n]*')
_TITLE = re.compile(r"[^\[\]\n\"=]*[^\[\]\s\"=][^\[\]\n\"=]*")
_LINE_END = re.compile(r"[ \t]*(?:;[^\n]*)?(?:\n|\Z)")
_RESUME = re.compile(r'^(?=\[[^\W\d]|[^\s="\[\]{}();,]+[ \t]*=)', re.M)


class _Panic(Exception):
    pass


class Parser:
    def __init__(self, text: str, titles: bool):
        self.text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
        self.titles = titles
        self.at = 0
        self.problems: list[Problem] = []

    def fail(self, message: str, at: int | None = None) -> None:
        self.problems.append(Problem(self.text.count("\n", 0, self.at if at is None else at) + 1, message))
        raise _Panic

    def skip(self) -> str:
        """The next character that says something."""
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def shown(self) -> str:
        return repr(self.text[self.at : self.at + 20].split("\n")[0]) if self.at < len(self.text) else "end of file"

    def expect(self, mark: str) -> None:
        if self.skip() != mark:
            self.fail(f"expected {mark!r}, found {self.shown()}")
        self.at += 1

    def line(self, at: int) -> int:
        """The line of a place."""
        if self.ends is None:
            self.ends = [m.start() for m in re.finditer("\n", self.text)]
        return bisect_left(self.ends, at) + 1

    ends: list[int] | None = None

    def document(self) -> list:
        """[(header name, [(attribute, value)], [(key, value, place)], place)]"""
        out: list = []
        while c := self.skip():
            begun = self.at
            try:
                if c == "[":
                    out.append((*self.header(), [], begun))
                elif not out and not self.problems:
                    self.fail("expected a section header first")
                else:
                    pair = self.assignment()
                    if out:
                        out[-1][2].append((*pair, begun))
            except _Panic:
                found = _RESUME.search(self.text, max(self.at, begun + 1))
                self.at = found.start() if found else len(self.text)
        return out

    def header(self) -> tuple:
        begun = self.at
        self.at += 1
        if self.titles:
            m = _TITLE.match(self.text, self.at)
            if m:
                self.at = m.end()
                if self.text[self.at : self.at + 1] == "]":
                    self.at += 1
                    return m.group().strip(), []
                self.at = begun + 1
        self.skip()
        m = _NAME.match(self.text, self.at)
        if not m:
            self.fail(f"expected the name of a section, found {self.shown()}")
        self.at = m.end()
        attributes: list = []
        while (c := self.skip()) != "]":
            a = _NAME.match(self.text, self.at)
            if not c:
                self.fail("a section header is not closed", begun)
            if not a:
                self.fail(f"malformed header attribute near {self.shown()}")
            self.at = a.end()
            self.expect("=")
            attributes.append((a.group(), self.value()))
        self.at += 1
        return m.group(), attributes

    def assignment(self) -> tuple:
        m = _KEY.match(self.text, self.at)
        if not m:
            self.fail(f"expected a key, found {self.shown()}")
        begun, self.at = self.at, m.end()
        if self.text[self.at : self.at + 1] != "=":
            while self.text[self.at : self.at + 1] in (" ", "\t"):
                self.at += 1
            if self.text[self.at : self.at + 1] != "=":
                self.fail(f"expected '=' after {m.group().strip()[:20]!r}", begun)
        self.at += 1
        value = self.value()
        if not _LINE_END.match(self.text, self.at):
            self.fail(f"unexpected {self.shown()} after a value")
        return m.group().strip(), value

    def value(self) -> tuple:
        c = self.skip()
        if not c:
            self.fail("unexpected end of file in a value")
        if m := _STRING.match(self.text, self.at):
            self.at = m.end()
            return ("str", m.group())
        if c == '"' or (c in "&^@" and self.text[self.at + 1 : self.at + 2] == '"'):
            self.fail("unterminated string")
        if m := _NUMBER.match(self.text, self.at):
            self.at = m.end()
            return ("num", m.group())
        if c == "[":
            return ("array", self.items("[", "]"))
        if c == "{":
            return ("dict", self.items("{", "}"))
        m = _NAME.match(self.text, self.at)
        if not m:
            self.fail(f"expected a value, found {self.shown()}")
        name = m.group()
        if name in WORDS:
            self.at = m.end()
            return ("word", name)
        begun, self.at = self.at, m.end()
        if name in ("Array", "Dictionary") and self.skip() == "[":
            self.types()
        if self.skip() != "(":
            self.at = begun
            self.fail(f"unexpected word {name[:20]!r} as a value")
        return ("ctor", name, self.items("(", ")", name == "Object"))

    def types(self) -> None:
        """The element types of a typed array or dictionary: names or references to scripts."""
        self.expect("[")
        while True:
            self.skip()
            m = _NAME.match(self.text, self.at)
            if not m:
                self.fail(f"expected a type, found {self.shown()}")
            self.at = m.end()
            if self.skip() == "(":
                self.items("(", ")")
            if self.skip() != ",":
                break
            self.at += 1
        self.expect("]")

    def items(self, first: str, last: str, object_: bool = False) -> list:
        """Values between brackets: pairs in a dictionary, an optional comma at the end of arrays and dictionaries."""
        self.expect(first)
        out: list = []
        while self.skip() != last:
            if object_ and not out:  # Object(Class,"property":value,...)
                m = _NAME.match(self.text, self.at)
                if not m:
                    self.fail(f"expected a class, found {self.shown()}")
                self.at = m.end()
                out.append(("class", m.group()))
            else:
                item = self.value()
                if first == "{" or object_:
                    self.expect(":")
                    item = ("pair", item, self.value())
                out.append(item)
            if self.skip() != ",":
                break
            self.at += 1
            if first == "(" and self.skip() == last:
                self.fail("expected a value after ','")
        self.expect(last)
        return out


def parse(text: str, titles: bool = False) -> tuple[list, list[Problem]]:
    """The sections of a text and all problems, in order of lines; ``titles``: section names are free words."""
    return parse_with(Parser(text, titles))


def parse_with(p: Parser) -> tuple[list, list[Problem]]:
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 4 * len(re.findall(r"[\[{(]", p.text)) + 1000))
    try:
        return p.document(), sorted(p.problems)
    finally:
        sys.setrecursionlimit(limit)
