"""GDScript: tokens, and a parser that keeps going after errors.

Statements are parsed by recursive descent, expressions by precedence climbing.  An error is recorded
and the parser skips to the next line that starts a statement (panic mode), so one file can report
several errors; the tree of what could be read is kept.

The language is that of the engine's version 4.  Spellings of version 3 (``export var``, ``onready var``,
``tool``, ``setget``, ``remote func``) are read, too, and are no errors; names of types are not judged, nor
what only a later pass knows: unknown names, a ``break`` outside of a loop, two ``class_name``.

Tree nodes are tuples ``(kind, line, ...)``:

  expressions  name(text) str(text) num(text) nodepath(text) unique(text) attr(object, name)
               call(callee, args) index(object, expr) unary(op, expr) binary(op, left, right)
               ternary(then, condition, else) array(items) dict(pairs) lambda(params, body) as/is(expr, type)
  statements   expr(expression) assign(op, target, value) return(expr) var(decl) if(cond, body, elifs, else)
               for(name, iterable, body) while(cond, body) match(subject, arms) pass assert(args)
               extends(text) class_name(name) signal(name, params) const(name, value) enum(name, members)
               func(decl) class(name, base, body) annotation(name, args)
"""

from __future__ import annotations

import re
import sys
from typing import NamedTuple


class Problem(NamedTuple):
    line: int
    message: str


class Var(NamedTuple):
    name: str
    type: str | None
    value: tuple | None
    annotations: list
    static: bool
    accessors: list


class Func(NamedTuple):
    name: str
    params: list  # (name, type, default)
    returns: str | None
    body: list
    static: bool
    annotations: list


# Fixed values of the language.
KEYWORDS = frozenset(
    "if elif else for while match when break continue pass return class class_name extends is in as self signal func static const enum var breakpoint preload await yield assert void and or not super".split()
)
_OPS = ("**=", "<<=", ">>=", "...", "**", "->", ":=", "==", "!=", "<=", ">=", "&&", "||", "<<", ">>", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "..", *"()[]{},:;.+-*/%&|^~<>=!@")
ASSIGN = frozenset(("=", "+=", "-=", "*=", "/=", "**=", "%=", "&=", "|=", "^=", "<<=", ">>="))
#: Annotations that belong to the script and need nothing after them.
ALONE = frozenset(("tool", "icon", "static_unload", "abstract", "warning_ignore", "warning_ignore_start", "warning_ignore_restore"))
#: Binding strength of binary operators, weakest first.
BINARY = {"or": 2, "||": 2, "and": 3, "&&": 3, "in": 5, "==": 6, "!=": 6, "<": 6, ">": 6, "<=": 6, ">=": 6, "|": 7, "^": 8, "&": 9, "<<": 10, ">>": 10, "+": 11, "-": 11, "*": 12, "/": 12, "%": 12, "**": 14}
_NOT, _SIGN, _TERNARY, _CAST = 4, 13, 1, 0

_TOKEN = re.compile(
    r"""(?P<nl>\n)|(?P<ws>(?:[ \t]|\\\n)+)|(?:(?P<id>(?!r["'])[^\W\d]\w*)|(?P<com>\#[^\n]*)
    |(?P<str>[r&^]?(?:\"\"\"(?:[^\\"]|\\.|"(?!""))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))
    |(?P<num>0[xX][0-9a-fA-F_]+|0[bB][01_]+|\d[\d_]*\.\d[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*(?:[eE][+-]?\d+|\.(?![.\w]))?)
    |(?P<path>\$(?:"[^"\n]*"|'[^'\n]*'|/?(?:\.\.|%?[^\W\d]\w*)(?:/(?:\.\.|%?[^\W\d]\w*))*))
    |(?P<op>"""
    + "|".join(re.escape(o) for o in _OPS)
    + r")|(?P<bad>.))[ \t]*",
    re.X | re.S,
)
_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")


class Token:
    __slots__ = ("at", "indent", "kind", "line", "nl", "text")

    def __init__(self, kind: str, text: str, line: int, indent: int, nl: bool, at: int):
        self.kind, self.text, self.line, self.indent, self.nl, self.at = kind, text, line, indent, nl, at


class _Panic(Exception):
    pass


def plain_lines(text: str) -> str:
    """The text as it is parsed: no byte order mark, line feeds only."""
    return text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


def tokenize(text: str) -> tuple[list[Token], list[Problem]]:
    """Tokens with the line they are on; ``nl`` marks the first of a line, ``indent`` its depth, ``at`` its place in ``plain_lines``."""
    text = plain_lines(text)
    out: list[Token] = []
    problems: list[Problem] = []
    line, indent, fresh, depth, used = 1, "", True, 0, ""
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        s = m[kind]  # without the blanks after it
        if kind == "ws":
            if fresh and not indent:
                indent = s.split("\\\n")[0]
            line += s.count("\n")
            continue
        if kind == "com":
            continue
        if kind == "nl":
            line += 1
            indent, fresh = "", True
            continue
        if fresh and indent and not depth:
            mark = indent[0]
            if indent.strip(mark) or (used and mark != used):
                problems.append(Problem(line, "mixed tabs and spaces in indentation"))
            used = used or mark
        if kind == "bad":
            problems.append(Problem(line, "unterminated string" if s in "\"'" else f"unexpected character {s!r}"))
        elif kind == "op":
            if s in _OPEN:
                depth += 1
            elif s in _CLOSE and depth:
                depth -= 1
        out.append(Token("kw" if kind == "id" and s in KEYWORDS else kind, s, line, len(indent), fresh, m.start()))
        fresh = False
        if kind == "str":
            line += s.count("\n")
    out.append(Token("end", "", line, 0, True, len(text)))
    return out, problems


class Parser:
    def __init__(self, text: str):
        self.toks, self.problems = tokenize(text)
        self.i = 0
        self.tok = self.toks[0]
        self.lines = True  # whether the end of a line ends a statement here

    # -- moving ------------------------------------------------------------------------------

    def advance(self) -> Token:
        t = self.tok
        if t.kind != "end":
            self.i += 1
            self.tok = self.toks[self.i]
        return t

    def fail(self, message: str) -> None:
        # what is missing at the end of a line is missing there, not on the next
        at = self.toks[self.i - 1] if self.i and self.over() else self.tok
        self.problems.append(Problem(at.line, message))
        raise _Panic

    def expect(self, text: str) -> Token:
        if self.tok.text != text or self.tok.kind == "str":
            self.fail(f"expected {text!r}, found {self.shown()}")
        return self.advance()

    def shown(self) -> str:
        return "end of file" if self.tok.kind == "end" else repr(self.tok.text[:20])

    def at(self, text: str) -> bool:
        return self.tok.text == text and self.tok.kind != "str" and not self.over()

    def over(self) -> bool:
        """Whether the statement ends before the current token."""
        return self.tok.kind == "end" or (self.tok.nl and self.lines and self.i != self.started)

    def take(self, text: str) -> bool:
        if self.at(text):
            self.advance()
            return True
        return False

    def name(self, what: str = "name") -> str:
        soft = self.tok.kind == "id" or (self.tok.kind == "kw" and self.tok.text in ("when", "void", "yield"))
        if not soft or self.over():
            self.fail(f"expected {what}, found {self.shown()}")
        return self.advance().text

    def end_statement(self) -> None:
        if self.at(";"):
            while self.take(";"):
                pass
        elif not self.over():
            if self.in_lambda and self.tok.text in (")", "]", "}", ","):
                return
            self.fail(f"expected end of statement, found {self.shown()}")

    in_lambda = 0

    def recover(self) -> None:
        """Skip to the next line; every bracket is taken as closed."""
        self.lines = True
        self.in_lambda = 0
        if self.tok.kind != "end" and not (self.tok.nl and self.i != self.started):
            self.advance()
        while self.tok.kind != "end" and not self.tok.nl:
            self.advance()

    started = -1

    # -- blocks ------------------------------------------------------------------------------

    def module(self) -> list:
        tree = self.suite(-1, self.member)
        if tree and tree[-1][0] == "annotation" and tree[-1][2] not in ALONE:
            self.problems.append(Problem(tree[-1][1], f"nothing follows the annotation {tree[-1][2]!r}"))
        return tree

    def suite(self, outer: int, parse) -> list:
        """Statements of one depth, deeper than ``outer``."""
        out: list = []
        depth = self.tok.indent
        while self.tok.kind != "end":
            if self.tok.nl:
                if self.in_lambda and self.tok.text in (")", "]", "}", ","):
                    break
                if self.tok.indent <= outer:
                    break
                if self.tok.indent != depth:
                    self.problems.append(Problem(self.tok.line, "unexpected indentation"))
                    if self.tok.indent < depth:
                        depth = self.tok.indent
            elif self.in_lambda and self.tok.text in (")", "]", "}", ","):
                break
            self.started = self.i
            keep = self.in_lambda, self.lines
            if keep[0]:
                out += parse()  # errors within a lambda end the statement around it
                continue
            try:
                out += parse()
            except _Panic:
                self.recover()
        return out

    def block(self, outer: int, parse=None) -> list:
        """What follows a colon: statements on the line, or a deeper suite."""
        parse = parse or self.statement
        if self.tok.kind != "end" and not self.tok.nl:
            out: list = []
            while not self.over():
                if self.in_lambda and self.tok.text in (")", "]", "}", ","):
                    break
                out += parse()
            return out
        if self.tok.kind == "end" or self.tok.indent <= outer:
            self.problems.append(Problem(self.tok.line, "expected an indented block"))
            return []
        return self.suite(outer, parse)

    def line_indent(self) -> int:
        """Depth of the line that the current token is on."""
        i = self.i
        while i and not self.toks[i].nl:
            i -= 1
        return self.toks[i].indent

    # -- declarations -------------------------------------------------------------------------

    def annotations(self) -> list:
        out = []
        while self.at("@") or (self.tok.text == "@" and out):
            line = self.advance().line
            if self.tok.kind not in ("id", "kw"):
                self.fail("expected annotation name")
            name = self.advance().text
            args = self.arguments() if self.at("(") else []
            out.append(("annotation", line, name, args))
        return out

    def member(self) -> list:
        """One declaration of a class body."""
        t = self.tok
        if t.text == "@" and t.kind == "op":
            marks = self.annotations()
            if self.tok.kind == "end" or self.tok.nl:
                # on a line of its own: belongs to what follows, or to the script
                if self.tok.text == "func" and any(m[2] == "abstract" for m in marks):
                    self.started = self.i
                    return [*marks, *self.declared(marks)]
                return list(marks)
            return [*marks, *self.declared(marks)]
        return self.declared([])

    def declared(self, marks: list) -> list:
        t = self.tok
        word = t.text if t.kind in ("kw", "id") else ""
        if word == "export" and t.kind == "id":  # the older spelling
            self.advance()
            args = self.arguments() if self.at("(") else []
            return self.declared([*marks, ("annotation", t.line, "export", args)])
        if word == "onready" and t.kind == "id":
            self.advance()
            return self.declared([*marks, ("annotation", t.line, "onready", [])])
        if word in ("remote", "master", "puppet", "remotesync", "mastersync", "puppetsync") and t.kind == "id":
            self.advance()
            return self.declared([*marks, ("annotation", t.line, "rpc", [])])
        if word == "tool" and t.kind == "id":
            self.advance()
            self.end_statement()
            return [("annotation", t.line, "tool", [])]
        if word == "extends":
            return [self.extends()]
        if word == "class_name":
            return self.class_name()
        if word == "signal":
            return [self.signal()]
        if word == "enum":
            return [self.enum()]
        if word == "class":
            return [self.inner_class()]
        if word == "static":
            self.advance()
            if self.at("var"):
                return [self.var(marks, True)]
            if self.at("func"):
                return [self.func(marks, True)]
            self.fail("expected 'func' or 'var' after 'static'")
        if word == "func":
            return [self.func(marks, False)]
        if word == "var":
            return [self.var(marks, False)]
        if word == "const":
            return [self.const()]
        if word == "pass":
            self.advance()
            self.end_statement()
            return [("pass", t.line)]
        if t.text == ";":
            self.advance()
            return []
        self.fail(f"unexpected {self.shown()} in class body")
        return []

    def type_name(self) -> str:
        if self.tok.text in ("void", "preload", "self"):
            out = self.advance().text
        else:
            out = self.name("type")
        while self.take("."):
            out += "." + self.name("type")
        if self.at("["):
            self.advance()
            inner = [self.type_name()]
            while self.take(","):
                inner.append(self.type_name())
            self.expect("]")
            out += "[" + ", ".join(inner) + "]"
        return out

    def extends(self) -> tuple:
        line = self.advance().line
        if self.tok.kind == "str" and not self.over():
            base = self.advance().text
            while self.take("."):
                base += "." + self.name("class")
        else:
            base = self.type_name()
        self.end_statement()
        return ("extends", line, base)

    def class_name(self) -> list:
        line = self.advance().line
        out = [("class_name", line, self.name("class name"))]
        if self.take(","):
            if self.tok.kind != "str" or self.over():
                self.fail("expected icon path")
            self.advance()
        if self.at("extends"):
            return [*out, self.extends()]
        self.end_statement()
        return out

    def signal(self) -> tuple:
        line = self.advance().line
        name = self.name("signal name")
        params = self.params() if self.at("(") else []
        self.end_statement()
        return ("signal", line, name, params)

    def const(self) -> tuple:
        line = self.advance().line
        name = self.name("constant name")
        if self.take(":="):
            value = self.expression()
        else:
            if self.take(":"):
                self.type_name()
            self.expect_here("=")
            value = self.expression()
        self.end_statement()
        return ("const", line, name, value)

    def expect_here(self, text: str) -> None:
        if not self.take(text):
            self.fail(f"expected {text!r}, found {'end of line' if self.over() and self.tok.kind != 'end' else self.shown()}")

    def enum(self) -> tuple:
        line = self.advance().line
        name = None if self.at("{") else self.name("enum name")
        self.expect_here("{")
        keep, self.lines = self.lines, False
        members = []
        while not self.at("}"):
            member = self.name("enum member")
            value = self.expression() if self.take("=") else None
            members.append((member, value))
            if not self.take(","):
                break
        self.expect("}")
        self.lines = keep
        self.end_statement()
        return ("enum", line, name, members)

    def inner_class(self) -> tuple:
        depth = self.line_indent()
        line = self.advance().line
        name = self.name("class name")
        base = None
        if self.take("extends"):
            base = self.advance().text if self.tok.kind == "str" else self.type_name()
        self.expect_here(":")
        return ("class", line, name, base, self.block(depth, self.member))

    def var(self, marks: list, static: bool, local: bool = False) -> tuple:
        depth = self.line_indent()
        line = self.advance().line
        name = self.name("variable name")
        kind = value = None
        accessors: list = []
        if self.take(":="):
            value = self.expression()
        else:
            if self.at(":") and not self.opens_accessors():
                self.advance()
                kind = self.type_name()
            if self.take("="):
                value = self.expression()
        if self.at("setget"):
            self.advance()
            while not self.over() and not self.at(";"):
                self.advance()
        if not local and self.at(":"):
            self.advance()
            accessors = self.accessors(depth)
        else:
            self.end_statement()
        return ("var", line, Var(name, kind, value, marks, static, accessors))

    def opens_accessors(self) -> bool:
        after = self.toks[self.i + 1]
        return after.nl or (after.text in ("get", "set") and self.toks[min(self.i + 2, len(self.toks) - 1)].text in ("=", ":", "("))

    def accessors(self, depth: int) -> list:
        def one() -> list:
            t = self.tok
            if t.text not in ("get", "set"):
                self.fail(f"expected 'get' or 'set', found {self.shown()}")
            inner = self.line_indent()
            self.advance()
            if self.take("="):
                self.name("accessor function")
                if not self.take(","):
                    self.end_statement()
                return []
            params = self.params() if self.at("(") else []
            self.expect_here(":")
            return [("func", t.line, Func(t.text, params, None, self.block(inner), False, []))]

        return self.block(depth, one)

    def params(self) -> list:
        self.expect("(")
        keep, self.lines = self.lines, False
        out = []
        while not self.at(")"):
            rest = self.take("...")
            name = self.name("parameter name")
            kind = default = None
            if self.take(":="):
                default = self.expression()
            else:
                if self.take(":"):
                    kind = self.type_name()
                if self.take("="):
                    default = self.expression()
            out.append((("..." if rest else "") + name, kind, default))
            if not self.take(","):
                break
        self.expect(")")
        self.lines = keep
        return out

    def func(self, marks: list, static: bool) -> tuple:
        depth = self.line_indent()
        line = self.advance().line
        name = self.name("function name")
        if not self.at("("):
            self.fail(f"expected '(', found {self.shown()}")
        params = self.params()
        returns = self.type_name() if self.take("->") else None
        if not self.at(":") and any(m[2] == "abstract" for m in marks):
            self.end_statement()
            return ("func", line, Func(name, params, returns, [], static, marks))
        self.expect_here(":")
        return ("func", line, Func(name, params, returns, self.block(depth), static, marks))

    # -- statements ---------------------------------------------------------------------------

    def statement(self) -> list:
        t = self.tok
        word = t.text if t.kind in ("kw", "id") else ""
        if t.text == ";" and t.kind == "op":
            self.advance()
            return []
        if t.text == "@" and t.kind == "op":
            marks = self.annotations()
            return [*marks] if self.tok.nl or self.tok.kind == "end" else [*marks, *self.statement()]
        if word in ("pass", "break", "continue", "breakpoint"):
            self.advance()
            self.end_statement()
            return [("pass" if word == "pass" else word, t.line)]
        if word == "return":
            self.advance()
            done = self.over() or self.at(";") or (self.in_lambda and self.tok.text in (")", "]", "}", ","))
            value = None if done else self.expression()
            self.end_statement()
            return [("return", t.line, value)]
        if word == "var":
            return [self.var([], False, True)]
        if word == "const":
            return [self.const()]
        if word == "static":
            self.fail("unexpected 'static' in a function")
        if word == "if":
            return [self.if_()]
        if word in ("elif", "else"):
            self.fail(f"unexpected {word!r}")
        if word == "for":
            return [self.for_()]
        if word == "while":
            depth = self.line_indent()
            self.advance()
            cond = self.expression()
            self.expect_here(":")
            return [("while", t.line, cond, self.block(depth))]
        if word == "match":
            return [self.match()]
        if word == "assert":
            self.advance()
            if not self.at("("):
                self.fail("expected '(' after 'assert'")
            args = self.arguments()
            self.end_statement()
            return [("assert", t.line, args)]
        if word in ("class", "class_name", "extends", "signal", "enum"):
            self.fail(f"unexpected {word!r} in a function")
        if word == "func" and self.toks[self.i + 1].kind == "id":
            self.fail("unexpected function in a function")
        left = self.expression()
        if self.tok.text in ASSIGN and self.tok.kind == "op" and not self.over():
            op = self.advance().text
            if left[0] not in ("name", "attr", "index", "nodepath", "unique"):
                self.problems.append(Problem(t.line, "cannot assign to this expression"))
            value = self.expression()
            self.end_statement()
            return [("assign", t.line, op, left, value)]
        self.end_statement()
        return [("expr", t.line, left)]

    def if_(self) -> tuple:
        depth = self.line_indent()
        line = self.advance().line
        cond = self.expression()
        self.expect_here(":")
        body = self.block(depth)
        elifs, other = [], None
        while self.tok.text in ("elif", "else") and self.tok.kind == "kw" and self.tok.nl and self.tok.indent == depth:
            if self.tok.text == "else":
                self.advance()
                self.expect_here(":")
                other = self.block(depth)
                break
            at = self.advance().line
            c = self.expression()
            self.expect_here(":")
            elifs.append((at, c, self.block(depth)))
        return ("if", line, cond, body, elifs, other)

    def for_(self) -> tuple:
        depth = self.line_indent()
        line = self.advance().line
        name = self.name("loop variable")
        if self.take(":"):
            self.type_name()
        if not self.take("in"):
            self.fail(f"expected 'in', found {self.shown()}")
        over = self.expression()
        self.expect_here(":")
        return ("for", line, name, over, self.block(depth))

    def match(self) -> tuple:
        depth = self.line_indent()
        line = self.advance().line
        subject = self.expression()
        self.expect_here(":")

        def arm() -> list:
            inner = self.line_indent()
            at = self.tok.line
            patterns = [self.pattern()]
            while self.take(","):
                patterns.append(self.pattern())
            guard = self.expression() if self.take("when") else None
            self.expect_here(":")
            return [("arm", at, patterns, guard, self.block(inner))]

        if not self.tok.nl:
            self.fail("expected match arms on lines of their own")
        return ("match", line, subject, self.block(depth, arm))

    def pattern(self) -> tuple:
        t = self.tok
        if self.at("var"):
            self.advance()
            return ("bind", t.line, self.name())
        if self.at(".."):
            self.advance()
            return ("rest", t.line)
        if self.at("["):
            return ("array", t.line, self.items("[", "]", self.pattern))
        if self.at("{"):

            def pair() -> tuple:
                if self.at(".."):
                    return (self.pattern(), None)
                k = self.expression()
                return (k, self.pattern() if self.take(":") else None)

            return ("dict", t.line, self.items("{", "}", pair))
        return self.expression()

    # -- expressions --------------------------------------------------------------------------

    def items(self, first: str, last: str, parse) -> list:
        """Comma-separated items in brackets, with an optional comma at the end."""
        self.expect(first)
        keep, self.lines = self.lines, False
        lam, self.in_lambda = self.in_lambda, 0
        out = []
        while not self.at(last):
            out.append(parse())
            if not self.take(","):
                break
        self.expect(last)
        self.lines, self.in_lambda = keep, lam
        return out

    def arguments(self) -> list:
        return self.items("(", ")", self.expression)

    def expression(self, strength: int = 0) -> tuple:
        left = self.prefix()
        while True:
            t = self.tok
            if (t.nl and self.lines) or t.kind not in ("op", "kw"):
                return left
            op = t.text
            power = BINARY.get(op)
            if power is not None:
                if power < strength:
                    return left
                self.advance()
                left = ("binary", t.line, op, left, self.expression(power + 1))
            elif op == "not" and self.toks[self.i + 1].text == "in" and BINARY["in"] >= strength:
                self.advance()
                self.advance()
                left = ("binary", t.line, "not in", left, self.expression(BINARY["in"] + 1))
            elif op == "is":
                self.advance()
                self.take("not")
                left = ("is", t.line, left, self.type_name())
            elif op == "as" and strength <= _CAST:
                self.advance()
                left = ("as", t.line, left, self.type_name())
            elif op == "if" and strength <= _TERNARY:
                self.advance()
                cond = self.expression(_TERNARY + 1)
                if not self.take("else"):
                    self.fail(f"expected 'else' in a conditional expression, found {self.shown()}")
                left = ("ternary", t.line, left, cond, self.expression(_TERNARY))
            else:
                return left

    def prefix(self) -> tuple:
        t = self.tok
        if self.over():
            self.fail("expected an expression, found the end of the " + ("file" if t.kind == "end" else "line"))
        if t.kind == "op" and t.text in ("-", "+", "~"):
            self.advance()
            return ("unary", t.line, t.text, self.expression(_SIGN))
        if t.text in ("not", "!") and t.kind in ("op", "kw"):
            self.advance()
            return ("unary", t.line, "not", self.expression(_NOT))
        if t.text == "await" and t.kind == "kw":
            self.advance()
            return ("unary", t.line, "await", self.expression(15))
        return self.postfix(self.primary())

    def primary(self) -> tuple:
        t = self.advance()
        if t.kind == "id":
            return ("name", t.line, t.text)
        if t.kind == "str":
            return ("str", t.line, t.text)
        if t.kind == "num":
            return ("num", t.line, t.text)
        if t.kind == "path":
            return ("nodepath", t.line, t.text)
        if t.kind == "kw":
            if t.text in ("self", "super", "preload", "yield", "when", "match"):
                return ("name", t.line, t.text)
            if t.text == "func":
                return self.lambda_(t)
        if t.kind == "op":
            if t.text == "(":
                keep, self.lines = self.lines, False
                lam, self.in_lambda = self.in_lambda, 0
                inner = self.expression()
                self.expect(")")
                self.lines, self.in_lambda = keep, lam
                return ("paren", t.line, inner)
            if t.text == "[":
                self.back()
                return ("array", t.line, self.items("[", "]", self.expression))
            if t.text == "{":
                self.back()
                return ("dict", t.line, self.items("{", "}", self.pair))
            if t.text == "%" and self.tok.kind in ("id", "str"):
                return ("unique", t.line, self.advance().text)
        self.back()
        self.fail(f"expected an expression, found {self.shown()}")
        return ()

    def back(self) -> None:
        self.i -= 1 if self.tok.kind != "end" or self.toks[self.i - 1].kind != "end" else 0
        self.tok = self.toks[self.i]

    def pair(self) -> tuple:
        key = self.expression()
        if not self.take(":") and not self.take("="):
            self.fail(f"expected ':' in a dictionary, found {self.shown()}")
        return (key, self.expression())

    def postfix(self, left: tuple) -> tuple:
        while True:
            t = self.tok
            if t.kind != "op" or (t.nl and self.lines):
                return left
            if t.text == "(":
                left = ("call", t.line, left, self.arguments())
            elif t.text == "[":
                got = self.items("[", "]", self.expression)
                if len(got) != 1:
                    self.fail("expected one index")
                left = ("index", t.line, left, got[0])
            elif t.text == ".":
                self.advance()
                if self.tok.kind not in ("id", "kw") or self.over():
                    self.fail(f"expected a name after '.', found {self.shown()}")
                left = ("attr", t.line, left, self.advance().text)
            else:
                return left

    def lambda_(self, t: Token) -> tuple:
        self.i -= 1
        self.tok = self.toks[self.i]
        depth = self.line_indent()
        self.advance()
        if self.tok.kind == "id":
            self.advance()
        if not self.at("("):
            self.fail(f"expected '(', found {self.shown()}")
        params = self.params()
        if self.take("->"):
            self.type_name()
        self.expect(":")
        keep, self.lines = self.lines, True
        enclosed = not keep or self.in_lambda
        lam, self.in_lambda = self.in_lambda, 1 if enclosed else self.in_lambda
        if enclosed or self.tok.nl:
            body = self.block(depth)
        else:
            body = self.statement_inline()
        self.lines, self.in_lambda = keep, lam
        return ("lambda", t.line, params, body)

    def statement_inline(self) -> list:
        """The body of a lambda that is the last thing of its line."""
        out: list = []
        while not self.over():
            out += self.statement()
        return out


class SpanParser(Parser):
    """Also keeps where the expressions stand, for ``source``."""

    def __init__(self, text: str):
        super().__init__(text)
        self.text = plain_lines(text)
        self.spans: dict[int, tuple[int, int]] = {}

    def expression(self, strength: int = 0) -> tuple:
        begin = self.i
        node = super().expression(strength)
        if not strength:
            self.spans[id(node)] = (self.toks[begin].at, self.toks[self.i - 1].at + len(self.toks[self.i - 1].text))
        return node

    def source(self, node: tuple) -> str:
        """The text of an expression that stands by itself (an argument, an operand in brackets)."""
        a, b = self.spans.get(id(node), (0, 0))
        return self.text[a:b]


def parse(text: str) -> tuple[list, list[Problem]]:
    """The tree of a script and all problems, in order of lines."""
    return parse_with(Parser(text))


def parse_with(p: Parser) -> tuple[list, list[Problem]]:
    limit = sys.getrecursionlimit()
    # nesting is no error, however deep: a token opens a bounded number of calls
    sys.setrecursionlimit(max(limit, 20 * len(p.toks) + 1000))
    try:
        tree = p.module()
    finally:
        sys.setrecursionlimit(limit)
    return tree, sorted(p.problems)
