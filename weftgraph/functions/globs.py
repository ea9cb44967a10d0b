"""Glob patterns as regular expressions.

``*`` and ``?`` stop at ``/``; so does ``**``, unless ``deep`` is set.  ``[a-z]``, ``[^a]`` and a
backslash before a character are known; a malformed pattern gives None and matches nothing.
"""

from __future__ import annotations

import re


def glob_regex(pattern: str, deep: bool = False) -> str | None:
    """An anchored expression for Java and Python, None for a malformed pattern."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            wide = pattern[i : i + 2] == "**"
            out.append(".*" if wide and deep else "[^/]*")
            i += 2 if wide else 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "\\":
            if i + 1 == len(pattern):
                return None
            out.append(re.escape(pattern[i + 1]))
            i += 2
        elif c == "[":
            m = re.match(r"\[(\^?)((?:\\.|[^\\\]])+)\]", pattern[i:], re.S)
            if not m:
                return None
            body = re.sub(r"\\(.)", lambda e: "\\" + e[1], m[2]).replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            if re.search(r"^-|-$|--", m[2]):
                return None
            out.append(f"[{m[1]}{body}]")
            i += m.end()
        else:
            out.append(re.escape(c))
            i += 1
    return "^" + "".join(out) + "$"


def ignored_regex(patterns: list[str]) -> list[tuple[bool, str]]:
    """(whether it is for one path segment, expression) of each usable ignore pattern."""
    return [("/" not in p, r) for p in patterns if p and (r := glob_regex(p))]
