"""Scripts of several statements, and forms of other engines that Spark can run once they are said its way."""

from __future__ import annotations

import re

_SKIPPED = r"'(?:[^']|'')*'|`[^`]*`|--[^\n]*|/\*.*?\*/"
_ENDS = re.compile(rf"({_SKIPPED}|\"[^\"]*\")|;", re.DOTALL)
_QUOTED = re.compile(rf"({_SKIPPED})|\"([^\"]*)\"", re.DOTALL)
_NO_CODE = re.compile(r"(?:\s|--[^\n]*|/\*.*?\*/)*", re.DOTALL)
_TOP = re.compile(r"select\s+top\s+(\d+)\s+", re.IGNORECASE)


def statements(script: str) -> list[str]:
    """The statements of a script: its text at semicolons outside of quotes and comments, without those that hold no code."""
    parts, at = [], 0
    for m in _ENDS.finditer(script):
        if m[1] is None:
            parts.append(script[at : m.start()])
            at = m.end()
    return [p.strip() for p in [*parts, script[at:]] if not _NO_CODE.fullmatch(p)]


def spark_form(statement: str) -> str:
    """A statement with names in double quotes as Spark quotes them, and ``SELECT TOP n`` at its start as ``LIMIT n`` at its end."""
    text = _QUOTED.sub(lambda m: m[1] if m[1] is not None else f"`{m[2]}`", statement)
    start = _NO_CODE.match(text).end()
    top = _TOP.match(text, start)
    return f"{text[:start]}SELECT {text[top.end():]}\nLIMIT {top[1]}" if top else text
