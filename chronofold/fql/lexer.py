"""Tokens of the feature query language. Keywords are whole words, so names may begin with one."""

from __future__ import annotations

import re
from dataclasses import dataclass


class QueryError(ValueError):
    """A query that can't be read or bound."""


@dataclass(frozen=True)
class Token:
    kind: str  # number, string, word, context, op, end
    text: str
    at: int
    end: int


_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*)
      |(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\d+(?![A-Za-z_.\d]))
      |(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")
      |(?P<context>@[A-Za-z0-9_.]+)
      |(?P<word>[A-Za-z0-9_][A-Za-z0-9_.]*)
      |(?P<op>:=|==|<>|!=|<=|>=|[-+*/^=<>(),])""",
    re.X | re.S,
)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise QueryError(f"unexpected {text[at]!r} at {at} in {text!r}")
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    return [*out, Token("end", "", len(text), len(text))]
