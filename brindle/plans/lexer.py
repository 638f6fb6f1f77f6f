"""Tokens of the dialect: case-insensitive words, integers, quoted strings with backslash escapes, comments."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import BadSyntax

#: The reserved words.
KEYWORDS = frozenset("select from where and insert into values delete update set create table view as index on using int int8 int64 varchar hash btree".split())

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<string>'(?:\\.|[^'\\\n])*')
      | (?P<number>[+-]?(?:0[xX][0-9a-fA-F_]+|0[oObB][0-9_]+|[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9]+)?))
      | (?P<word>[^\W\d]\w*)
      | (?P<sign>[(),=.+\-*/%])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(.)", re.S)
_LETTERS = {"n": "\n", "t": "\t"}


@dataclass(frozen=True)
class Token:
    kind: str  # string, number, word, keyword, sign
    text: str


def unescape(body: str) -> str:
    r"""\n, \t and \\ as usual; any other escaped character stands for itself."""
    return _ESCAPE.sub(lambda m: _LETTERS.get(m[1], m[1]), body)


def escape(value: str) -> str:
    return value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t")


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise BadSyntax(f"unexpected {text[at : at + 10]!r}")
        kind, body = m.lastgroup, m[0]
        at = m.end()
        if kind == "word":
            body = body.lower()
            kind = "keyword" if body in KEYWORDS else "word"
        elif kind == "string":
            body = unescape(body[1:-1])
        if kind != "space":
            out.append(Token(kind, body))
    return out
