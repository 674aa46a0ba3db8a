"""Tokens of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ledgerloom.lang.errors import SyntaxProblem

KEYWORDS = frozenset(
    "SELECT FROM WHERE ORDER BY LIMIT OFFSET AS AND OR NOT LIKE ILIKE IS NULL TRUE FALSE IN BETWEEN EXISTS ZIP INNER LEFT CROSS ON ASC DESC NULLS FIRST LAST "
    "VALIDATE WITH FAIL_FAST ANALYZE INCLUDE_SCORES BASELINE WINDOW DAYS THRESHOLD METRICS CROSS_VALIDATE TOLERANCE AGGREGATE INTO GRAPH TRAVERSE ENRICH DEPTH "
    "FILTER SORT TAKE TRANSFORM".split()
)
#: Words that may also name a column.
SOFT = frozenset("WINDOW DAYS THRESHOLD METRICS BASELINE FIRST LAST DEPTH FILTER SORT TAKE TRANSFORM VALIDATE ANALYZE GRAPH INTO TOLERANCE".split())

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*)
    |(?P<float>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
    |(?P<int>\d+)
    |(?P<string>'(?:[^']|'')*'|"(?:[^"]|"")*")
    |(?P<param>:[A-Za-z_]\w*)
    |(?P<word>[^\W\d]\w*)
    |(?P<op>\|>|<=|>=|<>|!=|[-+*/%=<>(),.\[\]])""",
    re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str  # float, int, string, param, word, op, end
    text: str
    at: int

    @property
    def key(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected character {text[at]!r}", text, at, "strings are quoted with ' or \"")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return [*out, Token("end", "", len(text))]
