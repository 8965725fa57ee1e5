"""Words, numbers, strings and marks of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>--[^\n]*|\#[^\n]*|//[^\n]*)|(?P<number>(?:\d+\.\d+|\d+\.(?!\w)|\.\d+|\d+)(?:[eE][+-]?\d+)?)"
    r"|(?P<string>\"[^\"]*\"|'[^']*')|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<mark><=|>=|!=|<>|~=|[-+*/=<>()\[\],:.?;])"
)


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokenize(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise ParseError(f"unexpected {source[at]!r} at {at}")
        if m.lastgroup not in ("space", "comment"):
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return out


def split_statements(source: str) -> list[str]:
    """A script's statements. One ends with its line, unless a bracket is open, the line
    ends in a comma or THEN, or the next line goes on with a clause word."""
    out: list[str] = []
    depth, held = 0, ""
    lines = source.split("\n")
    for k, line in enumerate(lines):
        tokens = tokenize(line)
        if not tokens and not held:
            continue
        depth += sum((t.text in ("(", "[")) - (t.text in (")", "]")) for t in tokens if t.kind == "mark")
        held += ("\n" if held else "") + line
        following = next((tokenize(x) for x in lines[k + 1 :] if x.strip() and tokenize(x)), [])
        goes_on = following and following[0].kind == "word" and following[0].text in CLAUSES
        # A WITH goes on until its own SELECT has come.
        if depth <= 0 and following and following[0].text == "SELECT" and _awaits_select(tokenize(held)):
            goes_on = True
        open_end = tokens and (tokens[-1].text in (",", "THEN", "AND", "OR", "UNION", "ALL", "AS", "="))
        if depth <= 0 and not goes_on and not open_end:
            if tokenize(held):
                out.append(held)
            held, depth = "", 0
    if tokenize(held):
        out.append(held)
    return out


def _awaits_select(tokens: list[Token]) -> bool:
    depth = 0
    for t in tokens:
        depth += (t.text in ("(", "[")) - (t.text in (")", "]")) if t.kind == "mark" else 0
        if depth == 0 and t.text == "SELECT":
            return False
    return bool(tokens) and "WITH" in (tokens[0].text, tokens[min(1, len(tokens) - 1)].text)


#: Words that start a clause, never a statement.
CLAUSES = frozenset("FROM WHERE FILTER GROUP HAVING ORDER LIMIT OFFSET JOIN INNER LEFT RIGHT FULL UNION THEN ON INTO COLUMNS VALUES AND OR WHEN ELSE END AS FIELDS TO QUERY K".split())
