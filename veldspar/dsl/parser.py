"""Statements of the query language as small tuples and dataclasses.

Keywords are upper case; a lower-case word is always a name. Expressions are tuples whose
first member names the node; precedence is that of standard SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .lexer import ParseError, Token, tokenize

Expr = tuple

AGGREGATES = ("SUM", "AVG", "COUNT", "MIN", "MAX", "AVG_VEC", "SUM_VEC")
RANKS = ("ROW_NUMBER", "RANK", "DENSE_RANK")
OFFSETS = ("LAG", "LEAD")
#: Words that end an expression list and so are never an alias.
RESERVED = frozenset(
    "SELECT FROM WHERE FILTER GROUP HAVING ORDER LIMIT OFFSET JOIN INNER LEFT RIGHT FULL OUTER ON UNION AS AND OR NOT IN IS BETWEEN CASE WHEN THEN ELSE END BY ASC DESC INTO WITH TO LAZY VALUES SET".split()
)


@dataclass
class Item:
    expr: Expr
    alias: str | None = None


@dataclass
class Join:
    source: Any
    alias: str | None
    how: str
    on: Expr


@dataclass
class Select:
    items: list[Item]
    source: Any  # a name or a Select
    alias: str | None = None
    distinct: bool = False
    joins: list[Join] = field(default_factory=list)
    where: Expr | None = None
    group: list[Expr] = field(default_factory=list)
    having: Expr | None = None
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    ctes: list[tuple[str, Select]] = field(default_factory=list)
    union: tuple[bool, Select] | None = None  # (keep all, right)


@dataclass
class Statement:
    kind: str
    args: dict[str, Any]

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["args"][name]
        except KeyError:
            raise AttributeError(name) from None


STAR = ("star",)


class Parser:
    def __init__(self, source: str):
        self.written, self.tokens, self.at = source, tokenize(source), 0

    # --- tokens ---

    def peek(self, ahead: int = 0) -> Token | None:
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else None

    def text(self, ahead: int = 0) -> str | None:
        t = self.peek(ahead)
        return t.text if t and t.kind != "string" else None

    def fail(self, wanted: str) -> ParseError:
        t = self.peek()
        return ParseError(f"expected {wanted}, found {t.text if t else 'the end'} in: {self.written.strip()[:120]}")

    def skip(self, *words: str) -> bool:
        """Pass the words if they come next, in this order."""
        if all(self.text(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        for w in words:
            if not self.skip(w):
                raise self.fail(w)

    def any_of(self, *words: str) -> str | None:
        if self.text() in words:
            self.at += 1
            return self.tokens[self.at - 1].text
        return None

    def name(self) -> str:
        t = self.peek()
        if not t or t.kind not in ("word", "string"):
            raise self.fail("a name")
        self.at += 1
        return t.text.strip("\"'") if t.kind == "string" else t.text

    def word(self) -> str:
        t = self.peek()
        if not t or t.kind != "word":
            raise self.fail("a name")
        self.at += 1
        return t.text

    def string(self) -> str:
        t = self.peek()
        if not t or t.kind != "string":
            raise self.fail("a string")
        self.at += 1
        return t.text[1:-1]

    def number(self) -> float:
        minus = self.skip("-")
        t = self.peek()
        if not t or t.kind != "number":
            raise self.fail("a number")
        self.at += 1
        v = float(t.text) if any(c in t.text for c in ".eE") else int(t.text)
        return -v if minus else v

    def whole(self) -> int:
        v = self.number()
        if v != int(v):
            raise self.fail("a whole number")
        return int(v)

    def listed(self, part, close: str | None = None) -> list:
        out = [part()]
        while self.skip(","):
            out.append(part())
        if close:
            self.need(close)
        return out

    # --- expressions ---

    def expr(self) -> Expr:
        left = self.conjunction()
        while self.skip("OR"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self) -> Expr:
        left = self.negation()
        while self.skip("AND"):
            left = ("and", left, self.negation())
        return left

    def negation(self) -> Expr:
        return ("not", self.negation()) if self.skip("NOT") else self.predicate()

    def predicate(self) -> Expr:
        left = self.sum()
        while True:
            if op := self.any_of("=", "!=", "<>", "<=", ">=", "<", ">"):
                left = ("compare", "!=" if op == "<>" else op, left, self.sum())
            elif self.skip("IS", "NOT", "NULL"):
                left = ("not", ("isnull", left))
            elif self.skip("IS", "NULL"):
                left = ("isnull", left)
            elif self.text() in ("IN", "NOT") and (self.text() == "IN" or self.text(1) in ("IN", "BETWEEN")):
                negated = self.skip("NOT")
                if self.skip("IN"):
                    self.need("(")
                    left = ("in", left, self.listed(self.expr, ")"))
                else:
                    left = self.between(left)
                left = ("not", left) if negated else left
            elif self.text() == "BETWEEN":
                left = self.between(left)
            else:
                return left

    def between(self, left: Expr) -> Expr:
        self.need("BETWEEN")
        low = self.sum()
        self.need("AND")
        return ("between", left, low, self.sum())

    def sum(self) -> Expr:
        left = self.product()
        while op := self.any_of("+", "-"):
            left = ("arith", op, left, self.product())
        return left

    def product(self) -> Expr:
        left = self.unary()
        while op := self.any_of("*", "/"):
            left = ("arith", op, left, self.unary())
        return left

    def unary(self) -> Expr:
        if self.skip("-"):
            e = self.unary()
            return ("lit", -e[1]) if e[0] == "lit" and isinstance(e[1], int | float) else ("neg", e)
        return self.primary()

    def primary(self) -> Expr:
        t = self.peek()
        if t is None:
            raise self.fail("an expression")
        if t.kind == "number":
            return ("lit", self.number())
        if t.kind == "string":
            return ("lit", self.string())
        if self.skip("("):
            e = self.expr()
            self.need(")")
            return e
        if t.text == "[":
            return self.bracketed()
        if t.kind != "word":
            raise self.fail("an expression")
        if self.text(1) != "(":
            if t.text in ("true", "false", "TRUE", "FALSE"):
                self.at += 1
                return ("lit", t.text.lower() == "true")
            if t.text in ("NULL", "null"):
                self.at += 1
                return ("lit", None)
        if t.text == "CASE":
            return self.case()
        if t.text in RESERVED:
            raise self.fail("an expression")
        if self.text(1) == "(":
            return self.call()
        name = self.word()
        if self.skip("."):
            return ("col", name, "*" if self.skip("*") else self.word())
        return ("col", None, name)

    def bracketed(self) -> Expr:
        self.need("[")
        if self.text() == "[":
            rows = [self._numbers()]
            while self.skip(","):
                rows.append(self._numbers())
            self.need("]")
            if len({len(r) for r in rows}) > 1:
                raise ParseError("a matrix literal has rows of different length")
            return ("matrix", rows)
        if self.skip("]"):
            return ("vector", [])
        return ("vector", self.listed(self.number, "]"))

    def _numbers(self) -> list[float]:
        self.need("[")
        return [] if self.skip("]") else self.listed(self.number, "]")

    def case(self) -> Expr:
        self.need("CASE")
        operand = None if self.text() == "WHEN" else self.expr()
        arms = []
        while self.skip("WHEN"):
            when = self.expr()
            self.need("THEN")
            arms.append((when, self.expr()))
        if not arms:
            raise self.fail("WHEN")
        otherwise = self.expr() if self.skip("ELSE") else None
        self.need("END")
        return ("case", operand, arms, otherwise)

    def type_name(self) -> tuple[str, list[int] | None]:
        word = self.word().upper()
        dims = None
        if close := {"(": ")", "[": "]"}.get(self.text() or ""):
            self.at += 1
            dims = self.listed(self.whole, close)
        return word, dims

    def call(self) -> Expr:
        f = self.word().upper()
        self.need("(")
        if f == "CAST":
            e = self.expr()
            self.need("AS")
            kind, dims = self.type_name()
            self.need(")")
            return ("cast", e, kind, dims)
        if f in AGGREGATES and self.skip("*"):
            args: list[Expr] = [STAR]
            self.need(")")
        else:
            args = [] if self.skip(")") else self.listed(self.expr, ")")
        if self.skip("OVER"):
            return ("window", f, args, *self.window())
        if f in RANKS + OFFSETS:
            raise self.fail("OVER")
        return ("agg", f, args[0]) if f in AGGREGATES and len(args) == 1 else ("call", f, args)

    def window(self) -> tuple[list[Expr], list[tuple[Expr, bool]]]:
        self.need("(")
        partition = self.listed(self.expr) if self.skip("PARTITION", "BY") else []
        order = self.listed(self.order_key) if self.skip("ORDER", "BY") else []
        self.need(")")
        return partition, order

    def order_key(self) -> tuple[Expr, bool]:
        e = self.expr()
        down = self.skip("DESC")
        if not down:
            self.skip("ASC")
        return e, down

    # --- SELECT ---

    def select_statement(self) -> Select:
        ctes = []
        if self.skip("WITH"):
            while True:
                name = self.word()
                self.need("AS", "(")
                ctes.append((name, self.select_statement()))
                self.need(")")
                if not self.skip(","):
                    break
        s = self.select()
        s.ctes = ctes
        return s

    def items(self) -> list[Item]:
        return self.listed(self.item)

    def item(self) -> Item:
        if self.skip("*"):
            return Item(STAR)
        e = self.expr()
        if self.skip("AS"):
            return Item(e, self.name())
        t = self.peek()
        return Item(e, self.word()) if t and t.kind == "word" and t.text not in RESERVED and t.text not in ("K", "OVER") else Item(e)

    def source(self) -> tuple[Any, str | None]:
        if self.skip("("):
            inner = self.select_statement()
            self.need(")")
            self.skip("AS")
            return inner, self.word()
        name = self.name()
        if self.skip("AS"):
            return name, self.word()
        t = self.peek()
        return (name, self.word()) if t and t.kind == "word" and t.text not in RESERVED else (name, None)

    def select(self) -> Select:
        self.need("SELECT")
        distinct = self.skip("DISTINCT")
        items = self.items()
        self.need("FROM")
        source, alias = self.source()
        s = Select(items, source, alias, distinct)
        while True:
            how = "inner"
            mark = self.at
            if kind := self.any_of("INNER", "LEFT", "RIGHT", "FULL"):
                how = kind.lower()
                self.skip("OUTER")
            if not self.skip("JOIN"):
                self.at = mark
                break
            right, name = self.source()
            self.need("ON")
            s.joins.append(Join(right, name, how, self.expr()))
        self.clauses(s)
        if self.skip("UNION"):
            s.union = (self.skip("ALL"), self.select_statement())
        return s

    def clauses(self, s: Select, with_select: bool = False) -> None:
        """WHERE to OFFSET, in any order."""
        while True:
            if self.any_of("WHERE", "FILTER"):
                e = self.expr()
                s.where = e if s.where is None else ("and", s.where, e)
            elif self.skip("GROUP", "BY"):
                s.group = self.listed(self.expr)
            elif self.skip("HAVING"):
                s.having = self.expr()
            elif self.skip("ORDER", "BY"):
                s.order = self.listed(self.order_key)
            elif self.skip("LIMIT"):
                s.limit = self.whole()
            elif self.skip("OFFSET"):
                s.offset = self.whole()
            elif with_select and self.skip("SELECT"):
                s.distinct = self.skip("DISTINCT")
                s.items = self.items()
            else:
                return

    # --- tensor expressions ---

    def tensor(self) -> Expr:
        left = self.tensor_term()
        while op := self.any_of("+", "-"):
            left = ("binary", {"+": "ADD", "-": "SUBTRACT"}[op], left, self.tensor_term())
        return left

    def tensor_term(self) -> Expr:
        left = self.tensor_factor()
        while op := self.any_of("*", "/"):
            left = ("binary", {"*": "MULTIPLY", "/": "DIVIDE"}[op], left, self.tensor_factor())
        return left

    def tensor_factor(self) -> Expr:
        """One operand: a name, literal, call, index, or bracketed expression."""
        t = self.peek()
        if t is None:
            raise self.fail("a tensor expression")
        if t.kind == "number" or t.text == "-" and self.peek(1) and self.peek(1).kind == "number":
            return ("lit", self.number())
        if self.skip("-"):
            return ("binary", "MULTIPLY", ("lit", -1), self.tensor_factor())
        if self.skip("("):
            e = self.tensor()
            self.need(")")
            return self.indexed(e)
        if t.text == "[":
            return self.bracketed()
        one = self.tensor_factor
        if t.kind == "word":
            f = t.text
            if f in ("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE"):
                self.at += 1
                return ("binary", f, *self.operands(2))
            if f == "MATMUL":
                self.at += 1
                return ("matmul", *self.operands(2))
            if f in ("TRANSPOSE", "FLATTEN", "NORMALIZE", "SUM", "MEAN", "STDEV", "FFT", "IFFT", "MAGNITUDE"):
                self.at += 1
                return ("unary", f, one())
            if f == "SCALE":
                self.at += 1
                a = one()
                self.need("BY")
                return ("scale", a, self.number())
            if f == "RESHAPE":
                self.at += 1
                a = one()
                self.need("TO", "[")
                return ("reshape", a, self.listed(self.whole, "]"))
            if f == "STACK":
                self.at += 1
                out = [one()]
                while (n := self.peek()) and (n.kind == "word" or n.text in ("(", "[", ",")):
                    self.skip(",")
                    out.append(one())
                return ("stack", out)
            for word, middle, kind in (("CORRELATE", "WITH", "correlate"), ("SIMILARITY", "WITH", "similarity"), ("DISTANCE", "TO", "distance"), ("WHITEN", "WITH", "whiten"), ("MATCHED_FILTER", "WITH", "matched_filter")):
                if f == word:
                    self.at += 1
                    a = one()
                    self.need(middle)
                    return ("pair", kind, a, one())
            if f == "PSD":
                self.at += 1
                a = one()
                self.need("WINDOW")
                return ("psd", a, self.whole())
            if f == "BANDPASS":
                self.at += 1
                a = one()
                self.need("FROM")
                low = self.number()
                self.need("TO")
                high = self.number()
                self.need("WITH", "RATE")
                return ("bandpass", a, low, high, self.number())
            if f == "dataset" and self.text(1) == "(":
                self.at += 2
                name = self.name()
                self.need(")")
                return ("dataset", name)
            name = self.word()
            if self.skip("."):
                return self.indexed(("field", name, self.word()))
            return self.indexed(("name", name))
        raise self.fail("a tensor expression")

    def operands(self, n: int) -> list[Expr]:
        out = [self.tensor_factor()]
        while len(out) < n:
            self.skip(",")
            out.append(self.tensor_factor())
        return out

    def indexed(self, e: Expr) -> Expr:
        # A bracket right after the operand indexes it; one after a space starts a literal.
        t, before = self.peek(), self.tokens[self.at - 1]
        if not t or t.text != "[" or t.at != before.at + len(before.text):
            return e
        self.need("[")
        parts = self.listed(self.slice_part, "]")
        return ("index", e, parts)

    def slice_part(self) -> int | tuple[int | None, int | None]:
        if self.skip("*"):
            return (None, None)
        low = None if self.text() == ":" else self.whole()
        if not self.skip(":"):
            return low
        high = self.whole() if (t := self.peek()) and t.kind == "number" else None
        return (low, high)
