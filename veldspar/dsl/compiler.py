"""From parsed queries to DataFrames: nothing here evaluates a row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as V
from ..functions.aggregates import vec_agg
from ..functions.scalar import is_int
from ..operators.join import equi_join, rename_right, similarity_join
from ..operators.order import limit_offset, union
from ..operators.window import AGGREGATES as WINDOW_AGGREGATES
from ..operators.window import RANKS, running_frame, running_vec_column, spec
from ..types import KEY, SCALARS, dims_of, is_matrix, is_tensor
from .parser import Expr, Item, Select

Resolve = Callable[[str], DataFrame]


class QueryError(ValueError):
    pass


@dataclass
class Typed:
    """A column of a frame, whose type is asked of the analyser when it matters."""

    column: Column
    frame: DataFrame
    known: list[int] | None = None

    @cached_property
    def kind(self) -> T.DataType:
        return self.frame.select(self.column).schema[0].dataType

    @property
    def tensor(self) -> bool:
        return is_tensor(self.kind)

    @property
    def matrix(self) -> bool:
        return is_matrix(self.kind)


class Scope:
    """A frame and the names its columns go by: bare, or under an alias."""

    def __init__(self, frame: DataFrame):
        self.frame = frame
        self.sides: dict[str, dict[str, str]] = {}

    def actual(self, qualifier: str | None, name: str) -> str:
        if qualifier and name in self.sides.get(qualifier, {}):
            return self.sides[qualifier][name]
        if name in self.frame.columns:
            return name
        raise QueryError(f"unknown column {qualifier + '.' if qualifier else ''}{name}; there are {', '.join(self.frame.columns)}")

    def on(self, frame: DataFrame) -> Scope:
        out = Scope(frame)
        out.sides = self.sides
        return out


class Compiler:
    """Compiles expressions and SELECTs; `resolve` gives the DataFrame of a dataset's name."""

    def __init__(self, resolve: Resolve):
        self.resolve = resolve

    # --- expressions ---

    def value(self, e: Expr, scope: Scope) -> Typed:
        return getattr(self, f"e_{e[0]}")(scope, *e[1:])

    def column(self, e: Expr, scope: Scope) -> Column:
        return self.value(e, scope).column

    def _typed(self, c: Column, scope: Scope, dims: list[int] | None = None) -> Typed:
        return Typed(c, scope.frame, dims)

    def e_col(self, scope: Scope, qualifier: str | None, name: str) -> Typed:
        actual = scope.actual(qualifier, name)
        return self._typed(F.col(f"`{actual}`"), scope, dims_of(scope.frame, actual))

    def e_lit(self, scope: Scope, v: object) -> Typed:
        return self._typed(F.lit(v) if not isinstance(v, int) or isinstance(v, bool) else F.lit(v).cast("bigint"), scope)

    def e_vector(self, scope: Scope, values: list[float]) -> Typed:
        return self._typed(V.vector_literal(values), scope, [len(values)])

    def e_matrix(self, scope: Scope, rows: list[list[float]]) -> Typed:
        return self._typed(V.matrix_literal(rows), scope, [len(rows), len(rows[0])])

    def e_and(self, scope: Scope, a: Expr, b: Expr) -> Typed:
        return self._typed(self.column(a, scope) & self.column(b, scope), scope)

    def e_or(self, scope: Scope, a: Expr, b: Expr) -> Typed:
        return self._typed(self.column(a, scope) | self.column(b, scope), scope)

    def e_not(self, scope: Scope, a: Expr) -> Typed:
        return self._typed(~self.column(a, scope), scope)

    def e_isnull(self, scope: Scope, a: Expr) -> Typed:
        return self._typed(self.column(a, scope).isNull(), scope)

    def e_in(self, scope: Scope, a: Expr, values: list[Expr]) -> Typed:
        return self._typed(self.column(a, scope).isin(*[self.column(v, scope) for v in values]), scope)

    def e_between(self, scope: Scope, a: Expr, low: Expr, high: Expr) -> Typed:
        return self._typed(self.column(a, scope).between(self.column(low, scope), self.column(high, scope)), scope)

    def e_compare(self, scope: Scope, op: str, a: Expr, b: Expr) -> Typed:
        x, y = self.column(a, scope), self.column(b, scope)
        made = {"=": x.__eq__, "!=": x.__ne__, "<": x.__lt__, "<=": x.__le__, ">": x.__gt__, ">=": x.__ge__}[op](y)
        return self._typed(made, scope)

    def e_case(self, scope: Scope, operand: Expr | None, arms: list[tuple[Expr, Expr]], otherwise: Expr | None) -> Typed:
        own = self.column(operand, scope) if operand else None
        out = None
        for when, then in arms:
            c = self.column(when, scope) if own is None else own == self.column(when, scope)
            out = F.when(c, self.column(then, scope)) if out is None else out.when(c, self.column(then, scope))
        return self._typed(out if otherwise is None else out.otherwise(self.column(otherwise, scope)), scope)

    def e_neg(self, scope: Scope, a: Expr) -> Typed:
        return self._typed(-self.column(a, scope), scope)

    def e_arith(self, scope: Scope, op: str, a: Expr, b: Expr) -> Typed:
        x, y = self.value(a, scope), self.value(b, scope)
        if x.matrix and (y.matrix or not y.tensor):
            return self._typed(V.mat_arith(op, x.column, y.column, scalar=not y.matrix), scope, x.known)
        if x.tensor or y.tensor:
            return self._typed(F.lit(None).cast("float"), scope)
        if op == "/":
            return self._typed(V.div(x.column, y.column, is_int(x.kind) and is_int(y.kind)), scope)
        return self._typed({"+": x.column + y.column, "-": x.column - y.column, "*": x.column * y.column}[op], scope)

    def e_cast(self, scope: Scope, a: Expr, kind: str, dims: list[int] | None) -> Typed:
        x = self.value(a, scope)
        if dims is not None:
            if len(dims) == 1:
                return self._typed(V.as_vector(x.column, dims[0], x.matrix), scope, dims)
            return self._typed(V.as_matrix(x.column, *dims, matrix=x.matrix), scope, dims)
        to = SCALARS.get(kind)
        if to is None:
            raise QueryError(f"unknown type {kind}")
        if isinstance(to, T.BooleanType):
            return self._typed(V.cast_bool(x.column, x.kind), scope)
        if is_int(to):
            return self._typed(V.cast_int(x.column, x.kind), scope)
        return self._typed(x.column.try_cast(to), scope)

    def e_agg(self, scope: Scope, *_: object) -> Typed:
        raise QueryError("an aggregate is not allowed here")

    def e_window(self, scope: Scope, *_: object) -> Typed:
        raise QueryError("a window function is allowed in the SELECT list only")

    def e_star(self, scope: Scope) -> Typed:
        raise QueryError("* is not an expression")

    def e_call(self, scope: Scope, f: str, args: list[Expr]) -> Typed:
        made = self.function(f, [self._operand(a, scope) for a in args], [self.value(a, scope) for a in args])
        return made if isinstance(made, Typed) else self._typed(made, scope)

    def _operand(self, e: Expr, scope: Scope) -> Column | list[float]:
        """Vector literals stay lists: against them the vector functions unroll."""
        return e[1] if e[0] == "vector" else self.column(e, scope)

    def function(self, f: str, a: list, typed: list[Typed]) -> Column:
        n = len(a)
        fixed: dict[str, tuple[int, int]] = {
            "UPPER": (1, 1), "LOWER": (1, 1), "LENGTH": (1, 1), "TRIM": (1, 1), "CONCAT": (1, 99), "SUBSTR": (2, 3), "COALESCE": (1, 99), "NULLIF": (2, 2), "IFNULL": (2, 2),
            "NORMALIZE": (1, 1), "L2_NORM": (1, 1), "COSINE_SIM": (2, 2), "DOT": (2, 2), "DISTANCE": (2, 2), "VEC_ADD": (2, 2), "VEC_SCALE": (2, 2), "MATMUL": (2, 2),
            "TRANSPOSE": (1, 1), "FLATTEN": (1, 1), "MAT_SHAPE": (1, 1),
        }
        if f not in fixed:
            raise QueryError(f"unknown function {f}")
        if not fixed[f][0] <= n <= fixed[f][1]:
            raise QueryError(f"{f} takes {fixed[f][0]} to {fixed[f][1]} arguments, not {n}")
        c = [t.column for t in typed]
        if f in ("UPPER", "LOWER", "LENGTH", "TRIM"):
            return {"UPPER": F.upper, "LOWER": F.lower, "LENGTH": V.length, "TRIM": V.trim}[f](c[0])
        if f == "CONCAT":
            return V.concat_text(*[t.column for t in typed if isinstance(t.kind, T.StringType)])
        if f == "SUBSTR":
            return V.substr(*c)
        if f == "COALESCE":
            return F.coalesce(*c)
        if f in ("NULLIF", "IFNULL"):
            return V.nullif(*c)
        if f == "NORMALIZE":
            return V.normalize(c[0])
        if f == "L2_NORM":
            return V.l2_norm(c[0])
        if f in ("COSINE_SIM", "DOT", "DISTANCE"):
            return {"COSINE_SIM": V.cosine_sim, "DOT": V.dot, "DISTANCE": V.distance}[f](*(c if all(isinstance(x, list) for x in a) else a))
        if f == "VEC_ADD":
            return V.vec_add(*c)
        if f == "VEC_SCALE":
            return V.vec_scale(*c)
        if f == "MATMUL":
            return V.matmul(c[0], c[1], vector=not typed[1].matrix) if typed[0].matrix else F.lit(None).cast("array<float>")
        if f == "TRANSPOSE":
            return V.transpose(c[0]) if typed[0].matrix else F.lit(None).cast("array<array<float>>")
        if f == "FLATTEN":
            return V.flatten(c[0], typed[0].matrix)
        return V.mat_shape(c[0], typed[0].matrix)

    # --- names ---

    def label(self, e: Expr) -> str:
        """How an aggregate is called where it has no alias."""
        if e[0] == "agg":
            arg = e[2]
            return f"{e[1]}({arg[2] if arg[0] == 'col' else '*' if arg[0] == 'star' else 'val'})"
        return e[2] if e[0] == "col" else "__expr"

    # --- SELECT ---

    def select(self, s: Select, outer: Resolve | None = None) -> DataFrame:
        resolve = outer or self.resolve
        if s.ctes:
            names: dict[str, DataFrame] = {}
            base = resolve
            resolve = lambda n: names[n] if n in names else base(n)
            for name, inner in s.ctes:
                names[name] = self.select(inner, resolve)
        out = self._single(s, resolve)
        if s.union:
            keep_all, right = s.union
            out = union(out, self.select(right, resolve), keep_all)
        return out

    def _source(self, source: object, alias: str | None, resolve: Resolve) -> tuple[DataFrame, list[str]]:
        if isinstance(source, Select):
            return self.select(source, resolve), [alias] if alias else []
        return resolve(source), [x for x in (source, alias) if x]

    def _joined(self, s: Select, resolve: Resolve) -> Scope:
        frame, names = self._source(s.source, s.alias, resolve)
        scope = Scope(frame)
        for n in names:
            scope.sides[n] = {c: c for c in frame.columns}
        for j in s.joins:
            right, names = self._source(j.source, j.alias, resolve)
            renamed = rename_right(scope.frame, right)[1]
            own = Scope(right)
            own.sides = {n: {c: c for c in right.columns} for n in names}
            frame = self._join(scope, own, j.how, j.on)
            scope = scope.on(frame)
            scope.sides = dict(scope.sides)
            for n in names:
                if j.alias is None or n == j.alias or n not in scope.sides:
                    scope.sides[n] = renamed
        return scope

    def _side(self, e: Expr, left: Scope, right: Scope) -> tuple[str, str]:
        """Which side a join key is of, and its name there."""
        if e[0] != "col":
            raise QueryError("a join key must be a column")
        _, q, name = e
        if q and q in right.sides and name in right.frame.columns:
            return "right", name
        if q and q in left.sides and name in left.sides[q]:
            return "left", left.sides[q][name]
        if name in left.frame.columns:
            return "left", name
        if name in right.frame.columns:
            return "right", name
        raise QueryError(f"unknown column {name} in ON")

    def _keys(self, a: Expr, b: Expr, left: Scope, right: Scope) -> tuple[str, str]:
        (sa, x), (sb, y) = self._side(a, left, right), self._side(b, left, right)
        if sa == sb:  # the same bare name on both sides, or written right side first
            if a[2] in left.frame.columns and b[2] in right.frame.columns:
                return a[2], b[2]
            if b[2] in left.frame.columns and a[2] in right.frame.columns:
                return b[2], a[2]
            raise QueryError("ON must compare a column of each side")
        return (x, y) if sa == "left" else (y, x)

    def _join(self, left: Scope, right: Scope, how: str, on: Expr) -> DataFrame:
        if on[0] == "compare" and on[1] in (">", ">=") and on[2][0] == "call" and on[2][1] == "COSINE_SIM" and on[3][0] == "lit":
            x, y = self._keys(*on[2][2], left, right)
            return similarity_join(left.frame, right.frame, x, y, float(on[3][1]), how, strict=on[1] == ">")
        parts, keys = [on], []
        while parts:
            p = parts.pop()
            if p[0] == "and":
                parts += [p[2], p[1]]
            elif p[0] == "compare" and p[1] == "=":
                keys.append(self._keys(p[2], p[3], left, right))
            else:
                raise QueryError("ON takes equalities of columns, or COSINE_SIM(a, b) > threshold")
        return equi_join(left.frame, right.frame, keys, how)

    def _single(self, s: Select, resolve: Resolve) -> DataFrame:
        scope = self._joined(s, resolve)
        if s.where is not None:
            scope = scope.on(scope.frame.filter(self.column(s.where, scope)))
        if s.group or any(_has(i.expr, "agg") for i in s.items) or s.having is not None:
            return self._aggregated(s, scope)
        return self._finish(s, scope, s.items, s.order)

    def _order_alias(self, e: Expr, items: list[Item]) -> str | None:
        for i in items:
            if i.alias and e[0] == "col" and e[1] is None and e[2] == i.alias:
                return i.alias
        return None

    def _finish(self, s: Select, scope: Scope, items: list[Item], order: list[tuple[Expr, bool]]) -> DataFrame:
        """Windows, projection, DISTINCT, ORDER BY, LIMIT and OFFSET."""
        names, columns, frame = [], [], scope.frame
        for k, i in enumerate(items):
            if i.expr == ("star",) or i.expr[0] == "col" and i.expr[2] == "*":
                for c in frame.columns if i.expr == ("star",) else scope.sides.get(i.expr[1], {}).values():
                    if not c.startswith("__w"):
                        names.append(c)
                        columns.append(F.col(f"`{c}`"))
                continue
            e, own = i.expr, scope
            if _has(e, "window"):
                frame, e = self._windowed(e, scope.on(frame), f"__w{k}")
                own = scope.on(frame)
            name = i.alias or (e[2] if i.expr[0] == "col" and i.expr[1] is None else self._window_name(i.expr) if i.expr[0] == "window" else f"__cmp_{k}")
            v = self.value(e, own)
            known = v.known
            columns.append(v.column.alias(name, metadata={KEY: {"dims": known}}) if known else v.column.alias(name))
            names.append(name)
            if i.expr[0] == "window" and i.alias:  # later windows may name it
                frame = frame.withColumn(i.alias, v.column) if i.alias not in frame.columns else frame
        hidden = []
        keys: list[tuple[str, bool]] = []
        own = scope.on(frame)
        for k, (e, down) in enumerate(order):
            alias = self._order_alias(e, items)
            if alias or e[0] == "col" and e[2] in names and (e[1] is None):
                keys.append((alias or e[2], down))
            else:
                hidden.append(self.column(e, own).alias(f"__o{k}"))
                keys.append((f"__o{k}", down))
        out = frame.select(*columns, *hidden)
        if s.distinct:
            if hidden:
                raise QueryError("SELECT DISTINCT can only be ordered by what it selects")
            out = out.distinct()
        if keys:
            out = self._sorted(out, keys)
        out = limit_offset(out, s.limit, s.offset)
        return out.drop(*[f"__o{k}" for k in range(len(order))]) if hidden else out

    def _sorted(self, df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
        from ..operators.order import order_by

        return order_by(df, keys)

    # --- aggregates ---

    def _aggregate(self, e: Expr, scope: Scope) -> Column:
        _, f, arg = e
        if f == "COUNT":
            return F.count(F.lit(1) if arg[0] in ("star", "lit") else self.column(arg, scope))
        if arg[0] == "star":
            raise QueryError(f"{f}(*) means nothing")
        v = self.value(arg, scope)
        kind = {"SUM_VEC": "sum", "AVG_VEC": "avg"}.get(f, f.lower())
        if v.tensor:
            dims = v.known if v.known and all(v.known) else self._probe(v)
            return vec_agg(kind, v.column, dims)
        if f.endswith("_VEC"):
            raise QueryError(f"{f} takes a vector column")
        made = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[kind](v.column)
        return made

    def _probe(self, v: Typed) -> list[int]:
        """Dimensions of a tensor column without metadata: one pass over its sizes."""
        sizes = [F.max(F.size(v.column)).alias("a")]
        if v.matrix:
            sizes.append(F.max(F.size(F.get(v.column, F.lit(0)))).alias("b"))
        got = v.frame.filter(v.column.isNotNull()).agg(*sizes).first()
        return [x or 0 for x in got]

    def _aggregated(self, s: Select, scope: Scope) -> DataFrame:
        keys: list[tuple[str, Expr]] = []
        for e in s.group:
            if e[0] != "col":
                raise QueryError("GROUP BY takes columns")
            keys.append((scope.actual(e[1], e[2]), e))
        found: list[Expr] = []

        def collect(e: object) -> None:
            if isinstance(e, tuple) and e and e[0] == "agg":
                if e not in found:
                    found.append(e)
            elif isinstance(e, tuple | list):
                for x in e:
                    collect(x)

        aliases = {i.alias: i.expr for i in s.items if i.alias}
        collect([i.expr for i in s.items])
        collect(s.having)
        collect([e for e, _ in s.order])
        aggs = [self._aggregate(e, scope).alias(f"__a{k}") for k, e in enumerate(found)]
        names = [k for k, _ in keys]
        if names:
            grouped = scope.frame.groupBy(*[f"`{n}`" for n in names]).agg(*(aggs or [F.count(F.lit(1)).alias("__n")]))
        else:
            grouped = scope.frame.agg(*aggs, F.count(F.lit(1)).alias("__n")).filter("__n > 0").drop("__n")

        def replaced(e: object, named: bool = False) -> object:
            if isinstance(e, tuple) and e and e[0] == "agg":
                return ("col", None, f"__a{found.index(e)}")
            if named and isinstance(e, tuple) and e and e[0] == "col" and e[1] is None and e[2] in aliases and e[2] not in names:
                return replaced(aliases[e[2]])
            if isinstance(e, tuple):
                return tuple(replaced(x, named) for x in e)
            return [replaced(x, named) for x in e] if isinstance(e, list) else e

        own = scope.on(grouped)
        if s.having is not None:
            own = own.on(grouped.filter(self.column(replaced(s.having, True), own)))
        items: list[Item] = []
        for k, i in enumerate(s.items):
            if i.expr == ("star",):
                items += [Item(("col", None, n)) for n in names]
                continue
            if not _has(i.expr, "agg") and i.expr[0] == "col" and scope.actual(i.expr[1], i.expr[2]) not in names:
                raise QueryError(f"{i.expr[2]} is neither grouped nor aggregated")
            name = i.alias or (self.label(i.expr) if i.expr[0] in ("agg", "col") else f"__cmp_{k}")
            items.append(Item(replaced(i.expr), name))
        order = [(replaced(e, True) if self._order_alias(e, items) is None else e, d) for e, d in s.order]
        return self._finish(s, own, items, order)

    # --- windows ---

    def _window_name(self, e: Expr) -> str:
        _, f, args, *_ = e
        if f in ("ROW_NUMBER", "RANK", "DENSE_RANK", "LAG", "LEAD"):
            return f.lower()
        return f"{f.lower()}({args[0][2] if args[0][0] == 'col' else '*' if args[0][0] == 'star' else 'expr'})_over"

    def _windowed(self, e: Expr, scope: Scope, name: str) -> tuple[DataFrame, Expr]:
        """The frame with the expression's window functions as columns, and what is left of it."""
        if e[0] != "window":
            frame = scope.frame
            parts = []
            for k, x in enumerate(e):
                if isinstance(x, tuple) and _has(x, "window"):
                    frame, x = self._windowed(x, scope.on(frame), f"{name}_{k}")
                elif isinstance(x, list) and any(isinstance(y, tuple) and _has(y, "window") for y in x):
                    new = []
                    for n, y in enumerate(x):
                        if isinstance(y, tuple) and _has(y, "window"):
                            frame, y = self._windowed(y, scope.on(frame), f"{name}_{k}_{n}")
                        new.append(y)
                    x = new
                parts.append(x)
            return frame, tuple(parts)
        _, f, args, partition, order = e
        frame = scope.frame

        def named(x: Expr, at: str) -> str:
            nonlocal frame
            if x[0] == "col":
                return scope.actual(x[1], x[2])
            frame = frame.withColumn(at, self.column(x, scope.on(frame)))
            return at

        parts = [named(x, f"{name}_p{k}") for k, x in enumerate(partition)]
        keys = [(named(x, f"{name}_k{k}"), down) for k, (x, down) in enumerate(order)]
        w = spec(frame, parts, keys)
        own = scope.on(frame)
        if f.lower() in RANKS:
            made = RANKS[f.lower()]().over(w).cast("long")
        elif f in ("LAG", "LEAD"):
            n = args[1][1] if len(args) > 1 else 1
            made = (F.lag if f == "LAG" else F.lead)(self.column(args[0], own), n).over(w)
        else:
            kind = {"SUM_VEC": "sum", "AVG_VEC": "avg"}.get(f, f.lower())
            if kind not in WINDOW_AGGREGATES:
                raise QueryError(f"{f} is no window function")
            if args[0][0] == "star":
                made = F.count(F.lit(1)).over(running_frame(w))
            else:
                v = self.value(args[0], own)
                if v.tensor and kind != "count":
                    made = running_vec_column(v.column, kind, v.known if v.known and all(v.known) else self._probe(v), running_frame(w))
                else:
                    made = WINDOW_AGGREGATES[kind](v.column).over(running_frame(w))
        return frame.withColumn(name, made), ("col", None, name)


def _has(e: object, kind: str) -> bool:
    if isinstance(e, tuple) and e and e[0] == kind:
        return True
    return isinstance(e, tuple | list) and any(_has(x, kind) for x in e)
