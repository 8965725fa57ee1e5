"""Vector functions over array columns, computed in double precision.

An operand may be a column or a Python list of numbers. Against a list the sum is unrolled
into plain arithmetic, which stays inside whole-stage code; two columns go through
higher-order functions. Two-operand functions stop at the shorter operand, as the norms do
not; a null operand gives null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Operand = Column | str | Sequence[float]
#: Lists up to this width are unrolled.
UNROLL = 512


def vector_literal(values: Sequence[float]) -> Column:
    """An array<float> literal."""
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<float>")


def _column(v: Operand) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else vector_literal(v)


def _fold(terms: list[Column]) -> Column:
    """A balanced sum: the expression tree stays shallow for wide vectors."""
    while len(terms) > 1:
        terms = [reduce(lambda x, y: x + y, terms[k : k + 8]) for k in range(0, len(terms), 8)]
    return terms[0] if terms else F.lit(0.0)


def _element(c: Column, k: int) -> Column:
    return F.get(c, F.lit(k)).cast("double")


def _unrolled(a: Operand, b: Operand) -> tuple[Column, list[float]] | None:
    for x, y in ((a, b), (b, a)):
        if not isinstance(y, Column | str) and isinstance(x, Column | str) and len(y) <= UNROLL:
            return _column(x), [float(v) for v in y]
    return None


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def dot(a: Operand, b: Operand) -> Column:
    if flat := _unrolled(a, b):
        c, values = flat
        total = _fold([F.coalesce(_element(c, k) * F.lit(v), F.lit(0.0)) for k, v in enumerate(values)])
        return F.when(c.isNotNull(), total)
    return _sum(F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(v: Operand) -> Column:
    if not isinstance(v, Column | str):
        return F.lit(sum(float(x) ** 2 for x in v) ** 0.5)
    return F.sqrt(F.aggregate(_column(v), F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double") * x.cast("double"), F.lit(0.0))))


def cosine_sim(a: Operand, b: Operand) -> Column:
    """Cosine of the angle; 0 if an operand has no length."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), norms))


def distance(a: Operand, b: Operand) -> Column:
    if flat := _unrolled(a, b):
        c, values = flat
        diffs = [_element(c, k) - F.lit(v) for k, v in enumerate(values)]
        return F.when(c.isNotNull(), F.sqrt(_fold([F.coalesce(d * d, F.lit(0.0)) for d in diffs])))
    both = F.zip_with(_column(a), _column(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(_sum(both))


def normalize(v: Operand) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    c = _column(v)
    norm = l2_norm(c)
    return F.when(norm == 0, c.cast("array<float>")).otherwise(F.transform(c, lambda x: F.try_divide(x.cast("double"), norm).cast("float")))


def vec_add(a: Operand, b: Operand) -> Column:
    """Element by element, as long as the shorter operand."""
    x, y = _column(a), _column(b)
    n = F.least(F.size(x), F.size(y))
    added = F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: (p.cast("double") + q.cast("double")).cast("float"))
    return F.when(x.isNotNull() & y.isNotNull(), added)


def vec_scale(v: Operand, by: Column | float) -> Column:
    by = by if isinstance(by, Column) else F.lit(float(by))
    return F.when(by.isNotNull(), F.transform(_column(v), lambda x: (x.cast("double") * by.cast("double")).cast("float")))
