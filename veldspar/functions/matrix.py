"""Matrix functions over array<array> columns; a shape that does not fit gives null."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

M = "array<array<float>>"


def matrix_literal(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows]).cast(M)


def _rows(m: Column) -> Column:
    return F.size(m)


def _cols(m: Column) -> Column:
    return F.size(F.get(m, F.lit(0)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def transpose(m: Column) -> Column:
    across = F.transform(F.sequence(F.lit(0), _cols(m) - 1), lambda j: F.transform(m, lambda r: F.get(r, j)))
    return F.when((_rows(m) > 0) & (_cols(m) > 0), across).when(m.isNotNull(), F.array().cast(M))


def matmul(a: Column, b: Column, vector: bool = False) -> Column:
    """Matrix by matrix, or by a vector if `vector`; null if the inner sizes differ."""
    fits = (_rows(a) > 0) & (_cols(a) == F.size(b))
    if vector:
        return F.when(fits, F.transform(a, lambda r: _dot(r, b).cast("float")))
    columns = transpose(b)
    return F.when(fits & (F.size(b) > 0), F.transform(a, lambda r: F.transform(columns, lambda c: _dot(r, c).cast("float"))))


def flatten(x: Column, matrix: bool = True) -> Column:
    return F.flatten(x) if matrix else x


def mat_shape(x: Column, matrix: bool = True) -> Column:
    """"RxC"; of a vector "Nx1"."""
    if not matrix:
        return F.concat(F.size(x).cast("string"), F.lit("x1"))
    return F.when(x.isNotNull(), F.concat(_rows(x).cast("string"), F.lit("x"), F.when(_rows(x) > 0, _cols(x)).otherwise(F.lit(0)).cast("string")))


def as_vector(x: Column, n: int, matrix: bool = True) -> Column:
    """Row-major elements as a vector of n, or null."""
    flat = flatten(x, matrix).cast("array<float>")
    return F.when(F.size(flat) == n, flat)


def as_matrix(x: Column, rows: int, cols: int, matrix: bool = False) -> Column:
    """Elements laid out in rows x cols; a matrix of another shape, or other count, gives null."""
    if matrix:
        return F.when((_rows(x) == rows) & (_cols(x) == cols), x.cast(M))
    flat = x.cast("array<float>")
    return F.when(F.size(flat) == rows * cols, F.array(*[F.slice(flat, i * cols + 1, cols) for i in range(rows)]))


_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda x, y: x + y,
    "-": lambda x, y: x - y,
    "*": lambda x, y: x * y,
    "/": lambda x, y: F.when(y == 0, x).otherwise(F.try_divide(x, y)),
}


def mat_arith(op: str, a: Column, b: Column, scalar: bool = False) -> Column:
    """Element by element with a matrix of the same shape, or with a scalar on the right;
    division by zero leaves the element as it is."""
    f = _OPS[op]
    if scalar:
        return F.when(b.isNotNull(), F.transform(a, lambda r: F.transform(r, lambda x: f(x.cast("double"), b.cast("double")).cast("float"))))
    same = (_rows(a) == _rows(b)) & ((_rows(a) == 0) | (_cols(a) == _cols(b)))
    return F.when(same, F.zip_with(a, b, lambda r, s: F.zip_with(r, s, lambda x, y: f(x.cast("double"), y.cast("double")).cast("float"))))
