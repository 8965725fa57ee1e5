"""Element-wise aggregates of vector columns.

Of a known width the aggregate is one plain aggregate per element, so partial aggregation
and whole-stage code hold. `vec_by_position` serves unknown or very large widths by grouping
on (key, position).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wider vectors go by position: so many aggregates in one operator stop paying off.
WIDE = 1024

KINDS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def check_widths(c: Column, width: int, value: Column) -> Column:
    """value, or an error if a vector of the group has another width."""
    fits = (F.coalesce(F.min(F.size(c)), F.lit(width)) == width) & (F.coalesce(F.max(F.size(c)), F.lit(width)) == width)
    return F.when(fits, value).otherwise(F.raise_error(F.lit(f"vectors of different widths in one group; {width} expected")))


def _fixed(kind: str, c: Column, width: int, strict: bool) -> Column:
    f = KINDS[kind]
    value = F.array(*[f(F.get(c, F.lit(k)).cast("double")).cast("float") for k in range(width)])
    value = F.when(F.count(c) > 0, value)
    return check_widths(F.when(c.isNotNull(), c), width, value) if strict else value


def _fixed_matrix(kind: str, c: Column, rows: int, cols: int) -> Column:
    f = KINDS[kind]
    cell = lambda i, j: f(F.get(F.get(c, F.lit(i)), F.lit(j)).cast("double")).cast("float")
    value = F.when(F.count(c) > 0, F.array(*[F.array(*[cell(i, j) for j in range(cols)]) for i in range(rows)]))
    return check_widths(F.when(c.isNotNull(), c), rows, value)


def vec_agg(kind: str, c: Column, dims: list[int]) -> Column:
    """Element-wise sum, avg, min or max of a vector or matrix column of known dimensions.

    Sums and averages of vectors of different widths are an error; minima and maxima leave
    the missing elements out."""
    if len(dims) == 2:
        return _fixed_matrix(kind, c, *dims)
    return _fixed(kind, c, dims[0], kind in ("sum", "avg"))


def sum_vec(c: Column, width: int) -> Column:
    return vec_agg("sum", c, [width])


def avg_vec(c: Column, width: int) -> Column:
    return vec_agg("avg", c, [width])


def min_vec(c: Column, width: int) -> Column:
    return vec_agg("min", c, [width])


def max_vec(c: Column, width: int) -> Column:
    return vec_agg("max", c, [width])


def vec_by_position(df: DataFrame, keys: list[str], column: str, kind: str, name: str) -> DataFrame:
    """keys and the element-wise aggregate, whatever the width.

    Elements are grouped by key and position, so the partial aggregates are as small as the
    result; one row per group holds the vector again only at the end."""
    c = F.col(column)
    spread = df.filter(c.isNotNull()).select(*keys, F.size(c).alias("__n"), F.posexplode(c).alias("__at", "__v"))
    cells = spread.groupBy(*keys, "__at").agg(KINDS[kind](F.col("__v").cast("double")).cast("float").alias("__v"), F.min("__n").alias("__low"), F.max("__n").alias("__high"))
    value = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__v"))), lambda x: x["__v"])
    if kind in ("sum", "avg"):
        even = F.min("__low") == F.max("__high")
        value = F.when(even, value).otherwise(F.raise_error(F.lit("vectors of different widths in one group")))
    return cells.groupBy(*keys).agg(value.alias(name))
