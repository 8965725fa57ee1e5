"""Window functions; aggregates run from the partition's first row to the current one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.aggregates import KINDS
from ..types import is_tensor

#: Stands in for an order where none is given: rows as they were read.
READ_ORDER = "__read_order"


def spec(df: DataFrame, partition: Sequence[str] = (), order: Sequence[tuple[str, bool]] = ()) -> WindowSpec:
    """order: (column, descending). Vectors and matrices have no order."""
    for c, _ in order:
        if is_tensor(df.schema[c].dataType):
            raise ValueError(f"cannot ORDER BY {c}: vectors and matrices have no order")
    w = Window.partitionBy(*partition)
    keys = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
    return w.orderBy(*(keys or [F.monotonically_increasing_id()]))


def running_frame(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}


def rank_window(df: DataFrame, kind: str, name: str, partition: Sequence[str] = (), order: Sequence[tuple[str, bool]] = ()) -> DataFrame:
    return df.withColumn(name, RANKS[kind]().over(spec(df, partition, order)).cast("long"))


def offset_window(df: DataFrame, kind: str, column: str, name: str, n: int = 1, partition: Sequence[str] = (), order: Sequence[tuple[str, bool]] = ()) -> DataFrame:
    f = F.lag if kind == "lag" else F.lead
    return df.withColumn(name, f(column, n).over(spec(df, partition, order)))


def lag(df: DataFrame, column: str, name: str, n: int = 1, **window) -> DataFrame:
    return offset_window(df, "lag", column, name, n, **window)


def lead(df: DataFrame, column: str, name: str, n: int = 1, **window) -> DataFrame:
    return offset_window(df, "lead", column, name, n, **window)


AGGREGATES = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}


def running(df: DataFrame, kind: str, value: Column, name: str, partition: Sequence[str] = (), order: Sequence[tuple[str, bool]] = ()) -> DataFrame:
    return df.withColumn(name, AGGREGATES[kind](value).over(running_frame(spec(df, partition, order))))


def running_vec_column(c: Column, kind: str, dims: list[int], w: WindowSpec) -> Column:
    """Element-wise running aggregate of a vector or matrix column."""
    f = KINDS[kind]
    if len(dims) == 2:
        return F.array(*[F.array(*[f(F.get(F.get(c, F.lit(i)), F.lit(j)).cast("double")).over(w).cast("float") for j in range(dims[1])]) for i in range(dims[0])])
    return F.array(*[f(F.get(c, F.lit(k)).cast("double")).over(w).cast("float") for k in range(dims[0])])


def running_vec(df: DataFrame, kind: str, column: str, dims: list[int], name: str, partition: Sequence[str] = (), order: Sequence[tuple[str, bool]] = ()) -> DataFrame:
    return df.withColumn(name, running_vec_column(F.col(column), kind, dims, running_frame(spec(df, partition, order))))
