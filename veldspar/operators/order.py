"""Ordering, limits, distinct rows and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import is_tensor


def order_by(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """keys: (column, descending). Nulls sort lowest; vectors and matrices cannot be keys."""
    for c, _ in keys:
        if is_tensor(df.schema[c].dataType):
            raise ValueError(f"cannot ORDER BY {c}: vectors and matrices have no order")
    return df.orderBy(*[F.col(f"`{c}`").desc_nulls_last() if down else F.col(f"`{c}`").asc_nulls_first() for c, down in keys])


def limit_offset(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def union(left: DataFrame, right: DataFrame, keep_all: bool = True) -> DataFrame:
    """By position, with the left side's names."""
    if len(left.columns) != len(right.columns):
        raise ValueError(f"UNION of {len(left.columns)} and {len(right.columns)} columns")
    out = left.union(right)
    return out if keep_all else out.distinct()
