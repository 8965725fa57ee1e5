"""Grouped and global aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_agg(df: DataFrame, keys: list[str], aggs: dict[str, Column], having: Column | None = None) -> DataFrame:
    """GROUP BY keys; nulls form one group. `having` may name keys and aggregates."""
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return out if having is None else out.filter(having)


def global_agg(df: DataFrame, aggs: dict[str, Column], having: Column | None = None) -> DataFrame:
    """Aggregates over all rows: one row, or none if there are no rows."""
    out = df.agg(*[c.alias(n) for n, c in aggs.items()], F.count(F.lit(1)).alias("__rows")).filter("__rows > 0").drop("__rows")
    return out if having is None else out.filter(having)
