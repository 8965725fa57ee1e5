"""Similarity search by cosine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import cosine_sim

SCORE = "score"


def similarity_topk(df: DataFrame, column: str, query: Sequence[float], k: int, score: str = SCORE, tie_break: Sequence[str] = ()) -> DataFrame:
    """The k rows most similar to the query, best first; rows of another width are left out.

    Planned as a top-k of each partition and one of their results; nothing is sorted whole.
    """
    own = df.filter(F.size(column) == len(query)).withColumn(score, cosine_sim(F.col(column), query))
    return own.orderBy(F.col(score).desc(), *tie_break).limit(k)


def threshold_filter(df: DataFrame, column: str, query: Sequence[float], threshold: float, strict: bool = True) -> DataFrame:
    """Rows whose cosine with the query is above the threshold (or at it, unless strict)."""
    s = cosine_sim(F.col(column), query)
    return df.filter(F.size(column) == len(query)).filter(s > threshold if strict else s >= threshold)
