"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node hangs on one smaller node, and no such root hangs on another."""
    ends = edges.select(F.col("big").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("root")).unionByName(
        edges.select(F.col("small").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("root"))
    )
    bad = ends.groupBy("n").agg(F.sum("hangs").alias("h"), F.max("root").alias("r")).filter("h > 1 or (h = 1 and r = 1)")
    return bad.isEmpty()


#: A node on over 1 / SHARE of all link ends (and over LEAST) is a hub; there are SHARE at most.
SHARE, LEAST = 2048, 1000


def _with_least(both: DataFrame, ends: int) -> DataFrame:
    """(u, v, m): each link end with the least of u and its neighbours.

    Of hubs, whose number is bounded, m is broadcast, so a hub's links stay where they are.
    """
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d")).select("u", F.least("u", "m").alias("m"), "d"), "least")
    hubs = least.filter(F.col("d") > max(LEAST, ends // SHARE)).select(F.col("u").alias("h"), F.col("m").alias("hm"))
    told = both.join(F.broadcast(hubs), F.col("u") == F.col("h"), "left").drop("h")
    others = told.filter("hm is null").drop("hm").join(least.select("u", "m"), "u")
    return told.filter("hm is not null").withColumnRenamed("hm", "m").unionByName(others)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that a link touches; component is its smallest node.

    Links are an undirected table of two long columns; loops and nulls are ignored, repeated
    links count once, an empty table gives an empty result. Each round writes its edges to
    the shared folder; rounds grow with the logarithm of the longest path.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = materialise(
        links.select(F.greatest(x, y).alias("big"), F.least(x, y).alias("small")).filter("big > small").distinct(), "edges"
    )
    while not _is_star_forest(edges):
        both = edges.select(F.col("big").alias("u"), F.col("small").alias("v")).unionByName(
            edges.select(F.col("small").alias("u"), F.col("big").alias("v"))
        )
        large = _with_least(both, 2 * edges.count()).filter("v > u and v > m").select(F.col("v").alias("big"), F.col("m").alias("small")).distinct()
        low = large.groupBy("big").agg(F.min("small").alias("m"))
        small = (
            large.join(low, "big")
            .select(F.explode(F.array(F.struct(F.col("big").alias("big"), F.col("m").alias("small")), F.struct(F.col("small").alias("big"), F.col("m").alias("small")))).alias("e"))
            .select("e.big", "e.small")
            .filter("big > small")
            .distinct()
        )
        after = materialise(small, "edges")
        forget(edges)
        edges = after
    return edges.select(F.col("big").alias("node"), F.col("small").alias("component")).unionByName(
        edges.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct()
    )
