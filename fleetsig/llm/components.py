"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsig.llm.shared import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` of longs -> ``(node, root)`` for every node of an edge; the root is the smallest node.

    Alternating large-star and small-star steps: the longest path halves per round, and no node's neighbours are ever
    gathered in one row. Every round is a written table, so a lost executor costs that round at most. Loops and repeated
    edges are allowed; an empty edge list gives no rows.
    """
    stars = materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(),
        "edges",
    )
    before = _state(stars)
    while before[0]:
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(stars.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("low").alias("lo")).distinct()
        large = materialise(large, "large")
        low = large.groupBy("hi").agg(F.min("lo").alias("low"))
        met = large.join(low, "hi")
        small = low.select("hi", F.col("low").alias("lo")).unionAll(met.where("lo <> low").select("lo", "low"))
        stars = materialise(small.distinct(), "small")
        after = _state(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(
        stars.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), digest).first())
