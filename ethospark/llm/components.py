"""Connected components of a table of links, without gathering any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethospark.llm.common import stored

MAX_ROUNDS = 60  # far above what any graph needs (rounds grow with the square of its log size)


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches; ``links`` has columns a and b.

    Alternates two steps until every link points at its component: each node hands its larger
    neighbours to the smallest one, then its smaller ones. Minima combine before the shuffle and the
    joins back are plain inner joins, whose hot side Spark splits, so a hub is no single task.
    """
    edges = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stored(small.filter("a <> b").distinct(), "links")
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Number of links and an order-free digest of them."""
    digest = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), digest).first())
