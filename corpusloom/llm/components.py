"""Connected components of an edge table by alternating large-star and small-star steps, all of them Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each neighbour to the least of a node and its neighbours: the larger ones (large-star) or the others."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = both.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node in `edges` (a, b). Nodes without edges don't appear.

    Each step reduces per node before it shuffles and is written to the shared folder; the work ends when a round changes
    nothing, after about the logarithm of the largest component's diameter.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(pairs)
    count = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = count(now)
    for _ in range(max_rounds):
        now = materialize(_stars(_stars(now, large=True), large=False))
        after = count(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
