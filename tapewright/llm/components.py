"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two partial aggregates and joins over the edges, written to a scratch table; the driver
sees a count and a checksum only. Edges shrink towards stars around each component's smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.scratch import Scratch


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch, *, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node with an edge; the component is its smallest node. ``edges`` has a and b.

    Edges may repeat or point to themselves; null ends are left out.
    """
    # From here on a is larger than b.
    edges = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0"
    )
    before = _checksum(edges)
    for k in range(1, most_rounds + 1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = edges.select(F.col("b").alias("a"), F.col("a").alias("far")).join(least, "a").where("far > m").select(F.col("far").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = scratch.save(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), f"edges-{k}")
        now = _checksum(edges)
        scratch.drop(f"edges-{k - 1}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
