"""Connected components of a graph given as edges, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalframe.sources.scratch import written


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the least node that it reaches) for each node of `edges` (a, b: long); loops are ignored.

    Each round links a node's larger neighbours to its least one, then a node and its smaller neighbours to the
    least of these. Edges only shrink towards stars, so no vertex gathers more than its own neighbours, whose least
    is found by a combining aggregation; each round's edges are written, so a lost executor costs one round.
    """
    down = written(_down(edges.select("a", "b")), "edges")
    before = None
    while True:
        both = down.select("a", "b").union(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _down(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = written(_down(small.union(least.select("a", F.col("m").alias("b")))), "edges")
        # Stars all: no node has two smaller neighbours, and no smaller neighbour is itself larger than another.
        after = down.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = down.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(down.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _down(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
