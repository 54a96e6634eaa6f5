"""Connected components by alternating large-star and small-star steps; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.storage import Written


def _stars(edges: DataFrame) -> bool:
    """Whether each node has an edge to one root at most, and no root an edge of its own."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("leaves"), F.lit(0).alias("comes"))
    ends = ends.unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("leaves"), F.lit(1).alias("comes")))
    seen = ends.groupBy("v").agg(F.sum("leaves").alias("leaves"), F.max("comes").alias("comes"))
    return seen.where("leaves > 1 or leaves = 1 and comes = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Least node reachable from each node that has an edge.

    edges: a, b, of one type that can be ordered, without nulls, in either direction; repeats and
    loops do no harm. Returns node, root. Each round writes its edges and replaces the round before;
    the least neighbour is aggregated before the join that uses it, so a node with very many
    neighbours is a skewed join, which adaptive execution splits. Rounds grow with the logarithm of
    the longest path. No edges give no rows.
    """
    # Every edge points from the larger node to the smaller.
    now = Written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    while not _stars(now.read()):
        e = now.read()
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = Written(large.where("a <> b").distinct(), "large")
        e = large.read()
        least = e.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = e.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a <> b").unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        after = Written(small, "edges")
        large.drop()
        now.drop()
        now = after
    stars = now.read()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
