"""PageRank over an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.sources.snapshots import snapshot


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """Ranks that sum to 1: id, rank. nodes: id, distinct; edges: src, dst. Nodes without edges out share theirs with all."""
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    out = edges.groupBy("src").agg(F.count("*").alias("degree"))
    links = snapshot(edges.join(out, "src"))
    ranks = snapshot(nodes.join(out, nodes.id == out.src, "left").select("id", F.lit(1.0 / n).alias("rank"), F.coalesce("degree", F.lit(0)).alias("degree")))
    for _ in range(rounds):
        lost = ranks.where("degree = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = links.join(ranks.where("degree > 0").select(F.col("id").alias("s"), "rank"), F.col("src") == F.col("s"))
        given = given.groupBy(F.col("dst").alias("d")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        fresh = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)
        ranks = snapshot(ranks.join(given, F.col("id") == F.col("d"), "left").select("id", fresh.alias("rank"), "degree"))
    return ranks.select("id", "rank")
