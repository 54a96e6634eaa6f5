"""Paths of more than one hop: bounded expansion, shortest paths, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.sources.snapshots import settled, snapshot

#: Hops that are unrolled into one plan; longer expansions write each level and stop when none is left.
UNROLLED = 2


def expand(seeds: DataFrame, edges: DataFrame, low: int, high: int) -> DataFrame:
    """One row for each path of low to high hops from a seed that meets no node twice.

    seeds: start, distinct. edges: src, dst, type, eid. Returns start, end, hops, nodes, edges.
    """
    stepped = high > UNROLLED
    if stepped:
        edges = settled(edges.select("src", "dst", "type", "eid"))
    e = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.struct("type", "eid").alias("_e"))
    none = F.array().cast(f"array<{e.schema['_e'].dataType.simpleString()}>")
    now = seeds.select("start", F.col("start").alias("end"), F.array("start").alias("nodes"), none.alias("edges"))
    levels = [now.withColumn("hops", F.lit(0))] if low == 0 else []
    for hop in range(1, high + 1):
        step = now.join(e, F.col("end") == F.col("_s")).where(~F.array_contains("nodes", F.col("_d")))
        now = step.select(
            "start", F.col("_d").alias("end"), F.array_append("nodes", F.col("_d")).alias("nodes"), F.array_append("edges", F.col("_e")).alias("edges")
        )
        if stepped:
            now = snapshot(now)
            if now.isEmpty():
                break
        if hop >= low:
            levels.append(now.withColumn("hops", F.lit(hop)))
    if not levels:
        return now.where(F.lit(False)).withColumn("hops", F.lit(0))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def shortest(seeds: DataFrame, edges: DataFrame, low: int, high: int, every: bool, only: str | None = None) -> DataFrame:
    """Paths of the fewest hops from each seed to each node it reaches; one of them, or every one.

    Breadth first by levels: a pair of seed and node is settled at the first level that reaches it,
    and only new pairs go on; a node on the path itself was, and is dropped before pairs are. Of several paths, one is the least by its nodes. Shapes as in expand.
    only: the type of all edges where they are mapped and of one type; levels then carry no edges, which
    are made from the nodes at the end. With low above 1, pairs count as settled from low hops on, so all paths up to high are looked at.
    """
    if low > 1:
        paths = expand(seeds, edges, low, high)
        least = F.min("hops").over(Window.partitionBy("start", "end"))
        paths = paths.withColumn("_least", least).where("hops = _least").drop("_least")
        if every:
            return paths
        best = paths.groupBy("start", "end", "hops").agg(F.min(F.struct("nodes", "edges")).alias("p"))
        return best.select("start", "end", "p.nodes", "p.edges", "hops")
    edges = settled(edges.select("src", "dst", "type", "eid"))
    e = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.struct("type", "eid").alias("_e"))
    none = F.array().cast(f"array<{e.schema['_e'].dataType.simpleString()}>")
    now = seeds.select("start", F.col("start").alias("end"), F.array("start").alias("nodes"), none.alias("edges"))
    carried = ["nodes"] if only else ["nodes", "edges"]
    now = snapshot(now.select("start", "end", *carried))
    levels = [now.withColumn("hops", F.lit(0))] if low == 0 else []
    done = now.select("start", "end")
    for hop in range(1, high + 1):
        longer = [F.array_append(c, F.col(x)).alias(c) for c, x in zip(carried, ("_d", "_e"))]
        step = now.join(e, F.col("end") == F.col("_s")).where(~F.array_contains("nodes", F.col("_d"))).select("start", F.col("_d").alias("end"), *longer)
        step = step.join(done.select(F.col("start").alias("_a"), F.col("end").alias("_b")), (F.col("start") == F.col("_a")) & (F.col("end") == F.col("_b")), "left_anti")
        if not every:
            best = step.groupBy("start", "end").agg(F.min(F.struct(*carried)).alias("p"))
            step = best.select("start", "end", *[f"p.{c}" for c in carried])
        now = snapshot(step)
        if now.isEmpty():
            break
        done = done.unionByName(now.select("start", "end").distinct())
        if hop >= low:
            levels.append(now.withColumn("hops", F.lit(hop)))
    out = levels[0] if levels else now.where(F.lit(False)).withColumn("hops", F.lit(0))
    for level in levels[1:]:
        out = out.unionByName(level)
    if only:
        edge = F.struct(F.lit(only).alias("type"), F.lit(None).cast(e.schema["_e"].dataType["eid"].dataType).alias("eid"))
        out = out.withColumn("edges", F.transform(F.slice("nodes", F.lit(2), F.size("nodes") - 1), lambda _: edge))
    return out


def neighbourhood(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(start, id) of every node within depth hops of a seed, edges taken either way."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = seeds.select("start", F.col("start").alias("id"))
    now = seen
    for _ in range(depth):
        step = now.join(both, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        now = snapshot(step.join(seen, ["start", "id"], "left_anti"))
        if now.isEmpty():
            break
        seen = seen.unionByName(now)
    return seen
