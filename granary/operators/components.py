"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima and joins over the edge table, so no task holds a component; a
node with a large part of all edges is spread over tasks. The number of rounds grows with the
logarithm of the largest component. Every round's edges are
written to the shared folder, which cuts lineage and survives the loss of executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.skew import spread_join
from granary.runtime import Scratch


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """(u, v) -> v's new neighbour is the smallest neighbour of u; ``total`` bounds the number of edges."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
    linked = spread_join(both, least.drop("n"), ["u"], least, "n", 2 * total, ["v"])
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component) for every end of an edge; the component is its smallest node.

    Edges with a null end are left out, loops give a component of one node.
    """
    clean = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    all_nodes = scratch.table(clean.distinct(), "edges")
    now = scratch.table(all_nodes.filter(F.col("u") != F.col("v")), "star")
    size = now.count()
    mark = None
    for _ in range(rounds):
        # A star has at most two edges for each of the edges before.
        step = scratch.table(_star(_star(now, True, size), False, 2 * size), "star")
        seen = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now, size = step, seen[0]
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components haven't settled after {rounds} rounds")
    nodes = all_nodes.select(F.col("u").alias("node")).union(all_nodes.select("v")).distinct()
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
