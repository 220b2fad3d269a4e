"""Connected components by alternating stars, on edges that never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: the larger (or smaller) neighbours of each node are hung on its smallest neighbour."""
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_low")).select("a", F.least("a", "_low").alias("m"))
    met = both.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(xxhash64(a, b) % 65521)")).first())


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """``(node, root)`` of every node of the undirected edges ``(a, b)``: root is the smallest node it reaches.

    Each round is written to the shared folder, so plans stay short and a lost executor costs
    one round.  Nodes may be of any type that can be compared; loops are left out.
    """
    larger = F.col("a") > F.col("b")
    edges = stored(edges.where("a <> b").select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("a"),
                                                F.when(larger, F.col("b")).otherwise(F.col("a")).alias("b")).distinct(), "edges")
    before = None
    for _ in range(most):
        now = _state(edges)
        if now == before or not now[0]:
            break
        before = now
        edges = stored(_stars(stored(_stars(edges, True), "edges"), False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
