"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import attach, materialize


def _minima(pairs: DataFrame, total: int) -> DataFrame:
    """Each pair (v, u) with m, the smallest of v and all it is paired with."""
    least = pairs.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
    return attach(pairs, materialize(least.select("v", F.least("v", "m").alias("m"), "n"), "star-minima"), "v", "n", total)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b: long); the component is its smallest node. Self-edges are allowed."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    nodes = edges.select(F.col("v").alias("node")).unionByName(edges.select(F.col("u").alias("node"))).distinct()
    edges, before = edges.where("v <> u"), None
    for _ in range(max_rounds):
        total = 2 * edges.count()
        if not total:
            break
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = _minima(materialize(both, "edges"), total).where("u > v and u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = materialize(large, "edges")
        small = _minima(large, total).select("v", "u", "m")  # here u < v, so m is the smallest smaller neighbour
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e")).select("e.*").where("v <> u").distinct()
        edges = materialize(small, "edges")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    # settled: every edge leads from a node to the smallest of its component
    return nodes.join(edges.select(F.col("v").alias("node"), F.col("u").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
