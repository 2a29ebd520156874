"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import cut_lineage


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("low"))


def _step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star contraction; edges are (a, b) with a > b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _least(both).select("a", F.least("a", "low").alias("low"))
    large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    large = large.distinct()
    low = _least(large)
    small = large.join(low, "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return small.union(low.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; the component is its least node.

    Edges that are null or join a node to itself count for nothing. Every round is one
    job over the edges that are left, written to the shared folder; a hub is combined before it
    is shuffled. The rounds grow with the logarithm of the longest path.
    """
    edges = (
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )
    edges = cut_lineage(edges, "edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        edges = cut_lineage(_step(edges), "edges")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
