"""Connected components by alternating star steps, in DataFrames that the shared folder keeps between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import common


#: Up to so many edges, the table of each node's smallest neighbour (under 80 bytes a row) is sent to all tasks.
SENT_EDGES = 200_000


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with m, the smallest b of their a. Beyond the bound of what is sent, rows of a node with very many edges stay where they are."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("edges"))
    if common.rows_of(edges) <= SENT_EDGES:
        return edges.join(F.broadcast(least), "a")
    return common.join_weighted(edges, common.cut(least), ["a"], "edges", common.rows_of(edges))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); the root is the smallest node of a component.

    Each round ties every node's larger neighbours, then its smaller ones, to the smallest, until all edges lead to a root.
    The number of rounds grows with the logarithm of the longest path, and no list of neighbours is ever gathered.
    If edges still change in the last of `rounds`, an error is raised, so no component is ever returned in parts.
    """
    current = common.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = common.cut(current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        tied = _with_least(both).withColumn("m", F.least("a", "m"))
        large = common.cut(tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        tied = _with_least(large)
        small = tied.select("a", F.col("m").alias("b")).union(tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        current = common.cut(small.distinct())
        now = _fingerprint(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
