"""Connected components of a graph of any size, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.common import few, join_facts, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b: longs); the root is the component's least node.

    Large star: every node hands its larger neighbours to its least neighbour. Small star: it hands its smaller ones and
    itself to the least. Alternating, the edges become one star for each component after a logarithmic number of rounds.
    Nodes with very many edges are served like any hot key, so a giant component meets in no single task.
    """

    def star(edges: DataFrame, n: int, large: bool) -> DataFrame:
        # (u, v): every edge from both of its ends, or from its larger end alone
        ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            ends = materialize(ends.union(ends.select("v", "u")))
        least = materialize(few(ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), 2 * n))
        known = join_facts(ends, least, "u", "n")
        if large:
            out = known.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = known.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u"), F.col("m")))
        return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    def digest(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = digest(edges)
    while n := before[0]:
        edges = materialize(few(star(edges, n, large=True), 2 * n))
        edges = materialize(few(star(edges, n, large=False).distinct(), 2 * n))
        now = digest(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
