"""Connected components of a graph held as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, any order, repeats allowed) -> node, root: each node with the smallest node of its component.

    A large star hangs the larger neighbours of every node on its smallest; a small star hangs the smaller ones and the node
    itself. Rounds are few (about the logarithm of the longest path); each one is aggregates with partial sums and joins that
    can be split where a node has very many edges. Each round's edges are written to the shared folder.
    """
    at = _down(edges.select("a", "b"))
    at = stored(at.distinct(), "stars")
    mark = _mark(at)
    while True:
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _down(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        large = stored(large, "stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        at = stored(_down(small.unionByName(least.select("a", F.col("m").alias("b")))).distinct(), "stars")
        mark, before = _mark(at), mark
        if mark == before:
            break
    roots = at.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _down(edges: DataFrame) -> DataFrame:
    """Each edge from its larger to its smaller node; loops go."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _mark(edges: DataFrame) -> tuple:
    """Of a set of edges: their number and two sums of their hashes."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 24)), F.sum(h.bitwiseAND(0xFFFFFF))).first())
