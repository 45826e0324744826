"""Connected components of a graph that is never gathered anywhere: alternating star contractions over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_groups, materialize


def _state(edges: DataFrame) -> tuple:
    """A few numbers that change when the edge set does."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """For edges (u, v): node, root, the smallest node it is linked to, for every node that has an edge.

    A large star hangs each node's greater neighbours on its smallest neighbour, a small star the smaller ones and itself;
    the two alternate until nothing changes, when every node hangs on its root. Minima are aggregated before the
    shuffle, nodes with a thousandth of all edges are joined by broadcast; each round is a written table, so lineage stays one
    round long, and the table before it is deleted. Null ends and loops are left out.
    """
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    edges, before = materialize(both, "edges"), None
    while (now := _state(edges)) != before:
        before, old = now, edges
        around = edges.union(edges.select("v", "u"))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        hung = join_groups(around.filter("v > u"), least, ["u"], "n", 2 * now[0])
        edges = materialize(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), "large-star")
        discard(old)
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hung = join_groups(edges, least, ["u"], "n", now[0]).select("u", "v", "m")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(hung.select("u", F.col("m").alias("v")))
        old, edges = edges, materialize(small.filter("u > v").distinct(), "small-star")
        discard(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
