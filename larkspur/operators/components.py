"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.sources.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of undirected edges (a, b); a component is named by its smallest node.

    Edges are rewired until each node points at its component's smallest: in turn, every node hands its larger
    neighbours, then its smaller ones, to the smallest node that it knows. The edges never grow in number, and it takes about
    the logarithm of a component's size in rounds. Each step is a grouped minimum and a join by node; nothing is collected.
    Loops and repeated edges do no harm; rows with a null end are left out.
    """
    both = edges.where("a is not null and b is not null").select("a", "b")
    nodes = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).select("a").distinct()
    links = materialize(both.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "graph-edges")
    before = None
    while True:
        found = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if found == before:
            break
        before = found
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        large = around.where("b > a").join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = materialize(large, "graph-edges")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").unionByName(least.select("a", F.col("least").alias("b"))).distinct()
        links = materialize(small, "graph-edges")
    return nodes.join(links, "a", "left").select(F.col("a").alias("node"), F.coalesce("b", "a").alias("component"))
