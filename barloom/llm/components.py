"""Connected components of a graph of links, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import forget, settled, small


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b); component is the smallest node reachable. No rows: none."""
    halves = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    others = towards_least(settled(halves.distinct(), "links"))
    return others.unionByName(others.select(F.col("component").alias("node"), "component").distinct())


def towards_least(links: DataFrame) -> DataFrame:
    """components() without those nodes that are their component's smallest, of settled links (a, b), a < b, each there once.

    Alternates two steps until all edges are stars around smallest nodes: each node ties its larger neighbours to its
    smallest one, then each node ties itself and its smaller neighbours to the smallest of those. Every step keeps
    components whole, and the number of rounds grows with the logarithm of a component's size. links stay.
    """
    edges = links
    while not _are_stars(edges):
        ends = edges.select(F.explode(F.array(_edge("a", "b"), _edge("b", "a"))).alias("edge"))
        least = ends.groupBy(F.col("edge.of").alias("a")).agg(F.min("edge.other").alias("other")).select("a", F.least("a", "other").alias("least"))
        wide = edges.join(small(least, within=ends), "a").select(F.col("least").alias("a"), "b")
        near = wide.join(small(wide.groupBy("b").agg(F.min("a").alias("least")), within=edges), "b")
        tied = near.select(F.col("least").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        last, edges = edges, settled(tied, "links")
        if last is not links:
            forget(last)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))


def _edge(of: str, other: str) -> Column:
    return F.struct(F.col(of).alias("of"), F.col(other).alias("other"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each larger node b of edges (a, b) has one edge and no larger neighbour: then a is its component's smallest node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("up")), F.struct(F.col("b").alias("node"), F.lit(1).alias("up")))).alias("end"))
    nodes = ends.groupBy("end.node").agg(F.sum("end.up").alias("ups"), F.min("end.up").alias("least"))
    return nodes.agg(F.count_if((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("least") == 0)))).first()[0] == 0
