"""Connected components of a graph given by edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.llm.rows import store
from ticketmill.session import scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Edges point from larger to smaller."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, for all nodes of ``edges`` (u, v) but the smallest ones.

    Edges may repeat and point either way; loops are ignored; no edges give no rows. The rounds grow with the logarithm of the
    largest component. Minima combine before the shuffle, and a hub's edges meet one row of the other side, so that
    adaptive execution can split them. Copies of the rounds are deleted.
    """
    with scratch(edges.sparkSession):
        current = store(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        state = None
        while True:
            digest = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
            if digest == state or not digest[0]:
                return store(current.select(F.col("u").alias("node"), F.col("v").alias("label")), "labels", outer=True)
            state = digest
            large = store(_large_star(current).distinct(), "edges")
            current = store(_small_star(large).distinct(), "edges")


def contract(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (node, label) with further ``links`` (u, v): only the classes so far are nodes of the graph that is worked on."""
    own = label.select(F.col("node").alias("n"), F.col("label").alias("l"))
    ends = links.join(own, F.col("u") == F.col("n"), "left").withColumn("u", F.coalesce("l", "u")).drop("n", "l")
    ends = ends.join(own, F.col("v") == F.col("n"), "left").withColumn("v", F.coalesce("l", "v")).drop("n", "l")
    joined = components(ends)
    lower = joined.select(F.col("node").alias("label"), F.col("label").alias("lower"))
    moved = label.join(lower, "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
    return store(moved.unionByName(joined), "labels")
