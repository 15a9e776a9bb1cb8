"""Connected components by contraction, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of a link and the smallest node it is connected to.

    Each round, every node with a smaller neighbour takes the smallest one's own choice, and links are
    carried over to what their ends have taken; links that become loops go.  A path of n nodes needs about
    log n rounds.  Every round's tables are written, so a lost executor costs at most a round.
    """
    edges = staged(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    nodes = edges.select(F.col("hi").alias("node")).union(edges.select("lo")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        first = edges.groupBy("hi").agg(F.min("lo").alias("to"))
        second = first.select(F.col("hi").alias("to"), F.col("to").alias("then"))
        taken = staged(first.join(second, "to", "left").select(F.col("hi").alias("was"), F.coalesce("then", "to").alias("now")), "taken")
        nodes = staged(nodes.join(taken, nodes.component == taken.was, "left").select("node", F.coalesce("now", "component").alias("component")), "nodes")
        moved = edges.join(taken.select(F.col("was").alias("hi"), F.col("now").alias("x")), "hi").join(taken.select(F.col("was").alias("lo"), F.col("now").alias("y")), "lo", "left").withColumn("y", F.coalesce("y", "lo"))
        edges = staged(moved.where("x != y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges")
    return nodes
