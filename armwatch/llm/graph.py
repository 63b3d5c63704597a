"""Connected components of a link table by contraction, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwatch.session import settled


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of a link table (a, b); component is the smallest node.

    Each round points every node at its smallest neighbour or itself, follows the pointers to
    their roots by doubling, and contracts the links to roots; a round leaves at most half of the
    nodes that still have links. Rounds are cut by checkpoints. Nodes with very many links cost
    only rows of a join that can be split.
    """
    open_links = settled(
        links.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while not open_links.isEmpty():
        both = open_links.union(open_links.select("b", "a"))
        parent = settled(both.groupBy(F.col("a").alias("node"))
                         .agg(F.least(F.col("a"), F.min("b")).alias("up")))
        while True:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parent = settled(parent.join(above, "up")
                             .select("node", F.col("top").alias("up"),
                                     (F.col("top") != F.col("up")).alias("moved")))
            if parent.where("moved").isEmpty():
                break
            parent = parent.drop("moved")
        parent = parent.drop("moved")
        left = parent.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        right = parent.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        open_links = settled(
            open_links.join(left, "a").join(right, "b").where("ra != rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if found is None:
            found = parent.withColumnRenamed("up", "component")
        else:
            step = parent.withColumnRenamed("node", "component")
            found = settled(found.join(step, "component", "left")
                            .select("node", F.coalesce("up", "component").alias("component")))
    if found is None:
        found = open_links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
