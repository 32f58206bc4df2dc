"""Connected components of a graph given as a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialised


def connected_components(links: DataFrame) -> DataFrame:
    """Root of every node that a link (a, b: long) touches: node, root.

    In each round every node points to the neighbour, or itself, whose hash is smallest, pointers are followed
    once more, and links are carried over to the nodes pointed to, until none is left. Hash order makes a
    fixed share of the nodes vanish in a round even on long chains. Only tables in the shared folder are kept
    between rounds. Repeated links and loops are harmless; no links give no rows. A root is any node of its
    component.
    """
    edges = materialised(links.select("a", "b").where("a <> b").distinct(), "links")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
        near = both.groupBy("a").agg(F.min(key("b")).alias("m"))
        step = materialised(near.select(F.col("a").alias("node"), F.least(key("a"), F.col("m"))["x"].alias("to")), "components")
        further = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = materialised(step.join(further, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "components")
        steps.append(step)
        for side in ("a", "b"):
            edges = edges.join(step.select(F.col("node").alias(side), F.col("to").alias("t")), side).drop(side).withColumnRenamed("t", side)
        edges = materialised(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0].select("node", F.col("to").alias("root"))
    for step in steps[1:]:
        found = found.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return found
