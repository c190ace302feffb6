"""Connected components over links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def smallest_reachable(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``links(a, b)`` -> ``(node, root)``: for every node of a link the smallest node that it can reach.

    Each round links every node's larger neighbours to its smallest one and every node's smaller neighbours to the smallest
    of them; components shrink to stars in a logarithmic number of rounds. Aggregations only, so a node with very many
    neighbours is combined before it is shuffled; lineage is cut each round in the shared checkpoint folder. No component
    or list of neighbours is ever gathered.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = checkpointed(edges)
    before = None
    while True:
        # large star: u's neighbours, both ways, that are larger than u go to the smallest of u and its neighbours
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u's smaller neighbours and u itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        new = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, edges = state, new
    roots = edges.groupBy("v").agg(F.lit(1)).select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
