"""Connected components of links between rows, over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cohortry.session import stored


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b): root is the smallest id that links lead to.

    Two alternating steps until the links are stars: every node passes its smallest
    neighbour to its larger neighbours, then to its smaller ones. Trees shrink to stars in a number of rounds
    that grows with the logarithm of the longest path, and a hot node's links are
    combined before each shuffle. Each round's links are a written table, never more rows than the round before.
    Whether they are stars is observed while the smallest neighbours, which the next round needs, are written. A link of a row to
    itself is none.
    """
    links = stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smaller = F.when(F.col("v") < F.col("u"), F.col("v"))
        nodes = both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max(smaller).alias("next"))
        # a star: no node has two smaller neighbours, or neighbours on both sides
        seen = Observation()
        open_nodes = F.count_if((F.col("next") > F.col("low")) | ((F.col("low") < F.col("u")) & (F.col("high") > F.col("u"))))
        nodes = stored(nodes.observe(seen, open_nodes.alias("open")).select("u", F.least("low", "u").alias("m")))
        if not seen.get["open"]:
            return nodes.select(F.col("u").alias("id"), F.col("m").alias("root"))
        # every larger neighbour of a node, linked to the node's smallest neighbour or itself
        large = stored(links.select(F.col("v").alias("u"), F.col("u").alias("v")).join(nodes, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # every smaller neighbour of a node, and the node, linked to the smallest
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
