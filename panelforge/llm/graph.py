"""Connected components of an edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import checkpoint


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node with an edge; comp is the smallest node reachable. edges: (a, b), any order, no nulls.

    Large and small stars in turn until nothing moves: a logarithmic number of rounds of grouped minima and
    joins; no vertex's neighbours are gathered anywhere, so a hub of any degree only costs split joins. Loops
    and repeats are harmless; an empty edge list gives no rows.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = checkpoint(links), None
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # checkpointed, so that the join's sides are plain exchanges: then a hub's rows can be split over tasks
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = checkpoint(large.where("a <> b").distinct())
        least = checkpoint(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = checkpoint(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % F.lit(1 << 31))).first()
        if now == before:
            break
        before = now
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
