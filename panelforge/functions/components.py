"""Connected components of a graph in logarithmically many rounds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.shared import materialised


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u, v) with u > v: larger neighbours (large), or smaller ones and the node itself, move to a node's least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")) if large else both.groupBy("u").agg(F.min("v").alias("m"))
    moved = both.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v), whose values have an order: root is the least node that can be reached.

    Large and small stars in turn until nothing moves; each round joins edges with one row a node, so no component is gathered.
    """
    now = materialised(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    count = now.count()
    seen = None
    for _ in range(4 * math.ceil(math.log2(count + 2)) ** 2):
        now = materialised(_stars(_stars(now, True), False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components have not settled")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
