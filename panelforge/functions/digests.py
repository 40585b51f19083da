"""Digest of a table's text in order, as a tree of blocks: no task sees more than one block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.ordering import numbered
from panelforge.functions.shared import materialised

#: Lines, or digests, that one node of the tree covers.
FAN = 4096


def digest_tree(df: DataFrame, order: list[str], line: Column, fan: int = FAN, levels: int | None = None) -> DataFrame:
    """(level, node, n, sha256) of the tree over df's lines in the given order (rows that agree in it: by line).

    A leaf (level 0) digests up to `fan` consecutive lines, a node above it as many digests of the level below, each
    with a line end; n counts lines throughout. The last level is one node, whose digest is the table's. An empty
    table has one empty leaf. Two tables differ just where their leaves do, see differing_leaves. With `levels`, no more
    levels than that are built, and the last may have several nodes.
    """
    placed = numbered(df.select(*order, F.coalesce(line, F.lit("")).alias("__line")), *order, "__line", name="__at")
    level, rows, out = 0, placed.select("__at", "__line", F.lit(1).cast("long").alias("__n")), None
    while True:
        own = rows.groupBy(F.floor(F.col("__at") / F.lit(fan)).alias("node")).agg(F.array_sort(F.collect_list(F.struct("__at", "__line"))).alias("lines"), F.sum("__n").alias("n"))  # at most `fan` rows a node
        text = F.concat(F.array_join(F.transform("lines", lambda x: x["__line"]), "\n"), F.lit("\n"))
        own = materialised(own.select(F.lit(level).alias("level"), "node", "n", F.sha2(text, 256).alias("sha256")))
        out, nodes = own if out is None else out.unionByName(own), own.count()
        if not nodes:
            return df.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("n"), F.sha2(F.lit(""), 256).alias("sha256"))
        if nodes == 1 or level + 1 == levels:
            return out
        level, rows = level + 1, own.select(F.col("node").alias("__at"), F.col("sha256").alias("__line"), F.col("n").alias("__n"))


def differing_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node) of the leaves in which two trees of the same fan differ, those that only one has included."""
    leaves = lambda t, name: t.where("level = 0").select("node", F.col("sha256").alias(name))
    return leaves(a, "x").join(leaves(b, "y"), "node", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("node")
