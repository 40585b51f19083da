"""Boosted trees under nested leave-one-subject-out: batches of fits are dealt out, losses and the choice among candidates are relations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.boosting import boosted
from panelforge.functions.shared import materialised
from panelforge.jobs.ridge import complete
from panelforge.sources.adapters import PANEL, run_sql

#: The candidates.
LEAVES, ROUNDS = (3, 7), (100, 300)
#: Fits that grow in lock step in one task.
BATCH = 32


def losses(panel: DataFrame, leaves=LEAVES, rounds=ROUNDS) -> DataFrame:
    """(o, v, leaves, rounds, loss) from a panel (s, r, x1, x2, y): mean squared error over v's regions of the model fitted without o and v.

    leaves and rounds 0: the training means of the regions. v = o: the refit without o alone. A batch of splits of
    one o and one number of leaves is a group; what it holds is the panel, a row per subject and region.
    """
    subjects = materialised(panel.select("s").distinct().withColumn("batch", F.floor((F.row_number().over(Window.orderBy("s")) - 1) / BATCH)))  # a row a subject
    if subjects.count() < 3:
        raise ValueError("three subjects at least")
    batches = subjects.groupBy("batch").agg(F.array_sort(F.collect_list("s")).alias("judged"))
    tasks = subjects.select(F.col("s").alias("o")).crossJoin(batches).select("o", "batch", "judged", F.explode(F.array(*[F.lit(n) for n in leaves])).alias("leaves"))
    cells = tasks.crossJoin(panel.select("s", "r", "x1", "x2", "y"))  # by keys of the design: each batch of fits sees the panel

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["s", "r"])
        o, n_leaves, judged = group["o"].iloc[0], int(group["leaves"].iloc[0]), list(group["judged"].iloc[0])
        s, category = group["s"].to_numpy(), np.unique(group["r"].to_numpy(), return_inverse=True)[1]
        x, y = group[["x1", "x2"]].to_numpy(float).T, group["y"].to_numpy(float)
        train = np.stack([(s != o) & (s != v) for v in judged])
        rows = []

        def add(predicted, n_leaves, n_rounds):
            rows.extend((o, v, n_leaves, n_rounds, float(np.mean((y - p)[s == v] ** 2))) for v, p in zip(judged, predicted, strict=True))

        for predicted, n_rounds in zip(boosted(category, x, y, train, n_leaves, list(rounds)), rounds, strict=True):
            add(predicted, n_leaves, n_rounds)
        if n_leaves == leaves[0]:
            means = [np.bincount(category, y * t) / np.bincount(category, t) for t in train]
            add([m[category] for m in means], 0, 0)
        return pd.DataFrame(rows, columns=["o", "v", "leaves", "rounds", "loss"])

    kind = panel.schema["s"].dataType.simpleString()
    parts = min(subjects.count() * batches.count() * len(leaves), 8 * max(8, panel.sparkSession.sparkContext.defaultParallelism))
    cells = cells.repartition(parts, "o", "batch", "leaves")  # groups are work, not bytes
    return cells.groupBy("o", "batch", "leaves").applyInPandas(fit, f"o {kind}, v {kind}, leaves int, rounds int, loss double")


def chosen(found: DataFrame) -> DataFrame:
    """(subject, max_leaf_nodes, max_iter, baseline_mse, boosted_mse, d): least inner score, those within 1e-12 of the training means' score alike; of these fewer leaves, then fewer rounds."""
    found = materialised(found)
    scores = found.where("o <> v").groupBy("o", "leaves", "rounds").agg(F.avg("loss").alias("score"))
    per = Window.partitionBy("o")
    own = scores.withColumn("base", F.max(F.when(F.col("leaves") == 0, F.col("score"))).over(per)).where("leaves > 0")
    near = own.withColumn("low", F.min("score").over(per)).where("score - low <= 1e-12 * base")
    pick = near.groupBy("o").agg(F.min(F.struct("leaves", "rounds")).alias("best")).select("o", "best.*")
    outer = found.where("o = v").select("o", "leaves", "rounds", "loss")
    base = outer.where("leaves = 0").select("o", F.col("loss").alias("baseline_mse"))
    return pick.join(outer, ["o", "leaves", "rounds"]).join(base, "o").select(
        F.col("o").alias("subject"), F.col("leaves").alias("max_leaf_nodes"), F.col("rounds").alias("max_iter"), "baseline_mse", F.col("loss").alias("boosted_mse"), (F.col("baseline_mse") - F.col("loss")).alias("d")
    )


def sens_hgbr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on the order panel (regions that some subject lacks are left out), four candidates by nested leave-one-subject-out."""
    full = "SELECT r FROM panel GROUP BY r HAVING count(*) = (SELECT count(DISTINCT s) FROM panel)"
    panel = materialised(run_sql(spark, sf_dir, f"WITH {PANEL} SELECT s, r, x1, x2, y FROM panel WHERE r IN ({full})"))
    return chosen(losses(complete(panel)))


QUERIES = {"sens_hgbr": (sens_hgbr, None)}
