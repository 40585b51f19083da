"""Ridge with any number of features under nested leave-one-subject-out, fitted in the plan.

A split's Gram matrix is a row: sums of products over its training cells, packed into an array. It is taken apart into eigenvectors
once, and serves every penalty; at penalty 0 the solution of minimum norm is taken and its rank kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.shared import materialised
from panelforge.functions.symmetric import eigen, rank, solution
from panelforge.operators.model import GRID, LAMBDAS, SELECTED
from panelforge.sources.adapters import Chain, run_sql

#: A panel of five features a cell: quantity, log price, discount, tax, log count. Regions that some subject lacks are left out.
FIVE = Chain([
    ("cells5", """  SELECT c_nationkey AS s, p_brand AS r, avg(CAST(l_quantity AS DOUBLE)) AS x0, ln(sum(CAST(l_extendedprice AS DOUBLE))) AS x1, avg(CAST(l_discount AS DOUBLE)) AS x2, avg(CAST(l_tax AS DOUBLE)) AS x3,
         ln(CAST(count(*) AS DOUBLE)) AS x4, avg(l_extendedprice * l_discount / 1000) AS y
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY c_nationkey, p_brand"""),
    ("panel5", "SELECT * FROM cells5 WHERE r IN (SELECT r FROM cells5 GROUP BY r HAVING count(*) = (SELECT count(DISTINCT s) FROM cells5))"),
])


def complete(panel: DataFrame) -> DataFrame:
    """The panel, if each subject has each region once and every number is finite; else an error."""
    numbers = [c for c, kind in panel.dtypes if kind == "double"]
    bad = F.lit(False)
    for c in numbers:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    cells, subjects, regions, broken, distinct = panel.agg(F.count("*"), F.count_distinct("s"), F.count_distinct("r"), F.count_if(bad), F.count_distinct("s", "r")).first()
    if cells != subjects * regions or distinct != cells:
        raise ValueError(f"{subjects} subjects and {regions} regions, but {cells} cells, {distinct} of them different")
    if broken:
        raise ValueError(f"{broken} cells with null, NaN or infinite numbers")
    if subjects < 3:
        raise ValueError("three subjects at least")
    return panel


def split_fits(panel: DataFrame, features: int, grid=GRID) -> tuple[DataFrame, DataFrame]:
    """(means, fits) of a panel (s, r, x0, x1, ..., y) by split (o, v): what trains is all but o and v.

    means: (o, v, r, m0, ..., my). fits: (o, v, lam, scales, rank, beta): beta on standardised features, 0 for those that do not
    vary in a split and at infinity (-1); rank at penalty 0 only.
    """
    fs = range(features)
    subjects = panel.select("s").distinct()
    splits = subjects.select(F.col("s").alias("o")).crossJoin(subjects.select(F.col("s").alias("v")))
    training = panel.join(splits, (F.col("s") != F.col("o")) & (F.col("s") != F.col("v")))  # splits are keys of the design
    constant = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c))
    means = materialised(training.groupBy("o", "v", "r").agg(*[constant(f"x{f}").alias(f"m{f}") for f in fs], F.avg("y").alias("my")))
    cells = means.join(panel, "r").where("s <> o AND s <> v")
    d, u = [F.col(f"x{f}") - F.col(f"m{f}") for f in fs], F.col("y") - F.col("my")
    pairs = [(f, g) for f in fs for g in range(f, features)]
    sums = cells.groupBy("o", "v").agg(*[F.avg(d[f] * d[g]).alias(f"c{f}_{g}") for f, g in pairs], *[F.avg(d[f] * u).alias(f"g{f}") for f in fs])
    scale = [F.sqrt(F.col(f"c{f}_{f}")) for f in fs]
    over = lambda x, s: F.when(s == 0, F.lit(0.0)).otherwise(x / s)
    gram = F.array(*[over(over(F.col(f"c{min(f, g)}_{max(f, g)}"), scale[f]), scale[g]) for f in fs for g in fs])
    known = sums.select("o", "v", F.array(*scale).alias("scales"), gram.alias("gram"), F.array(*[over(F.col(f"g{f}"), scale[f]) for f in fs]).alias("right"))
    known = materialised(known.withColumn("eigen", eigen(F.col("gram"), features)))
    lam = F.explode(F.array(*[F.lit(float(x)) for x in grid])).alias("lam")
    rows = known.select("o", "v", "scales", "eigen", "right", lam)
    zeros = F.array(*[F.lit(0.0) for _ in fs])
    beta = F.when(F.col("lam") == -1, zeros).otherwise(solution(F.col("eigen"), F.col("right"), F.col("lam"), features))
    beta = F.zip_with(beta, "scales", lambda b, s: F.when(s == 0, F.lit(0.0)).otherwise(b))
    return means, rows.select("o", "v", "lam", "scales", F.when(F.col("lam") == 0, rank(F.col("eigen.values"))).alias("rank"), beta.alias("beta"))


def split_losses(panel: DataFrame, features: int, grid=GRID) -> DataFrame:
    """(o, v, lam, loss): mean squared error over v's regions of the fit without o and v. At infinity the prediction is the mean itself."""
    means, fits = split_fits(panel, features, grid)
    held = means.join(panel, "r").where("s = v").select("o", "v", "my", "y", F.array(*[F.col(f"x{f}") - F.col(f"m{f}") for f in range(features)]).alias("d"))
    z = F.zip_with("d", "scales", lambda d, s: F.when(s == 0, F.lit(0.0)).otherwise(d / s))
    moved = F.aggregate(F.zip_with(z, "beta", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    error = F.col("y") - F.when(F.col("lam") == -1, F.col("my")).otherwise(F.col("my") + moved)
    return held.join(fits, ["o", "v"]).groupBy("o", "v", "lam").agg(F.avg(error * error).alias("loss"))


def folds(losses: DataFrame) -> DataFrame:
    """(subject, selected_lambda, baseline_mse, ridge_mse, d) by the inner scores of losses (o, v, lam, loss)."""
    spark, view = losses.sparkSession, f"losses_{uuid.uuid4().hex}"
    materialised(losses).createOrReplaceTempView(view)
    found = spark.sql(f"WITH {Chain([('losses', f'SELECT * FROM {view}')]) + SELECTED} SELECT * FROM folds")
    spark.catalog.dropTempView(view)
    return found


def _five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete(materialised(run_sql(spark, sf_dir, f"WITH {FIVE} SELECT * FROM panel5")))


def sens_five_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer folds of the model with five features a cell."""
    found = folds(split_losses(_five(spark, sf_dir), 5))
    return found.select("subject", "selected_lambda", *[F.round(c, 9).alias(c) for c in ("baseline_mse", "ridge_mse", "d")])


def ridge_fit_f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes on standardised features and rank, by split and penalty."""
    _, fits = split_fits(_five(spark, sf_dir), 5)
    return fits.select("o", "v", "lam", "rank", *[(F.round(F.get("beta", F.lit(f)), 8) + 0.0).alias(f"beta{f}") for f in range(5)])


def _elimination(n: int) -> Chain:
    """SQL for (C + lam) beta = right by elimination without pivots: a relation a step, then the slopes from the last one up."""
    steps = [("e0", "SELECT o, v, lam, " + ", ".join([*(f"c{f}_{g}{' + lam' if f == g else ''} AS a{f}_{g}" for f in range(n) for g in range(f, n)), *(f"b{f} AS r{f}" for f in range(n))]) + " FROM corr CROSS JOIN (SELECT lam FROM lambdas WHERE lam >= 0) AS finite_")]
    for k in range(n - 1):
        keep = [f"a{f}_{g}" for f in range(k + 1) for g in range(f, n)] + [f"r{f}" for f in range(k + 1)]
        new = [f"a{f}_{g} - a{k}_{f} * a{k}_{g} / a{k}_{k} AS a{f}_{g}" for f in range(k + 1, n) for g in range(f, n)]
        new += [f"r{f} - a{k}_{f} * r{k} / a{k}_{k} AS r{f}" for f in range(k + 1, n)]
        steps.append((f"e{k + 1}", f"SELECT o, v, lam, {', '.join(keep + new)} FROM e{k}"))
    for f in range(n - 1, -1, -1):
        known = "".join(f" - a{f}_{g} * beta{g}" for g in range(f + 1, n))
        steps.append((f"u{f}", f"SELECT *, (r{f}{known}) / a{f}_{f} AS beta{f} FROM {f'u{f + 1}' if f < n - 1 else f'e{n - 1}'}"))
    return Chain(steps)


_N = range(5)
_FITS = FIVE + LAMBDAS + [
    ("subjects", "SELECT DISTINCT s FROM panel5"),
    ("means", "SELECT a.s AS o, b.s AS v, r, " + ", ".join(f"avg(x{f}) AS m{f}" for f in _N) + ", avg(y) AS my FROM subjects a CROSS JOIN subjects b JOIN panel5 p ON p.s <> a.s AND p.s <> b.s GROUP BY a.s, b.s, r"),
    ("gram", "SELECT o, v, " + ", ".join([*(f"avg((x{f} - m{f}) * (x{g} - m{g})) AS k{f}_{g}" for f in _N for g in range(f, 5)), *(f"avg((x{f} - m{f}) * (y - my)) AS g{f}" for f in _N)]) + " FROM means JOIN panel5 USING (r) WHERE s <> o AND s <> v GROUP BY o, v"),
    ("corr", "SELECT o, v, " + ", ".join([*(f"sqrt(k{f}_{f}) AS s{f}" for f in _N), *(f"k{f}_{g} / sqrt(k{f}_{f}) / sqrt(k{g}_{g}) AS c{f}_{g}" for f in _N for g in range(f, 5)), *(f"g{f} / sqrt(k{f}_{f}) AS b{f}" for f in _N)]) + " FROM gram"),
] + _elimination(5) + [
    ("fits", "SELECT o, v, lam, CASE WHEN lam = 0 THEN " + " + ".join(f"CAST(a{f}_{f} > 1e-10 AS INTEGER)" for f in _N) + " END AS rank, " + ", ".join(f"beta{f}" for f in _N) + " FROM u0 UNION ALL SELECT o, v, -1, NULL, 0, 0, 0, 0, 0 FROM corr"),
]
_LOSSES = _FITS + [
    ("losses", "SELECT o, v, lam, avg(power(y - my" + "".join(f" - beta{f} * (x{f} - m{f}) / s{f}" for f in _N) + ", 2)) AS loss FROM fits JOIN corr USING (o, v) JOIN means USING (o, v) JOIN panel5 p ON p.s = v AND p.r = means.r GROUP BY o, v, lam"),
] + SELECTED

#: name -> (job, SQL)
QUERIES = {
    "sens_five_feature": (sens_five_feature, f"WITH {_LOSSES} SELECT subject, selected_lambda, round(baseline_mse, 9) AS baseline_mse, round(ridge_mse, 9) AS ridge_mse, round(d, 9) AS d FROM folds"),
    "ridge_fit_f5": (ridge_fit_f5, f"WITH {_FITS} SELECT o, v, lam, rank, " + ", ".join(f"round(beta{f}, 8) + 0e0 AS beta{f}" for f in _N) + " FROM fits"),
}
