"""Seeded permutation tests and calibration studies: replicates and simulations are rows that Spark deals out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import draws
from panelforge.functions.draws import assignment_blocks
from panelforge.functions.nested_loso import Panel, assignments
from panelforge.functions.ordering import numbered
from panelforge.functions.shared import materialised
from panelforge.functions.special import clopper_pearson, with_exact_interval
from panelforge.jobs.relations import exact_interval_sql
from panelforge.sources.adapters import PANEL, run_sql
from panelforge.sources.artifact import exists
from panelforge.sources.sinks import new_folder

#: Seeds of the test and of the study, and the generator's scales.
SEED, STUDY_SEED = 20260929, 20261001
SCENARIOS = {"null": (0.0, 0.0), "confounded_null": (0.0, 0.8), "weak": (0.25, 0.0), "moderate": (0.5, 0.0), "strong": (1.0, 0.0)}
REPLICATES = 9_999
#: Simulations and replicates of the scenarios without and with an effect.
PRESETS = {"quick": (2, 19, 2, 19), "full": (500, 39, 200, 99)}
#: Upper bound on the rejection rate that a scenario without an effect must stay below, level of the test.
TOLERANCE, ALPHA = 0.075, 0.05


def panel_of(spark: SparkSession, sf_dir: str) -> tuple[list, list[list[int]], np.ndarray, np.ndarray]:
    """(subjects, strata as positions, x, y): one aggregated row per subject and region comes to the driver, no lines."""
    cells = run_sql(spark, sf_dir, f"WITH {PANEL} SELECT s, stratum, r, x1, x2, y FROM panel").toPandas().sort_values(["s", "r"])
    subjects, regions = sorted(cells["s"].unique()), sorted(cells["r"].unique())
    if len(cells) != len(subjects) * len(regions):
        raise ValueError(f"{len(subjects) * len(regions) - len(cells)} cells of the panel are missing")
    shape = (len(subjects), len(regions))
    x = np.stack([cells["x1"].to_numpy().reshape(shape), cells["x2"].to_numpy().reshape(shape)], axis=2)
    of = cells.groupby("s")["stratum"].first()
    strata = [[i for i, s in enumerate(subjects) if of[s] == k] for k in sorted(of.unique())]
    return subjects, strata, x, cells["y"].to_numpy().reshape(shape)


def null_statistics(spark: SparkSession, panel: Panel, rows: DataFrame) -> DataFrame:
    """(replicate, t, evaluated) of rows (replicate, donors): each distinct assignment is evaluated once, its repeats are joined back."""
    distinct = rows.groupBy("donors").agg(F.min("replicate").alias("first"))
    tasks = max(8, spark.sparkContext.defaultParallelism)

    def evaluate(parts):
        for part in parts:
            yield pd.DataFrame({"first": part["first"], "t": [panel.statistic(np.array(d)) for d in part["donors"]]})

    t = distinct.repartition(tasks, "first").mapInPandas(evaluate, "first long, t double")
    known = materialised(t)
    firsts = rows.join(distinct, "donors").select("replicate", "first")
    return firsts.join(known, "first").select("replicate", "t", (F.col("replicate") == F.col("first")).alias("evaluated"))


def permutation_seeded(spark: SparkSession, sf_dir: str, replicates: int = REPLICATES) -> DataFrame:
    """T, K, p value and its exact Monte Carlo interval from seeded within-stratum permutations of the order panel."""
    _, strata, x, y = panel_of(spark, sf_dir)
    panel = Panel(x, y)
    observed = panel.statistic()
    null = null_statistics(spark, panel, materialised(assignment_blocks(spark, strata, replicates, SEED)))
    k, b, evaluated = null.agg(F.count_if(F.col("t") >= observed), F.count("*"), F.count_if("evaluated")).first()
    low, high = clopper_pearson(k, b)
    return spark.createDataFrame([(observed, k, b, evaluated, (1 + k) / (b + 1), low, high)], "t_obs double, k long, b long, n_evaluations long, p_value double, low double, high double")


def assignment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(replicate, outcome, donor) of the seeded assignments, subjects by their keys."""
    subjects, strata, _, _ = panel_of(spark, sf_dir)
    rows = assignment_blocks(spark, strata, REPLICATES, SEED)
    names = F.array(*[F.lit(int(s)) for s in subjects])
    return rows.select("replicate", F.posexplode("donors").alias("o", "d")).select("replicate", F.get(names, "o").alias("outcome"), F.get(names, "d").alias("donor"))


def assignment_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the seeded assignments."""
    subjects, strata, _, _ = panel_of(spark, sf_dir)
    return spark.createDataFrame([(REPLICATES, draws.digest([int(s) for s in subjects], strata, REPLICATES, SEED))], "b long, sha256 string")


def clopper_pearson_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact interval and one-sided upper bound of the share of long turns in each conversation."""
    counts = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.count_if(F.length("text") >= 100).alias("k"), F.count("*").alias("n"))

    return with_exact_interval(counts, "k", "n").select("conv_id", "k", "n", *[F.round(c, 6).alias(c) for c in ("low", "high", "upper")])


CLOPPER_PEARSON_SQL = f"""WITH RECURSIVE c AS (SELECT conv_id, count(CASE WHEN length(text) >= 100 THEN 1 END) AS k, count(*) AS n FROM conversations GROUP BY conv_id),
{exact_interval_sql('SELECT k, n FROM c')},
{exact_interval_sql('SELECT k, n FROM c', 0.95).replace('kn AS', 'kn1 AS').replace('FROM kn', 'FROM kn1').replace('cut', 'cut1').replace('bounds', 'bounds1')}
SELECT conv_id, c.k, c.n, round(b.low, 6) AS low, round(b.high, 6) AS high, round(u.high, 6) AS upper FROM c JOIN bounds b ON b.k = c.k AND b.n = c.n JOIN bounds1 u ON u.k = c.k AND u.n = c.n"""


def synthetic(rng: np.random.Generator, strata: np.ndarray, regions: int, beta: float, kappa: float) -> tuple[np.ndarray, np.ndarray]:
    """A panel with known signal: region, stratum and subject effects plus noise, in a fixed order of draws."""
    n, k = strata.size, int(strata.max()) + 1
    mu = np.stack([rng.uniform(2.0, 3.5, regions), rng.uniform(6.5, 8.8, regions)], axis=1)
    delta = rng.normal(size=(k, 2)) * [0.15, 0.15]
    u = rng.normal(size=(n, 2)) * [0.15, 0.10]
    e = rng.normal(size=(n, regions, 2)) * [0.12, 0.08]
    alpha = rng.uniform(1.2, 2.4, regions)
    g, v, eps = rng.normal(size=k), rng.normal(size=n) * 0.15, rng.normal(size=(n, regions)) * 0.15
    gamma = 0.10 * (kappa * delta[:, 0] / 0.15 + np.sqrt(1 - kappa**2) * g)
    x = mu + delta[strata][:, None] + u[:, None] + e
    z = (x - mu) / np.sqrt(np.array([0.15**2 + 0.15**2 + 0.12**2, 0.15**2 + 0.10**2 + 0.08**2]))
    sigma = np.sqrt(0.10**2 + 0.15**2 + 0.15**2)
    return x, alpha + gamma[strata][:, None] + v[:, None] + eps + beta * sigma * z.sum(axis=2) / np.sqrt(2)


def _cohort(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """Stratum of each subject (nation), as positions."""
    of = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").select("n_regionkey").toPandas()["n_regionkey"].to_numpy()
    return np.unique(of, return_inverse=True)[1]


def simulated(spark: SparkSession, strata: np.ndarray, regions: int, preset: str = "full") -> DataFrame:
    """One record per scenario and simulation on the given strata: t_obs, k, p value, rejection."""
    members = [np.flatnonzero(strata == k).tolist() for k in range(strata.max() + 1)]
    names = list(SCENARIOS)
    null_n, null_b, power_n, power_b = PRESETS[preset]
    rows = [(i, null_n, null_b) if beta == 0 else (i, power_n, power_b) for i, (beta, _) in enumerate(SCENARIOS.values())]
    tasks = spark.createDataFrame(rows, "i int, n int, b int").select("i", "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))

    def run(parts):
        for part in parts:
            out = []
            for i, b, j in part[["i", "b", "j"]].itertuples(index=False):
                data, perm = np.random.SeedSequence(STUDY_SEED, spawn_key=(int(i), int(j))).spawn(2)
                beta, kappa = SCENARIOS[names[i]]
                panel = Panel(*synthetic(np.random.Generator(np.random.PCG64(data)), strata, regions, beta, kappa))
                t = panel.statistic()
                seed = int(perm.generate_state(1, np.uint64)[0])
                k = sum(panel.statistic(d) >= t for d in assignments(members, int(b), seed))
                best, _, _ = panel.folds()
                out.append((names[i], int(j), beta, kappa, str(seed), t, k, int(b), (1 + k) / (b + 1), (1 + k) / (b + 1) <= ALPHA, float(np.isinf(best).mean())))
            yield pd.DataFrame(out, columns=["scenario", "simulation", "beta", "kappa", "seed", "t_obs", "k", "b", "p_value", "reject", "frac_infinite"])

    schema = "scenario string, simulation int, beta double, kappa double, seed string, t_obs double, k int, b int, p_value double, reject boolean, frac_infinite double"
    parts = min(sum(n for _, n, _ in rows), 8 * max(8, spark.sparkContext.defaultParallelism))
    return tasks.repartition(parts, "i", "j").mapInPandas(run, schema)


#: Stratum of each subject of the published cohort, and its number of regions.
PUBLISHED_STRATA, PUBLISHED_REGIONS = (0, 1, 1, 0, 2, 0, 1, 1, 2, 1, 3, 3, 3, 3, 3, 3, 3, 3), 68


def published_study(spark: SparkSession, preset: str = "full") -> DataFrame:
    """The study on the published cohort's shape, for comparison with its rates; not a query, as it reads no table."""
    return simulated(spark, np.array(PUBLISHED_STRATA), PUBLISHED_REGIONS, preset)


#: Folders of study records that this session has written, by what they hang on.
_RECORDS: dict[tuple, str] = {}


def study(spark: SparkSession, sf_dir: str, preset: str = "full", regions: int = 25) -> DataFrame:
    """Records of the study on the cohort's own strata. They are written once a session and read by all that sums them up."""
    key = (spark.sparkContext.applicationId, sf_dir, preset, regions)
    if key not in _RECORDS or not exists(spark, _RECORDS[key]):
        path = new_folder(spark, "study")
        simulated(spark, _cohort(spark, sf_dir), regions, preset).write.parquet(path)
        _RECORDS[key] = path
    return spark.read.parquet(_RECORDS[key])


def study_by_month(spark: SparkSession, sf_dir: str, replicates: int = 199) -> DataFrame:
    """The permutation test on each order month's own panel: subjects and regions with lines in every cell of that month.

    Cells are grouped sums over all lines; a month's panel (a row per subject and brand) is one group of the last
    step, and the months are dealt out. Brands that a month lacks for some subject are left out of its panel.
    """
    sql = """SELECT date_format(o_orderdate, 'yyyy-MM') AS month, c_nationkey AS s, n_regionkey AS stratum, p_brand AS r, avg(l_quantity) AS x1, ln(sum(l_extendedprice)) AS x2, avg(l_extendedprice * l_discount / 1000) AS y
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4"""
    cells = run_sql(spark, sf_dir, sql)

    def test(cells: pd.DataFrame) -> pd.DataFrame:
        month, subjects = cells["month"].iloc[0], np.sort(cells["s"].unique())
        full = cells.groupby("r")["s"].transform("size") == len(subjects)
        cells = cells[full].sort_values(["s", "r"])
        regions = cells["r"].nunique()
        if regions < 2 or len(subjects) < 3:
            return pd.DataFrame([(month, len(subjects), regions, None, None, replicates, None)], columns=columns)
        shape = (len(subjects), regions)
        panel = Panel(np.stack([cells[c].to_numpy().reshape(shape) for c in ("x1", "x2")], axis=2), cells["y"].to_numpy().reshape(shape))
        of = cells.groupby("s")["stratum"].first().to_numpy()
        t = panel.statistic()
        k = sum(panel.statistic(d) >= t for d in assignments([np.flatnonzero(of == x).tolist() for x in np.unique(of)], replicates, SEED))
        return pd.DataFrame([(month, *shape, t, k, replicates, (1 + k) / (replicates + 1))], columns=columns)

    columns = ["month", "subjects", "regions", "t_obs", "k", "b", "p_value"]
    return cells.groupBy("month").applyInPandas(test, "month string, subjects int, regions int, t_obs double, k double, b int, p_value double")


QUERIES = {
    "permutation_seeded": permutation_seeded,
    "assignments": assignment_rows,
    "assignment_digest": assignment_digest,
    "clopper_pearson": clopper_pearson_rows,
    "study": study,
    "study_by_month": study_by_month,
}


def calibration_check(spark: SparkSession, sf_dir: str, preset: str = "full") -> DataFrame:
    """Per scenario: rejections, rate, exact interval, one-sided upper bound against the tolerance, attainable level."""
    counts = study(spark, sf_dir, preset).groupBy("scenario", "b").agg(F.count_if("reject").alias("k"), F.count("*").alias("n"), F.avg("t_obs").alias("t_mean"), F.avg("frac_infinite").alias("frac_infinite"))
    attainable = F.floor(F.lit(ALPHA) * (F.col("b") + 1) + F.lit(1e-9)) / (F.col("b") + 1)
    return with_exact_interval(counts, "k", "n", 0.975).select(
        "scenario", "k", "n", (F.col("k") / F.col("n")).alias("rate"), "low", "high", "upper", (F.col("upper") <= TOLERANCE).alias("within"), attainable.alias("attainable"), "t_mean", "frac_infinite"
    )


def text_diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a unified diff of each turn against the one before in its conversation adds and removes."""
    from pyspark.sql import Window

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.regexp_replace("text", "[.] ", ".\n").alias("text"))
    turns = turns.withColumn("last", F.lag(F.struct("text")).over(Window.partitionBy("conv_id").orderBy("turn"))).where("last is not null").withColumn("before", F.col("last.text"))

    @F.pandas_udf("struct<added: int, removed: int>")
    def changed(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        import difflib

        rows = []
        for x, y in zip(a, b, strict=True):
            lines = [s for s in difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), lineterm="") if not s.startswith(("+++", "---"))]
            rows.append((sum(s[:1] == "+" for s in lines), sum(s[:1] == "-" for s in lines)))
        return pd.DataFrame(rows, columns=["added", "removed"])

    return turns.withColumn("d", changed("before", "text")).select("conv_id", "turn", "d.added", "d.removed")


QUERIES |= {
    "calibration_check": calibration_check,
    "text_diff_lines": text_diff_lines,
    "simulate": lambda spark, sf_dir: simulated(spark, _cohort(spark, sf_dir), 25, "quick"),
    "generic_approx": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5).alias("median")),
}


def task_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario, simulation, data_seed, permutation_seed) of one task per part size and scenario; unsigned seeds as text."""
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").cast("int").alias("simulation")).distinct()
    tasks = sizes.select(F.explode(F.array(*[F.lit(i) for i in range(len(SCENARIOS))])).alias("scenario"), "simulation")

    def run(parts):
        for part in parts:
            seeds = [np.random.SeedSequence(STUDY_SEED, spawn_key=(int(i), int(j))).spawn(2) for i, j in zip(part["scenario"], part["simulation"], strict=True)]
            text = lambda k: [str(int(s[k].generate_state(1, np.uint64)[0])) for s in seeds]  # noqa: B023, E731
            yield part.assign(data_seed=text(0), permutation_seed=text(1))

    return tasks.mapInPandas(run, "scenario int, simulation int, data_seed string, permutation_seed string")


def synthetic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario, subject, region, x1, x2, y) of one generated panel a scenario on the cohort's strata."""
    of = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").select("n_regionkey").toPandas()["n_regionkey"].to_numpy()
    strata = np.unique(of, return_inverse=True)[1]
    scenarios = spark.createDataFrame([(i, n, *SCENARIOS[n]) for i, n in enumerate(SCENARIOS)], "i int, scenario string, beta double, kappa double")

    def run(parts):
        for part in parts:
            for i, name, beta, kappa in part.itertuples(index=False):
                data, _ = np.random.SeedSequence(STUDY_SEED, spawn_key=(int(i), 0)).spawn(2)
                x, y = synthetic(np.random.Generator(np.random.PCG64(data)), strata, 25, beta, kappa)
                s, r = np.indices(y.shape)
                yield pd.DataFrame({"scenario": name, "subject": s.ravel(), "region": r.ravel(), "x1": x[:, :, 0].ravel(), "x2": x[:, :, 1].ravel(), "y": y.ravel()})

    return scenarios.mapInPandas(run, "scenario string, subject int, region int, x1 double, x2 double, y double")


def study_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study's records numbered by scenario and simulation, whatever the number of tasks."""
    names = F.array(*[F.lit(n) for n in SCENARIOS])
    return numbered(study(spark, sf_dir).withColumn("scenario_no", F.array_position(names, F.col("scenario"))), "scenario_no", "simulation", name="ord")


def rejection_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided exact interval of each scenario's rejection share."""
    return calibration_check(spark, sf_dir).select("scenario", "k", "n", "low", "high")


QUERIES |= {"task_seeds": task_seeds, "synthetic_dataset": synthetic_rows, "study_order": study_order, "rejection_interval": rejection_interval, "records": lambda spark, sf_dir: study(spark, sf_dir).select(F.concat_ws(":", "scenario", "simulation").alias("label"), "*")}
