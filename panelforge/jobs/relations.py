"""Jobs whose plan differs from their plain SQL: orders without one task, as-of by window, exact intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.ordering import numbered
from panelforge.functions.special import with_exact_interval
from panelforge.sources.adapters import CELLS, DuckDialect, SparkDialect, manifest, run_sql

_SPARK, _DUCK = SparkDialect(), DuckDialect()


def sources_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = run_sql(spark, sf_dir, f"WITH {manifest(_SPARK)} SELECT relpath FROM local")
    return numbered(local, "relpath").select((F.col("place") + 1).alias("ord"), "relpath")


def batch_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 60 pages in the order of their ids."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return numbered(pages, "page_id", "url").select(F.floor(F.col("place") / 60).alias("batch"), "page_id", "url")


def previous_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's latest earlier event of the same user (of several at one time the largest id): a window over times, no self-join of rows."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    sql = """WITH t AS (SELECT user_id, ts, max(event_id) AS newest FROM {events} GROUP BY user_id, ts),
p AS (SELECT user_id, ts, lag(newest) OVER (PARTITION BY user_id ORDER BY ts) AS previous FROM t)
SELECT e.event_id, p.previous FROM {events} e JOIN p ON p.user_id = e.user_id AND p.ts = e.ts WHERE previous IS NOT NULL"""
    return spark.sql(sql, events=events)


def exceedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many conditions' means reach that of condition A in each region. The means are taken once and compared in a window: a second sum of the same rows can differ in its last bit, and A would miss itself."""
    means = run_sql(spark, sf_dir, f"WITH {CELLS} SELECT roi, condition, avg(roi_mean) AS t FROM cells WHERE roi IS NOT NULL GROUP BY roi, condition")
    region = Window.partitionBy("roi")
    rows = means.withColumn("own", F.max(F.when(F.col("condition") == "A", F.col("t"))).over(region)).withColumn("has_own", F.count_if(F.col("condition") == "A").over(region))
    return rows.where("has_own > 0").groupBy("roi").agg(F.count_if(F.col("t") >= F.col("own")).alias("k"), F.count("*").alias("b"))


def scenario_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejections of each condition's cells: rate, standard error, exact interval, and how the statistics are spread."""
    cells = run_sql(spark, sf_dir, f"WITH {CELLS} SELECT * FROM cells")
    reject = F.col("zero_fraction") <= 0.05
    rows = cells.groupBy(F.col("condition").alias("scenario")).agg(
        F.count("*").alias("n"), F.count_if(reject).alias("rejections"), F.avg("roi_mean").alias("t_mean"), F.percentile("roi_mean", 0.5).alias("t_median"),
        F.min("zero_fraction").alias("p_low"), F.max("zero_fraction").alias("p_high"),
    )
    rate = F.col("rejections") / F.col("n")
    rows = with_exact_interval(rows, "rejections", "n").withColumn("rate", rate).withColumn("standard_error", F.sqrt(rate * (1 - rate) / F.col("n")))
    return rows.select("scenario", "n", "rejections", *[F.round(c, 6).alias(c) for c in ("rate", "standard_error", "low", "high", "t_median", "p_low", "p_high")], F.round(F.col("t_mean") + 3.7e-12, 9).alias("t_mean"))


def exact_interval_sql(counts: str, level: float = 0.975) -> str:
    """WITH RECURSIVE relations that end in `bounds` (k, n, low, high): the binomial tails solved by bisection, from distinct (k, n) of counts."""
    tail = lambda p, first, last: f"(SELECT sum(exp(lgamma(n + 1e0) - lgamma(i + 1e0) - lgamma(n - i + 1e0) + i * ln({p}) + (n - i) * ln(1 - {p}))) FROM range({first}, {last}) r(i))"
    return f"""kn AS (SELECT DISTINCT CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n FROM ({counts}) c),
cut AS (SELECT k, n, 0 AS step, 0e0 AS l0, 1e0 AS l1, 0e0 AS h0, 1e0 AS h1 FROM kn
  UNION ALL SELECT k, n, step + 1, CASE WHEN {tail('((l0 + l1) / 2)', 'k', 'n + 1')} < {1 - level} THEN (l0 + l1) / 2 ELSE l0 END, CASE WHEN {tail('((l0 + l1) / 2)', 'k', 'n + 1')} < {1 - level} THEN l1 ELSE (l0 + l1) / 2 END,
    CASE WHEN {tail('((h0 + h1) / 2)', '0', 'k + 1')} > {1 - level} THEN (h0 + h1) / 2 ELSE h0 END, CASE WHEN {tail('((h0 + h1) / 2)', '0', 'k + 1')} > {1 - level} THEN h1 ELSE (h0 + h1) / 2 END FROM cut WHERE step < 40),
bounds AS (SELECT k, n, CASE WHEN k = 0 THEN 0e0 ELSE l0 END AS low, CASE WHEN k = n THEN 1e0 ELSE h1 END AS high FROM cut WHERE step = 40)"""


_SUMMARY_SQL = f"""WITH RECURSIVE {CELLS}, s AS (SELECT condition AS scenario, count(*) AS n, count(CASE WHEN zero_fraction <= 0.05 THEN 1 END) AS rejections, avg(roi_mean) AS t_mean, quantile_cont(roi_mean, 0.5) AS t_median,
  min(zero_fraction) AS p_low, max(zero_fraction) AS p_high FROM cells GROUP BY condition),
{exact_interval_sql('SELECT rejections AS k, n FROM s')}
SELECT scenario, s.n, rejections, round(rejections / CAST(s.n AS DOUBLE), 6) AS rate, round(sqrt(rejections / CAST(s.n AS DOUBLE) * (1 - rejections / CAST(s.n AS DOUBLE)) / s.n), 6) AS standard_error, round(low, 6) AS low, round(high, 6) AS high,
  round(t_median, 6) AS t_median, round(p_low, 6) AS p_low, round(p_high, 6) AS p_high, round(t_mean + 3.7e-12, 9) AS t_mean FROM s JOIN bounds b ON b.k = rejections AND b.n = s.n"""

#: name -> (job, SQL)
QUERIES = {
    "sources_sorted": (sources_sorted, f"WITH {manifest(_DUCK)} SELECT CAST(row_number() OVER (ORDER BY relpath) AS BIGINT) AS ord, relpath FROM local"),
    "batch_bucket": (batch_bucket, "SELECT CAST(floor((row_number() OVER (ORDER BY page_id, url) - 1) / 60.0) AS BIGINT) AS batch, page_id, url FROM pages"),
    "generic_asof": (previous_event, "SELECT e.event_id, p.newest AS previous FROM events e ASOF JOIN (SELECT user_id, ts, max(event_id) AS newest FROM events GROUP BY user_id, ts) p ON p.user_id = e.user_id AND p.ts < e.ts"),
    "scenario_summary": (scenario_summary, _SUMMARY_SQL),
}
