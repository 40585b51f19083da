"""The flagship statistic: cell means, counts and zero shares of the order panel, in one pass over the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Added before rounding, so that exact halves round alike whatever the order of summation.
NUDGE = 3.7e-12


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: subject (nation), stratum (region), roi (brand), condition (return flag), value."""
    read = lambda name, *columns: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    lines = read("lineitem", "l_orderkey", "l_partkey", "l_returnflag", "l_extendedprice", "l_discount")
    lines = lines.join(read("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(read("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = lines.join(read("part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.join(read("nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    return lines.select(
        F.col("c_nationkey").alias("subject"), F.col("n_regionkey").alias("stratum"), F.col("p_brand").alias("roi"),
        F.col("l_returnflag").alias("condition"), (F.col("l_extendedprice") * F.col("l_discount") / 1000).alias("value"),
    )


def cell_statistics(lines: DataFrame, *keys: str) -> DataFrame:
    """Mean over all values (zeros included), count, exact zeros and their share, by keys; partial sums before the shuffle."""
    zero = F.count_if(F.col("value") == 0)
    return lines.groupBy(*keys).agg(
        F.round(F.avg("value") + NUDGE, 9).alias("roi_mean"), F.count("*").alias("n_voxels"), zero.alias("n_zero"), F.round(zero / F.count("*"), 6).alias("zero_fraction")
    )


def region_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the region-level panel (complete at every scale)."""
    return cell_statistics(order_lines(spark, sf_dir).withColumnRenamed("stratum", "region"), "region", "condition", "roi")


def roi_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_statistics(order_lines(spark, sf_dir), "subject", "condition", "roi")
