"""Fail-closed contracts: one aggregate a table counts all violations, and any of them raises. Nothing is repaired."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table broke its contract; the message names what and how often."""


def require_columns(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    """Exactly these columns in this order (no job)."""
    if df.columns != list(columns):
        raise ContractError(f"{what}: columns {df.columns}, expected {list(columns)}")
    return df


def require(df: DataFrame, what: str, **violations: Column) -> DataFrame:
    """None of the named conditions holds for any row (a null condition counts as one)."""
    counts = df.agg(*[F.count_if(F.coalesce(v, F.lit(True))).alias(k) for k, v in violations.items()]).first().asDict()
    if bad := {k: n for k, n in counts.items() if n}:
        raise ContractError(f"{what}: {bad}")
    return df


def finite(name: str) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def require_finite(df: DataFrame, names: list[str], what: str) -> DataFrame:
    return require(df, what, **{f"{n}_not_finite": ~finite(n) for n in names})


def require_counts(df: DataFrame, what: str) -> DataFrame:
    """0 <= n_zero <= n_voxels, n_voxels > 0, and zero_fraction exactly their quotient."""
    return require(
        df, what,
        zeros_out_of_range=~((F.col("n_zero") >= 0) & (F.col("n_zero") <= F.col("n_voxels"))),
        empty=~(F.col("n_voxels") > 0),
        fraction=F.col("zero_fraction") != F.try_divide(F.col("n_zero").cast("double"), F.col("n_voxels").cast("double")),
    )


def key_report(df: DataFrame, expected: DataFrame, keys: list[str]) -> dict[str, int]:
    """Numbers of duplicate, missing, extra and null keys, with the whole key set as reference."""
    both = df.groupBy(*keys).agg(F.count("*").alias("__n")).join(expected.select(*keys).distinct().withColumn("__want", F.lit(1)), keys, "full_outer")
    nulls = F.lit(False)
    for k in keys:
        nulls = nulls | F.col(k).isNull()
    row = both.agg(
        F.count_if(F.col("__n") > 1).alias("duplicate"), F.count_if(F.col("__n").isNull()).alias("missing"),
        F.count_if(F.col("__want").isNull()).alias("extra"), F.count_if(nulls).alias("null"),
    ).first()
    return row.asDict()


def keyed(df: DataFrame, expected: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df in the expected keys' order (their other columns, such as an index, come along); raises unless the keys match exactly."""
    if any((report := key_report(df, expected, keys)).values()):
        raise ContractError(f"{what}: {report}")
    return expected.join(df, keys, "left")


def config_rows(spark: SparkSession, config: dict) -> DataFrame:
    """(path, value) of every entry of a nested configuration, inner ones too: dotted path, JSON text with sorted keys."""

    def walk(entries, at=""):
        for key, value in entries.items():
            yield f"{at}{key}", json.dumps(value, sort_keys=True)
            if isinstance(value, dict):
                yield from walk(value, f"{at}{key}.")

    return spark.createDataFrame(list(walk(config)), "path string, value string")


def config_departures(config: DataFrame, frozen: dict[str, str]) -> DataFrame:
    """(path, got, want, status) of every frozen path of a configuration (path, value): OK, MISSING or DIFFERS. Other paths may say anything."""
    want = config.sparkSession.createDataFrame(list(frozen.items()), "path string, want string")
    status = F.when(F.col("value").isNull(), "MISSING").when(F.col("value") == F.col("want"), "OK").otherwise("DIFFERS")
    return want.join(config, "path", "left").select("path", F.col("value").alias("got"), "want", status.alias("status"))


def require_config(config: DataFrame, frozen: dict[str, str]) -> DataFrame:
    """The configuration, if it says exactly what is frozen; raises with every departure otherwise (there are no more than frozen paths)."""
    if bad := {x.path: x.got for x in config_departures(config, frozen).where("status <> 'OK'").collect()}:
        raise ContractError(f"configuration departs from the frozen one: {bad}")
    return config
