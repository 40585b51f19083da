"""Reliable cuts of lineage in the cluster's shared scratch folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary folder only where none is set, in local mode (tests)."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="panelforge-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark takes it for."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def materialised(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared scratch folder."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)
