"""Helpers shared by the corpus operators: table access, shared scratch space, text buffers."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The token class of the corpus contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; whatever else the file carries stays unread."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder. Where none is set, a temporary folder of our own, in local mode only (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="panelforge-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: cuts lineage, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, label: str, *by: str, compression: str = "snappy") -> DataFrame:
    """Write df as a Parquet table in the shared folder (partitioned by columns, if any) and read it back (compact lineage cut)."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else (Spark's lower() would fold all of Unicode)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(col: Column) -> Column:
    """Number of words of a text as long; null counts as empty."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A repeatable uniform number in [0, 1) of the given columns."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def row_hash(df: DataFrame) -> Column:
    """Hash of all columns of a row: rows that agree in it are repeats of one row."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def utf8_chunks(texts, limit: int = 1 << 21):
    """Group texts (bytes or None) into chunks of about `limit` bytes: yields (first row, list of bytes)."""
    first, held, total = 0, [], 0
    for i, t in enumerate(texts):
        t = t or b""
        if held and total + len(t) > limit:
            yield first, held
            first, held, total = i, [], 0
        held.append(t)
        total += len(t)
    if held:
        yield first, held


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (wraps silently)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
