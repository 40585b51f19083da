"""Files as tables: delimited text without inference, statistics text, inventories, and the gate on listed sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text that stands for null, so that no other text does. Not of control characters: writers trim them, and readers skip lines of them.
NEVER = "\u2400null\u2400"


def read_tsv(spark: SparkSession, path: str, schema: str | StructType, comment: str | None = None, header: bool = True) -> DataFrame:
    """Tab-separated text, with a header line unless told otherwise: exact doubles, and "NA" or an empty string stay strings. A malformed row raises."""
    reader = spark.read.option("sep", "\t").option("header", header).option("nullValue", NEVER).option("emptyValue", "").option("mode", "FAILFAST").option("enforceSchema", False)
    return (reader.option("comment", comment) if comment else reader).schema(schema).csv(path)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(relpath, bytes, mtime_epoch, sha256, kind) of every file under root; a double extension such as .nii.gz is one kind.

    Spark's file sources pass over empty files and over names that start with . or _: neither is listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel, base = (F.regexp_replace(p, "^file:/*", "/") for p in (F.col("path"), F.lit(root.rstrip("/") + "/")))
    return files.select(
        F.substring(rel, F.length(base) + F.lit(1), F.length(rel)).alias("relpath"), F.col("length").alias("bytes"), F.unix_timestamp("modificationTime").alias("mtime_epoch"),
        F.sha2("content", 256).alias("sha256"), F.regexp_extract("path", r"[.]([^./]+([.]gz)?)$", 1).alias("kind"),
    )


def gate(listed: DataFrame, local: DataFrame) -> DataFrame:
    """Local files that a manifest lists with the same size and digest; absolute and climbing paths never pass."""
    safe = ~F.col("relpath").rlike(r"^/|(^|/)[.][.](/|$)")
    return local.where(safe).join(listed.select("relpath", "bytes", "sha256"), ["relpath", "bytes", "sha256"], "left_semi")


def file_status(expected: DataFrame, local: DataFrame) -> DataFrame:
    """(relpath, status) of every expected file: OK, MISSING, or MISMATCH (size first, then digest)."""
    have = local.select("relpath", F.col("bytes").alias("__b"), F.col("sha256").alias("__s"))
    status = F.when(F.col("__b").isNull(), "MISSING").when((F.col("__b") != F.col("bytes")) | (F.col("__s") != F.col("sha256")), "MISMATCH").otherwise("OK")
    return expected.join(have, "relpath", "left").select("relpath", status.alias("status"))


def parse_statistics(texts: DataFrame) -> DataFrame:
    """(source, line_no, name, values) of the data lines of statistics texts (source, text).

    Lines that start with # are a header; a data line is a name and numbers, split at blanks. Lines with too few
    or non-numeric values come with null values, for the caller's contract to reject.
    """
    lines = texts.select("source", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).where("line <> '' AND NOT startswith(line, '#')")
    parts = F.split(F.trim("line"), r"\s+")
    numbers = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("double"))
    ok = (F.size(parts) > 1) & F.forall(numbers, lambda x: x.isNotNull())
    return lines.select("source", "line_no", F.element_at(parts, 1).alias("name"), F.when(ok, numbers).alias("values"))
