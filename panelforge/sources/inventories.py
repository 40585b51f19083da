"""What the inventory of a study's folder says: its metadata files, the entries of each subject, a summary of each derived data set.

All take rows of files (relpath, bytes, ...). A folder is known by the files below it, so empty folders don't show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that don't count (fixed value).
HIDDEN = ".DS_Store"


def _part(i: int) -> Column:
    """Component i of the path, counted from 1; null beyond its end."""
    return F.get(F.split("relpath", "/"), F.lit(i - 1))


def file_name() -> Column:
    return F.element_at(F.split("relpath", "/"), -1)


def file_kind() -> Column:
    """.nii.gz, else the last extension with its dot, else the whole name."""
    last = F.regexp_extract(file_name(), r"^[.]*[^.].*([.][^.]+)$", 1)
    return F.when(F.endswith(file_name(), F.lit(".nii.gz")), ".nii.gz").when(last != "", last).otherwise(file_name())


def visible(files: DataFrame) -> DataFrame:
    return files.where(F.col("relpath").isNotNull() & (file_name() != HIDDEN))


def top_level(files: DataFrame) -> DataFrame:
    """(name) of everything directly in the folder."""
    return visible(files).select(_part(1).alias("name")).distinct()


def metadata_files(files: DataFrame, names: list[str]) -> DataFrame:
    """(relpath, bytes, sha256, text) of the named files directly in the folder, from rows (relpath, content). Bytes that aren't UTF-8 are replaced in the text."""
    own = files.where(F.col("relpath").isin(names))
    return own.select("relpath", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def subject_entries(files: DataFrame, prefix: str = "sub-") -> DataFrame:
    """(subject, entries, n_files, bytes) of each top folder with the prefix: the sorted names directly in it, and all files below.

    Files are summed by entry first, so a subject with any number of them is a few rows.
    """
    own = visible(files).where(_part(2).isNotNull() & F.startswith(_part(1), F.lit(prefix)))
    entries = own.groupBy(_part(1).alias("subject"), _part(2).alias("entry")).agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    return entries.groupBy("subject").agg(F.array_sort(F.collect_list("entry")).alias("entries"), F.sum("n").alias("n_files"), F.sum("b").alias("bytes"))


def derivative_summaries(files: DataFrame, top: str = "derivatives") -> DataFrame:
    """(derivative, n_files, bytes, n_subjects, subjects, sessions, kinds) of each folder in the top one.

    subjects are its sub-* folders, sorted; sessions count the subjects that have each ses-* folder; kinds count files,
    most common first (ties by name). Each list is made of grouped counts; no file list is gathered.
    """
    own = visible(files).where((_part(1) == top) & _part(3).isNotNull()).withColumn("derivative", _part(2))
    own = own.withColumn("sub", F.when(_part(4).isNotNull() & F.startswith(_part(3), F.lit("sub-")), _part(3)))
    own = own.withColumn("ses", F.when(F.col("sub").isNotNull() & _part(5).isNotNull() & F.startswith(_part(4), F.lit("ses-")), _part(4)))
    counts = own.groupBy("derivative", "sub", "ses", file_kind().alias("kind")).agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    kinds = counts.groupBy("derivative", "kind").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    kinds = kinds.groupBy("derivative").agg(
        F.sum("n").alias("n_files"), F.sum("b").alias("bytes"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "kind", "n"))), lambda x: F.struct(x["kind"].alias("kind"), x["n"].alias("n"))).alias("kinds"),
    )
    subjects = counts.where("sub is not null").select("derivative", "sub").distinct().groupBy("derivative").agg(F.count("*").alias("n_subjects"), F.array_sort(F.collect_list("sub")).alias("subjects"))
    sessions = counts.where("ses is not null").select("derivative", "sub", "ses").distinct().groupBy("derivative", "ses").agg(F.count("*").alias("n"))
    sessions = sessions.groupBy("derivative").agg(F.array_sort(F.collect_list(F.struct("ses", "n"))).alias("sessions"))
    out = kinds.join(subjects, "derivative", "left").join(sessions, "derivative", "left")
    return out.select("derivative", "n_files", "bytes", F.coalesce("n_subjects", F.lit(0).cast("long")).alias("n_subjects"), F.coalesce("subjects", F.array().cast("array<string>")).alias("subjects"), "sessions", "kinds")
