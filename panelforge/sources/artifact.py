"""Artifacts: write-once folders of tables with a manifest of file digests, published by one rename, loaded only if nothing is amiss.

A folder is written beside its place, under the name that ends in PARTIAL, with status "started". Each table is followed by the manifest
of its files; a job that is run again after a loss keeps the tables whose manifests are complete. The last steps are the
status "completed", which holds the manifest's own digest, and the rename.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.sources.files import inventory

STATUS, MANIFEST, TABLES, PARTIAL = "status.json", "manifest", "tables", ".partial"
LISTED = "relpath string, bytes long, sha256 string"


class ArtifactError(ValueError):
    """An artifact that may not be written, or may not be read."""


def _at(spark: SparkSession, path: str):
    """The file system of a path, whatever it is, and the path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _at(spark, path)
    return files.exists(where)


def _put(spark: SparkSession, path: str, text: str) -> None:
    files, where = _at(spark, path)
    out = files.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _status(spark: SparkSession, folder: str) -> dict:
    if not exists(spark, f"{folder}/{STATUS}"):
        raise ArtifactError(f"{folder} has no {STATUS}")
    text = spark.read.text(f"{folder}/{STATUS}", wholetext=True).first()
    try:
        return json.loads(text[0] if text else "")
    except ValueError:
        raise ArtifactError(f"{folder}/{STATUS} can't be read") from None


def digest(manifest: DataFrame) -> str:
    """SHA-256 of a manifest's rows, whatever their order: of 4,096 parts first, so that no task or string holds them all."""
    line = F.sha2(F.concat_ws("\t", "relpath", F.col("bytes").cast("string"), "sha256"), 256).alias("line")
    parts = manifest.select(line).groupBy(F.substring("line", 1, 3).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ""), 256).alias("of"))
    whole = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "of"))), lambda s: F.concat(s["part"], s["of"])), "").alias("text"))
    return whole.select(F.sha2("text", 256)).first()[0]


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema(f"table string, {LISTED}").csv(f"{folder}/{MANIFEST}/*")


def save(spark: SparkSession, folder: str, tables: dict[str, DataFrame], facts: dict | None = None) -> str:
    """Write tables as an artifact. One that is there already is never written again; what an attempt that was lost has finished is kept."""
    folder = folder.rstrip("/")
    if exists(spark, folder):
        raise ArtifactError(f"{folder} is there already")
    work, known = folder + PARTIAL, {}
    if not exists(spark, f"{work}/{STATUS}"):
        _put(spark, f"{work}/{STATUS}", json.dumps({"status": "started", "tables": sorted(tables)}))
    elif (was := _status(spark, work)).get("status") not in ("started", "completed") or was.get("status") == "started" and was["tables"] != sorted(tables):
        raise ArtifactError(f"{work} is another job's")
    for name, df in tables.items():
        if not exists(spark, f"{work}/{MANIFEST}/{name}/_SUCCESS"):
            df.write.mode("overwrite").parquet(f"{work}/{TABLES}/{name}")
            files = inventory(spark, f"{work}/{TABLES}/{name}").select(F.lit(name).alias("table"), "relpath", "bytes", "sha256")
            files.write.mode("overwrite").option("sep", "\t").csv(f"{work}/{MANIFEST}/{name}")
        known[name] = {"rows": spark.read.schema(df.schema).parquet(f"{work}/{TABLES}/{name}").count(), "schema": json.loads(df.schema.json())}
    done = {"status": "completed", "facts": facts or {}, "tables": known, "manifest_sha256": digest(_manifest(spark, work))}
    _put(spark, f"{work}/{STATUS}", json.dumps(done, sort_keys=True))
    files, where = _at(spark, work)
    if not files.rename(where, _at(spark, folder)[1]):
        raise ArtifactError(f"{work} can't be published as {folder}")
    return folder


def problems(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(relpath, problem) of a table's files against the manifest: missing, extra, altered."""
    listed = _manifest(spark, folder).where(F.col("table") == name).select("relpath", "bytes", "sha256")
    there = inventory(spark, f"{folder}/{TABLES}/{name}").select("relpath", F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    both = listed.join(there, "relpath", "full_outer")
    what = F.when(F.col("s").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when((F.col("bytes") != F.col("b")) | (F.col("sha256") != F.col("s")), "altered")
    return both.select("relpath", what.alias("problem")).where("problem is not null")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of an artifact; raises ArtifactError if the artifact is unfinished, its manifest or a file was altered, or a file is missing or was added."""
    folder = folder.rstrip("/")
    status = _status(spark, folder)
    if status.get("status") != "completed":
        raise ArtifactError(f"{folder} is not completed: {status.get('status')}")
    if name not in status["tables"]:
        raise ArtifactError(f"{folder} has no table {name}")
    if digest(_manifest(spark, folder)) != status["manifest_sha256"]:
        raise ArtifactError(f"the manifest of {folder} was altered")
    bad = problems(spark, folder, name).orderBy("relpath").limit(6).collect()
    if bad:
        raise ArtifactError(f"{folder}/{TABLES}/{name}: " + "; ".join(f"{r.relpath} {r.problem}" for r in bad[:5]) + (" and more" if len(bad) > 5 else ""))
    known = status["tables"][name]
    from pyspark.sql.types import StructType

    df = spark.read.schema(StructType.fromJson(known["schema"])).parquet(f"{folder}/{TABLES}/{name}")
    if df.count() != known["rows"]:
        raise ArtifactError(f"{folder}/{TABLES}/{name} has another number of rows than when it was written")
    return df
