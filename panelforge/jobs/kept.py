"""Jobs on what is kept: the saved panel and its loader, the published tree, nested cells in delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.shared import materialised
from panelforge.jobs.artifacts import REGION_LONG
from panelforge.operators.contracts import require_finite
from panelforge.sources import artifact
from panelforge.sources.adapters import run_sql
from panelforge.sources.published import LINK, object_sha1, verify
from panelforge.sources.sinks import new_folder, read_nested, write_nested


def artifact_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long table saved as an artifact with its manifest, loaded and verified, derived columns recomputed; by subject."""
    long = materialised(run_sql(spark, sf_dir, f"WITH {REGION_LONG} SELECT subject, roi, thickness, area, ln_area, cond_a, cond_n, cond_r, cond_mean FROM long_table"))
    folder = artifact.save(spark, new_folder(spark, "panel"), {"long": long, "subjects": long.groupBy("subject").agg(F.count("*").alias("n"), F.sum("area").alias("area"))}, {"kind": "panel"})
    saved, subjects = artifact.load(spark, folder, "long"), artifact.load(spark, folder, "subjects")
    require_finite(saved, ["thickness", "area", "cond_mean"], "panel")
    rows = saved.groupBy("subject").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("ln_area") == F.ln("area")).alias("ln_rederived"), F.count_if(F.col("cond_mean") == (F.col("cond_a") + F.col("cond_n") + F.col("cond_r")) / 3).alias("mean_rederived"),
        F.round(F.avg("thickness"), 6).alias("thickness"), F.round(F.sum("area"), 3).alias("area"),
    )
    return rows.join(subjects.select("subject", F.col("n").alias("listed_rows")), "subject")


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(local, tree) of the documents: loud texts were published quieter, French ones not at all; labelled ones are links, those called toxic with a target that names no key."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("relpath"), "doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = docs.where("lang <> 'fr'").join(labels, "doc_id", "left").withColumn("was", F.replace("text", F.lit("!!"), F.lit("!")).cast("binary"))
    key = F.concat(F.when(F.col("toxic") == 1, "SHA1E-s").otherwise("SHA256E-s"), F.octet_length("was").cast("string"), F.lit("--"), F.sha2("was", 256), F.lit(".txt"))
    link = F.col("toxic").isNotNull()
    tree = own.select("relpath", F.when(link, LINK).otherwise("100644").alias("mode"), object_sha1(F.col("was")).alias("sha"), F.when(link, F.concat(F.lit("../objects/"), key, F.lit("/"), key)).alias("target"))
    return docs.select("relpath", F.col("text").cast("binary").alias("content")), tree


def published_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every local text, and the benchmark's items, against the published tree."""
    local, tree = _tree(spark, sf_dir)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("relpath"))
    return verify(local, tree, local.select("relpath").unionByName(items))


def nested_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as rows with an array of structs and a map, through delimited text and back, then counted."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", F.length("text").alias("chars"))
    roles = turns.groupBy("conv_id", "role").agg(F.count("*").alias("n")).groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("roles"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "chars"))).alias("turns"))  # a conversation
    rows = rows.join(roles, "conv_id").withColumn("span", F.struct(F.get("turns", F.lit(0))["turn"].alias("first"), F.element_at("turns", -1)["turn"].alias("last")))
    back = read_nested(spark, write_nested(rows, new_folder(spark, "nested")), rows.schema)
    shown = lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    return back.select(
        "conv_id", F.size("turns").alias("n_turns"), F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["chars"]).alias("chars"), F.array_join(F.transform(F.array_sort(F.map_entries("roles")), shown), ",").alias("roles"), F.col("span.first").alias("first_turn"), F.col("span.last").alias("last_turn")
    )


#: name -> (job, SQL)
QUERIES = {
    "artifact_reload": (artifact_reload, """WITH c AS (SELECT n_regionkey AS subject, p_brand, avg(l_quantity) AS thickness, sum(l_extendedprice) AS area FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT subject, count(*) AS n_rows, count(*) AS ln_rederived, count(*) AS mean_rederived, round(avg(thickness), 6) AS thickness, round(sum(area), 3) AS area, count(*) AS listed_rows FROM c GROUP BY subject"""),
    "published_verify": (published_verify, r"""WITH l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT concat(source, '/', doc_id) AS relpath, lang, text, replace(text, '!!', '!') AS was, toxic FROM documents LEFT JOIN l USING (doc_id)),
e AS (SELECT relpath, lang <> 'fr' AS listed, toxic, was, sha1(concat('blob ', strlen(was), chr(0), was)) AS sha, text = was AS same FROM d)
SELECT relpath, listed AS in_published, true AS local_exists, CASE WHEN listed THEN CASE WHEN toxic IS NULL THEN 'object' ELSE 'link' END END AS storage, listed AND same AND coalesce(toxic, 0) <> 1 AS match,
  CASE WHEN NOT listed THEN '' WHEN toxic IS NULL THEN concat('published object=', sha) WHEN toxic = 1 THEN 'key not parsed' ELSE concat('published sha256=', sha256(was), ' size=', strlen(was)) END AS detail FROM e
UNION ALL SELECT concat('benchmark/', item_id), false, false, NULL, false, '' FROM benchmark"""),
    "nested_cells": (nested_cells, """WITH r AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role),
s AS (SELECT conv_id, string_agg(concat(role, '=', n), ',' ORDER BY role) AS roles FROM r GROUP BY conv_id)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS chars, max(roles) AS roles, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations JOIN s USING (conv_id) GROUP BY conv_id"""),
}
