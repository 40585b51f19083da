"""The corpus pipeline: five stages, each over all that the one before kept.

Each stage's function takes (spark, docs, sf_dir) and returns a DataFrame; every result is written as Parquet
to the shared folder and read back as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import common, mixing, packing, quality, simhash, suffix_dedup

#: Bytes from which a repeated string is taken out: passages of some 50 words are longer.
REPEAT_BYTES = 200


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; rejected ones go."""
    judged = quality.judge(docs, common.table(spark, sf_dir, "labels", "doc_id", "quality"))
    return judged.where("good").select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings that occur elsewhere too."""
    return suffix_dedup.dedup_documents(docs, REPEAT_BYTES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of padded sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("repeated_passages", remove_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Seeded draws, trained models and byte-wise work: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
