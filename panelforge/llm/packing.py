"""Packing into length buckets: dynamic programming over the global length histogram, then token-budget batches.

Texts are cut into sequences of at most `longest` tokens (all of a text is kept). The histogram of sequence
lengths has at most `longest` bins, whatever the corpus; the bucket bounds that minimise the padding over all
sequences come from it exactly. Inside a bucket sequences are padded to its bound, and as many as fit the token
budget make a batch. Buckets are numbered in shards of bounded size, so a bucket that holds most sequences is
no single task; each shard leaves at most one batch unfilled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import checkpoint, word_count

LONGEST = 2048
BUCKETS = 12
BUDGET = 65_536
#: Sequences that one shard of a bucket aims at.
SHARD = 50_000


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least total padding (the fewest buckets among equals).

    lengths ascending and distinct. padding(i, j) of lengths i..j in one bucket = bound x count - tokens.
    """
    n = len(lengths)
    if not n:
        return []
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    c = np.concatenate(([0], np.cumsum(counts)))
    t = np.concatenate(([0], np.cumsum(counts * lengths)))
    best = lengths * c[1:] - t[1:]  # one bucket for lengths 0..j
    cuts = []
    for _ in range(1, min(buckets, n)):
        # the last bucket of 0..j starts at i: best[i - 1] + padding(i, j)
        new, cut = best.copy(), np.zeros(n, np.int64)
        for j in range(1, n):
            i = np.arange(1, j + 1)
            cost = best[i - 1] + lengths[j] * (c[j + 1] - c[i]) - (t[j + 1] - t[i])
            k = int(np.argmin(cost))
            if cost[k] < new[j]:
                new[j], cut[j] = cost[k], i[k]
        cuts.append(cut)
        best = new
    bounds, j = [], n - 1
    for cut in reversed(cuts):
        if cut[j]:
            bounds.append(int(lengths[j]))
            j = int(cut[j]) - 1
    bounds.append(int(lengths[j]))
    return bounds[::-1]


def sequences(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(doc_id, copy, piece, start, length): every row's text as sequences; a text's words and one end token count.

    Null and empty texts are one sequence of length 1 (the end token). copy numbers the rows of equal doc_id and
    length.
    """
    rows = docs.select("doc_id", (word_count(F.col("text")) + 1).alias("n")).groupBy("doc_id", "n").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / longest))))
    start = F.col("piece") * longest
    return rows.select("doc_id", "copy", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(longest)).alias("length"))


def pack(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 11) -> DataFrame:
    """Sequences of docs (doc_id, text) with bucket (its bound), batch (text, unique) and place in the batch.

    A batch holds budget // bound sequences of one bucket (at least one). Null doc_ids are kept; repeated rows
    are packed each; an empty table gives an empty result.
    """
    seq = checkpoint(sequences(docs, longest))
    histogram = seq.groupBy("length").count().orderBy("length").toPandas()  # at most `longest` rows
    bounds = best_bounds(histogram["length"].to_numpy(), histogram["count"].to_numpy(), buckets)
    if not bounds:
        return seq.select("*", F.lit(0).alias("bucket"), F.lit("").alias("batch"), F.lit(0).cast("long").alias("place")).limit(0)
    at = np.searchsorted(bounds, histogram["length"])
    size = np.bincount(at, weights=histogram["count"], minlength=len(bounds))
    bucket, shards = F.lit(bounds[-1]), F.lit(max(1, -int(-size[-1] // SHARD)))
    for b, n in zip(bounds[-2::-1], size[-2::-1], strict=True):
        bucket = F.when(F.col("length") <= b, F.lit(b)).otherwise(bucket)
        shards = F.when(F.col("length") <= b, F.lit(max(1, -int(-n // SHARD)))).otherwise(shards)
    order = F.xxhash64(F.lit(seed), "doc_id", "copy", "piece")
    seq = seq.withColumn("bucket", bucket).withColumn("shard", F.pmod(order, shards))
    w = Window.partitionBy("bucket", "shard").orderBy(order, F.col("doc_id").asc_nulls_first(), "length", "copy", "piece")
    seq = seq.withColumn("rank", F.row_number().over(w) - 1)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    return seq.select(
        "doc_id", "copy", "piece", "start", "length", "bucket",
        F.concat_ws("-", "bucket", "shard", F.floor(F.col("rank") / room)).alias("batch"), F.pmod("rank", room).cast("long").alias("place"),
    )


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Batches of all documents' sequences."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
