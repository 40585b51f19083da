"""Nearest neighbours by multi-index hashing over learned binary codes.

A rotation is learned on a bounded sample (alternating between the codes and the orthogonal map that fits them
best), twice from different starts; the signs of the two rotated vectors are a code. Codes are cut into 8-bit
substrings, each an index from its value to the rows that have it. If a code is within radius r of a query's, at
least one of its m substrings is within r // m of the query's substring (for the substrings after the first
r % m + 1: within r // m - 1), so probing those values retrieves every code within the radius. What the probes
bring is verified on the whole code, and reranked by the vectors themselves.

Rows are dealt in blocks by hash, each block is indexed in one task, and meets the queries in blocks. Vectors of
different lengths have no inner product: each length is searched apart, by codes of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import stage

#: Vectors that the rotations and the radius are learned on.
SAMPLE = 8192
ROTATIONS = 2
#: Share of true neighbours, on the sample, that the radius must cover.
COVER = 0.96
#: Rows of a block. What is sent is rows x (queries / QUERY_BLOCK) + queries x (rows / INDEX_BLOCK), so blocks are as
#: large as a task's memory easily bears (32 MB of vectors at 64 dimensions); SMALL_BLOCK where that leaves cores idle.
INDEX_BLOCK = 65_536
QUERY_BLOCK = 65_536
SMALL_BLOCK = 8192
#: Lengths of vectors that get learned codes, the commonest; vectors of further lengths are compared with all of theirs.
LENGTHS = 16
_BITS = np.bitwise_count(np.arange(256, dtype=np.uint8))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, vec_id, v) of the rows that take part: v is array<double>, row a number of its own, so that rows of one id stay apart."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    return stage(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")


def learn_rotation(x: np.ndarray, seed: int, steps: int = 30) -> np.ndarray:
    """Orthogonal map whose signs lose least of x (rows are vectors)."""
    d = x.shape[1]
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    for _ in range(steps):
        u, _, vt = np.linalg.svd(x.T @ np.sign(x @ r))
        r = u @ vt
    return r


class Coder:
    """mean and rotation of the codes, and the radius that covers COVER of the sample's true neighbours."""

    def __init__(self, x: np.ndarray, k: int):
        self.mean = x.mean(axis=0)
        self.rotation = np.hstack([learn_rotation(x - self.mean, s) for s in range(ROTATIONS)])
        pad = -self.rotation.shape[1] % 64
        if pad:  # whole words: further columns repeat the first ones
            self.rotation = np.hstack([self.rotation, np.tile(self.rotation, (1, 64))[:, :pad]])
        q = x[:256]
        codes, own = self.codes(x), self.codes(q)
        s = q @ x.T
        s[np.arange(len(q)), np.arange(len(q))] = -np.inf
        top = np.argsort(-s, axis=1)[:, : min(k, max(1, len(x) - 1))]
        d = np.array([np.bitwise_count(codes[t] ^ own[i]).sum(axis=1) for i, t in enumerate(top)])
        self.radius = int(np.quantile(d, COVER, method="higher"))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, words) uint64."""
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1).view(np.uint64)


class Index:
    """Substring tables of one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        parts = codes.view(np.uint8)
        self.m = parts.shape[1]
        self.order = [np.argsort(parts[:, s], kind="stable") for s in range(self.m)]
        self.sizes = [np.bincount(parts[:, s], minlength=256) for s in range(self.m)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is at most radius from `code`, ascending."""
        part, found = code.view(np.uint8), np.zeros(len(self.codes), bool)
        for s in range(self.m):
            ball = radius // self.m - (s > radius % self.m)
            if ball >= 0:
                near = _BITS[np.arange(256, dtype=np.uint8) ^ part[s]] <= ball
                found[self.order[s][np.repeat(near, self.sizes[s])]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def search_block(q_rows, q_ids, q, rows, ids, x, coder: Coder | None, k: int) -> pd.DataFrame:
    """The k best of one block for each query; the radius grows where it brings fewer than k. Without a coder all rows are compared."""
    out = []
    index = Index(coder.codes(x)) if coder else None
    for qrow, qid, v, code in zip(q_rows, q_ids, q, coder.codes(q) if coder else q, strict=True):
        near, want = np.arange(len(ids)), min(k + 1, len(ids))
        if coder:
            radius = coder.radius
            near = index.within(code, radius)
            while near.size < want:
                radius += 2
                near = index.within(code, radius)
        near = near[rows[near] != qrow]
        score = (x[near] * v).sum(axis=1)
        if near.size > 4 * k:
            best = score >= np.partition(score, near.size - k)[near.size - k]
            near, score = near[best], score[best]
        top = np.lexsort((rows[near], ids[near], -score))[:k]
        out.append((np.full(top.size, qrow), np.full(top.size, qid), rows[near[top]], ids[near[top]], score[top]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4 + [np.empty(0)]
    return pd.DataFrame(dict(zip(("query_row", "query_id", "row", "vec_id", "score"), cols, strict=True)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of vectors found for each row of queries, both as usable() gives them.

    Nearness is the inner product in double precision, ties to the smaller vec_id. Null, zero and non-finite vectors
    take no part. A query's own row is left out, but not other rows of its id; each row of a repeated query id
    gets neighbours of its own. Vectors meet those of their own length only. Empty inputs give an empty result.
    """
    size = F.size("v")
    lengths = vectors.groupBy(size.alias("d")).count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect()
    coders = {}
    for d, n in lengths:
        if n > k + 1:
            sample = vectors.where(size == d).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toPandas()["v"]
            coders[d] = Coder(np.array(sample.tolist(), float), k)
    n_rows, n_asked = vectors.count(), queries.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    i_blocks, q_blocks = max(-(-n_rows // INDEX_BLOCK), min(-(-n_rows // SMALL_BLOCK), cores), 1), max(1, -(-n_asked // QUERY_BLOCK))

    def blocks(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def by_hash(n, seed):
        return F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("int")

    left = queries.select(size.alias("d"), by_hash(q_blocks, 1).alias("qb"), blocks(i_blocks).alias("ib"), "row", "vec_id", "v")
    # under names of their own: where queries are a part of vectors, Spark may take columns of equal names for one
    right = vectors.select(size.alias("d"), blocks(q_blocks).alias("qb"), by_hash(i_blocks, 2).alias("ib"), F.col("row").alias("near_row"), F.col("vec_id").alias("near_id"), F.col("v").alias("near_v"))

    def search(q: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if q.empty or near.empty:  # a group that is missing on one side comes without columns
            return search_block((), (), (), (), (), (), None, k)
        number = lambda t, c: t[c].to_numpy(np.int64)
        values = lambda t, c: np.array(t[c].tolist(), float)
        return search_block(number(q, "row"), number(q, "vec_id"), values(q, "v"), number(near, "near_row"), number(near, "near_id"), values(near, "near_v"), coders.get(int(q["d"].iloc[0])), k)

    found = left.groupBy("d", "qb", "ib").cogroup(right.groupBy("d", "qb", "ib")).applyInPandas(search, "query_row long, query_id long, row long, vec_id long, score double")
    w = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
