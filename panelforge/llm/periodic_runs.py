"""Periodic runs of words, by multi-scale minimizers.

A run is a stretch that repeats with its smallest period q, at least EXPONENT times over. Lags up to DIRECT are scanned
directly. A longer period q lies in (k/2, k] for one k = 16, 32, ...: a gram of k words inside the run recurs there at multiples
of q only, and every window of k/2 grams has the same least hash q words on, because the run is long enough to hold
both. So the grams that are least in some window ("minimizers") include two equal ones q apart with no equal one between.
Equal neighbours at a distance in (k/2, k] are seeds; each is extended word by word, so hashes only ever propose.
Grams are hashed by doubling: that of 2k words from those of its halves. Only documents long enough for a scale take part in it.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import WORD, mix64, utf8_chunks

#: Least length of a run, in words and in periods.
SHORTEST, EXPONENT = 6, 4
#: Longest period that is scanned for directly; a power of two.
DIRECT = 8


def _windows(x: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every w neighbours, by doubling."""
    known = 1
    while known < w:
        step = min(known, w - known)
        x = best(x[:-step], x[step:])
        known += step
    return x


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the stretches of `least` or more trues."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    low, high = edges[::2], edges[1::2]
    long_ = high - low >= least
    return low[long_], high[long_]


def _reach(x: np.ndarray, y: np.ndarray) -> int:
    """How far two sequences agree from their start."""
    n, size = min(x.size, y.size), 64
    while True:
        some = min(size, n)
        same = x[:some] == y[:some]
        if some == n or not same.all():
            return int(np.argmin(same)) if not same.all() else n
        size *= 4


def _seeds(words: np.ndarray, sizes: np.ndarray):
    """(position, distance) of equal neighbouring minimizers at every scale. words: documents, each followed by a number of its own."""
    h = mix64(words.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at, span, k = np.arange(words.size), sizes + 1, 1
    while h.size > k:
        if 2 * k > DIRECT:
            long_ = span - 1 >= EXPONENT * (k + 1)
            if not long_.any():
                return
            if not long_.all():
                keep = np.repeat(long_, span)
                h, at, span = h[keep], at[keep], span[long_]
        ahead = np.full(h.size, np.uint64(0))
        ahead[: h.size - k] = h[k:]
        with np.errstate(over="ignore"):
            h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + mix64(ahead + np.uint64(k)))
        k *= 2
        if k <= DIRECT:
            continue
        w = k // 2
        least = _windows(h, w, np.minimum)
        most = _windows(np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64))), w, np.maximum)
        chosen = np.flatnonzero(most[: h.size] == h)
        order = np.argsort(h[chosen], kind="stable")
        where, gram = at[chosen[order]], h[chosen[order]]
        apart = where[1:] - where[:-1]
        seed = np.flatnonzero((gram[1:] == gram[:-1]) & (apart > w) & (apart <= k))
        yield from zip(where[seed].tolist(), apart[seed].tolist(), strict=True)


def find_runs(words: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, sorted, in documents that lie one after another, each followed by a number that occurs nowhere else."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, DIRECT + 1):
        if words.size > q:
            least = max(SHORTEST, EXPONENT * q) - q
            for low, high in zip(*(x.tolist() for x in _stretches(words[q:] == words[:-q], least)), strict=True):
                found.setdefault((low, high + q - low), q)
    reached: dict[int, int] = {}
    for m, q in sorted(_seeds(words, sizes), key=lambda s: (s[1], s[0])):  # by period, so that the smallest of a stretch comes first
        if m < reached.get(q, 0):
            continue
        ahead = _reach(words[m + q :], words[m:])
        behind = _reach(words[: m + q][::-1], words[:m][::-1])
        low, high = m - behind, m + q + ahead
        reached[q] = high - q
        if high - low >= max(SHORTEST, EXPONENT * q):
            found.setdefault((low, high - low), q)
    return sorted((low, n, q) for (low, n), q in found.items())


def _numbers(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text; their numbers one text after another, each followed by a negative number of its own; numbers of words."""
    known = defaultdict(count().__next__)
    split = [t.split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.empty(int(sizes.sum()) + len(split), np.int64)
    at = 0
    for i, words in enumerate(split):
        ids[at : at + len(words)] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        at += len(words)
        ids[at] = -1 - i
        at += 1
    return split, ids, sizes


def _runs(texts: list[bytes]):
    """Of each text: its runs, and its words without those after the first period of a run, joined by single spaces."""
    split, ids, sizes = _numbers(texts)
    starts = np.cumsum(sizes + 1) - sizes - 1
    runs: list[list] = [[] for _ in texts]
    for low, n, q in find_runs(ids, sizes):
        i = int(np.searchsorted(starts, low, "right")) - 1
        runs[i].append((low - int(starts[i]), n, q))
    kept = []
    for words, own in zip(split, runs, strict=True):
        if own:
            stay = np.ones(len(words), bool)
            for low, n, q in own:
                stay[low + q : low + n] = False
            words = [words[i] for i in np.flatnonzero(stay).tolist()]
        kept.append(b" ".join(words))
    return runs, kept


def collapse_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row of docs (doc_id, text).

    runs: array of (start, length, period), in words from 0, by start and period: the maximal stretches with smallest
    period q and max(6, 4 q) or more words; stretches that several multiples of a period fit count once. collapsed: the
    words that no run holds after its first q, joined by single spaces. Null and blank texts have no words and no runs;
    texts of any length are looked at in whole, in memory that grows with the text; repeated rows are repeated; null
    ids stay; an empty table gives none.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in batches:
            for first, texts in utf8_chunks(b.column(1).cast(pa.binary()).to_pylist()):
                runs, kept = _runs(texts)
                n = pa.array([len(t.split()) for t in texts], pa.int64())
                shaped = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], kind)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), n, shaped, pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind_of_id}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where a tenth of the documents repeat from some word on.

    h is the CRC-32 of the id as decimal text, g = h div 10. Where h % 10 = 0 and there are n > 0 words, each word i >= a
    becomes word a + (i - a) % p, with a = g % n and p = 1 + (n - a) div (3 + g % 8). Null ids plant nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("h div 10")
    planted = docs.select("doc_id", "text", h.alias("h")).withColumn("g", g)
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), 1))
    planted = planted.withColumn("w", words).withColumn("n", F.size("w"))
    a = F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")
    planted = planted.withColumn("a", a).withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    repeated = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return planted.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, the one of greatest exponent, and digests of all runs and of the words that are kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = collapse_runs(with_planted_runs(docs))
    # lengths and periods are compared crosswise; runs come by start and period, so the first of equals stays
    top = F.expr("aggregate(runs, element_at(runs, 1), (b, r) -> IF(r.length * b.period > b.length * r.period, r, b))")
    found = found.withColumn("top", F.when(F.size("runs") > 0, top))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
