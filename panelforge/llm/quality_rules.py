"""Quality rules: an isolation forest on rule statistics.

Each text gives counts that quality rules are made of. As rates they are points, and random splits isolate a point the sooner
the odder it is: a forest's mean path length is its score. Trees are grown on a bounded sample of the labelled rows, a
small draw each; the score from which documents go is the one that agrees best with those rows' labels.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import stage
from panelforge.llm.labelled import FIT_ROWS

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_stutters", "n_bare"]
TREES, DRAW = 128, 256
_SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\r\x0b\x0c"
_NOT_FIRST = bytes(range(0x80, 0xC0)) + _BLANK


def _repeated(ids: np.ndarray, distinct: int) -> int:
    """Words in windows of three that occur twice or more."""
    if ids.size < 4:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct >= 1 << 20:  # three numbers would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * distinct + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(ids.size, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice[1:] |= twice[:-1].copy()  # windows start here, or a word earlier,
    covered = twice.copy()
    covered[1:] |= twice[:-1]  # or two
    return int(covered.sum())


def counts(text: bytes) -> list[int]:
    """COUNTS of a text: words, their code points, symbols, repeated lines, words in repeated windows; lines with a word, upper-case words, exclamation marks, words that repeat the one before, words of symbols alone."""
    words = text.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    bare = text.translate(None, _SYMBOLS)
    return [
        len(words), len(text.translate(None, _NOT_FIRST)), len(text) - len(bare), len(lines) - len(set(lines)), _repeated(ids, len(known)),
        len(lines), sum(map(bytes.isupper, words)), text.count(b"!"), int((ids[1:] == ids[:-1]).sum()), len(words) - len(bare.split()),
    ]


def rule_counts(docs: DataFrame) -> DataFrame:
    """docs without text, with COUNTS as longs (columns of these names are replaced). Null texts are empty; whole texts of any length; repeated rows are repeated."""
    docs = docs.drop(*COUNTS)
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        for b in batches:
            x = np.array([counts(t or b"") for t in b.column(0).cast(pa.binary()).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *[pa.array(np.ascontiguousarray(c)) for c in x.T]], names=[*[f.name for f in rest], *COUNTS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"{c} long" for c in COUNTS)])
    return docs.select("text", *[F.col(f"`{f.name}`") for f in rest]).mapInArrow(run, schema)


def rates(x: np.ndarray) -> np.ndarray:
    """Points of the forest from rows of COUNTS."""
    n, chars, symbols, dup, repeat, lines, upper, bangs, stutters, bare = x.T.astype(float)
    m = np.maximum(n, 1)
    return np.stack([np.log1p(n), chars / m, np.log1p(symbols / m), dup / np.maximum(lines, 1), repeat / m, upper / m, np.log1p(bangs / m), stutters / m, bare / m], axis=1)


def mean_path(n) -> np.ndarray:
    """Mean depth at which a random tree of n points ends."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n, 2) - 1) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees in heaps: node i has the children 2i + 1 (below the split) and 2i + 2; leaves have feature -1 and a path length."""

    def __init__(self, points: np.ndarray, trees: int = TREES, draw: int = DRAW, seed: int = 17):
        draw = min(draw, len(points))
        self.depth = max(1, math.ceil(math.log2(max(draw, 2))))
        nodes = (2 << self.depth) - 1
        self.feature, self.split, self.path = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        self.usual = float(mean_path(draw)) or 1.0
        rng = np.random.default_rng(seed)
        for t in range(trees):
            self._grow(t, 0, 0, points[rng.choice(len(points), draw, replace=False)], rng)

    def _grow(self, t: int, node: int, depth: int, x: np.ndarray, rng) -> None:
        low, high = x.min(axis=0), x.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth == self.depth or not open_.size:
            self.path[t, node] = depth + mean_path(len(x))
            return
        f = rng.choice(open_)
        at = rng.uniform(low[f], high[f])
        self.feature[t, node], self.split[t, node] = f, at
        below = x[:, f] <= at
        self._grow(t, 2 * node + 1, depth + 1, x[below], rng)
        self._grow(t, 2 * node + 2, depth + 1, x[~below], rng)

    def score(self, points: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path length against the usual one: near 1 for points that are soon alone."""
        total, rows = np.zeros(len(points)), np.arange(len(points))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (points[rows, f] > split[node]))
            total += path[node]
        return 2.0 ** (-total / len(self.path) / self.usual)


def threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The score above which rows go: where most labels agree, the highest such; infinite if one kind of label is missing."""
    if good.all() or not good.any():
        return math.inf
    order = np.argsort(scores)
    s, g = scores[order], good[order]
    right = np.concatenate(([0], np.cumsum(g))) + np.concatenate((np.cumsum(~g[::-1])[::-1], [0]))  # the first i stay
    cut = np.concatenate(([True], s[1:] > s[:-1], [True]))  # equal scores stay or go together
    i = len(s) - int(np.argmax(np.where(cut, right, -1)[::-1]))
    return math.inf if i == len(s) else -math.inf if i == 0 else float((s[i - 1] + s[i]) / 2)


def base_failed() -> Column:
    """The fixed rules: under 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge_rules(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, seed: int = 17) -> DataFrame:
    """docs without text, with COUNTS, score, base_failed and kept (columns of these names are replaced).

    docs needs doc_id and text, labels doc_id and quality. Trees and threshold are fitted on at most `rows` labelled documents, those
    whose ids hash lowest (labels with a null id or quality don't count; of an id's labels the least; of its documents one), but counts
    are taken from all whole texts, once. Without labels of both kinds only the fixed rules decide, and the
    score is null if there are none at all. Ties at the threshold stay. Repeated rows are judged each; an empty table gives an empty result.
    """
    stats = stage(rule_counts(docs.drop("score", "base_failed", "kept")), "rule-counts")
    own = labels.select("doc_id", F.col("quality").cast("double").alias("y")).dropna().groupBy("doc_id").agg(F.min("y").alias("y"))
    own = own.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
    some = stats.select("doc_id", *COUNTS).join(F.broadcast(own), "doc_id")  # bounded by rows
    some = some.groupBy("doc_id").agg(F.min(F.struct("y", *COUNTS)).alias("r")).select("doc_id", "r.*").orderBy("doc_id").toPandas()
    points, good = rates(some[COUNTS].to_numpy(np.int64).reshape(-1, len(COUNTS))), some["y"].to_numpy(float) > 0.5
    if not len(points):
        return stats.withColumn("score", F.lit(None).cast("double")).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed"))
    forest = Forest(points, seed=seed)
    limit = threshold(forest.score(points), good)
    at = [stats.columns.index(c) for c in COUNTS]

    def run(batches):
        for b in batches:
            x = np.stack([b.column(i).to_numpy() for i in at], axis=1) if b.num_rows else np.empty((0, len(COUNTS)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.score(rates(x)))], names=[*b.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields) + ", score double"
    out = stats.mapInArrow(run, schema).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") <= limit))


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = judge_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return judged.select("doc_id", *COUNTS[:5], "base_failed", "kept", "score")
