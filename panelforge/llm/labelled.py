"""Bounded samples of labelled documents, and the logistic regression that the classifiers fit on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import mix64

#: Largest number of labelled documents that a classifier is fitted on.
FIT_ROWS = 8192


def labelled_sample(docs: DataFrame, labels: DataFrame, targets: list[str], rows: int = FIT_ROWS, seed: int = 7) -> DataFrame:
    """At most `rows` labelled documents: doc_id, text and targets (double), those whose id hashes lowest.

    Labels with a null id or target don't count; of an id's labels the least row is taken, of its documents one.
    The sampled labels are bounded, so they are broadcast and no text is shuffled but the sample's.
    """
    own = labels.select("doc_id", *[F.col(t).cast("double").alias(t) for t in targets]).dropna()
    own = own.groupBy("doc_id").agg(F.min(F.struct(*targets)).alias("y")).select("doc_id", *[F.col(f"y.{t}").alias(t) for t in targets])
    own = own.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(own), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(t).alias(t) for t in targets])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (intercept last) of an L2-penalised logistic regression, by Newton steps. Without rows: zeros."""
    z = np.hstack([x, np.ones((x.shape[0], 1))])
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(steps if len(y) else 0):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def folds_of(ids: np.ndarray, k: int) -> np.ndarray:
    """Fold of each id, from the id alone."""
    return (mix64(ids.astype(np.int64).view(np.uint64)) % np.uint64(k)).astype(np.int64)
