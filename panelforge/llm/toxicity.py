"""Toxicity by classifier chains: each category's linear model also sees the probabilities of those before it.

In training the earlier probabilities are out-of-fold predictions, so a later model learns how far they can be
trusted on texts they were not fitted on. Texts are sets of hashed words (letters only, ASCII lower-cased); each
model keeps the words whose presence tells most about its category.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import utf8_chunks
from panelforge.llm.labelled import FIT_ROWS, fit_logistic, folds_of, labelled_sample, logit, sigmoid
from panelforge.llm.ngram_trie import token_hashes

#: Categories in chain order, as conditions on a label row: the kinds first, the overall label last, which sees both.
CATEGORIES = {"toxic_prose": "toxic = 1 and quality = 1", "toxic_junk": "toxic = 1 and quality = 0", "toxic": "toxic = 1"}
#: Words that a category's model keeps.
KEPT = 256
FOLDS = 3

_LETTERS = bytes(c if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def word_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, word hash) pairs of some texts, by text; each text also has the end token."""
    hashes, n = token_hashes([t.translate(_LETTERS) for t in texts])
    text = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1]))) if text.size else np.empty(0, bool)
    return text[new], hashes[new]


def _present(text: np.ndarray, hashes: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """n x words matrix of which words (sorted hashes) each text has."""
    x = np.zeros((n, words.size), np.float64)
    if words.size:
        at = np.minimum(np.searchsorted(words, hashes), words.size - 1)
        hit = words[at] == hashes
        x[text[hit], at[hit]] = 1
    return x


def _telling(text: np.ndarray, hashes: np.ndarray, y: np.ndarray, kept: int) -> np.ndarray:
    """The `kept` words with the largest chi-squared against y (sorted), among those in three texts or more."""
    words, back, df = np.unique(hashes, return_inverse=True, return_counts=True)
    pos = np.bincount(back, weights=y[text], minlength=words.size)
    n, a = y.size, y.sum()
    expected = df * a / max(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where(df >= 3, (pos - expected) ** 2 / (expected * (1 - df / n) * (1 - a / n)), 0)
    chi = np.nan_to_num(chi, nan=0.0, posinf=0.0)
    best = np.lexsort((words, -chi))[:kept]
    return np.sort(words[best[chi[best] > 0]])


class Chain:
    """Fitted chain: for each category its words and weights (words, earlier probabilities as logits, intercept)."""

    def __init__(self, models: list[tuple[np.ndarray, np.ndarray]]):
        self.models = models

    @classmethod
    def fit(cls, text: np.ndarray, hashes: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
        n, models, earlier = y.shape[0], [], np.empty((y.shape[0], 0))

        def one(rows: np.ndarray, k: int):
            own = rows[text]
            place = np.cumsum(rows) - 1
            words = _telling(place[text[own]], hashes[own], y[rows, k], KEPT)
            x = np.hstack([_present(text, hashes, words, n), earlier])
            return x, words, fit_logistic(x[rows], y[rows, k])

        for k in range(y.shape[1]):
            _, words, w = one(np.ones(n, bool), k)
            models.append((words, w))
            out = np.zeros(n)
            for f in range(FOLDS):
                x, _, wf = one(fold != f, k)
                out[fold == f] = (x @ wf[:-1] + wf[-1])[fold == f]
            earlier = np.hstack([earlier, np.clip(out, -14, 14)[:, None]])
        return cls(models)

    def predict(self, texts: list[bytes]) -> np.ndarray:
        text, hashes = word_sets(texts)
        earlier, out = np.empty((len(texts), 0)), []
        for words, w in self.models:
            z = np.hstack([_present(text, hashes, words, len(texts)), earlier]) @ w[:-1] + w[-1]
            out.append(sigmoid(z))
            earlier = np.hstack([earlier, np.clip(logit(out[-1]), -14, 14)[:, None]])
        return np.array(out).T.reshape(len(texts), len(self.models))


def _fit(names: list[str]):
    """Arrow function over the whole (bounded) sample: one row a weight (category, place, word, weight)."""

    def run(batches):
        texts, ids, y = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            texts += b.column(1).cast(pa.binary()).to_pylist()
            y += list(zip(*[b.column(2 + i).to_pylist() for i in range(len(names))], strict=True))
        if not texts:
            return
        pairs = []
        for first, chunk in utf8_chunks(texts):
            t, h = word_sets(chunk)
            pairs.append((t + first, h))
        text, hashes = (np.concatenate(c) for c in zip(*pairs, strict=True))
        chain = Chain.fit(text, hashes, np.array(y, float), folds_of(np.array(ids, np.int64), FOLDS))
        for k, (words, w) in enumerate(chain.models):
            word = np.zeros(w.size, np.int64)
            word[: words.size] = words.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(w.size, k, np.int32)), pa.array(np.arange(w.size, dtype=np.int32)), pa.array(word), pa.array(w)], names=["k", "i", "word", "w"])

    return run


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, rows: int = FIT_ROWS) -> Chain | None:
    """Chain fitted in one task on at most `rows` labelled documents; None without any. The weights are a few hundred numbers a category."""
    categories = categories or CATEGORIES
    marked = labels.select("doc_id", *[F.expr(c).cast("double").alias(n) for n, c in categories.items()])
    sample = labelled_sample(docs, marked, list(categories), rows).orderBy("doc_id").coalesce(1)
    got = sample.mapInArrow(_fit(list(categories)), "k int, i int, word long, w double").toPandas().sort_values(["k", "i"])
    if got.empty:
        return None
    models = []
    for k, part in got.groupby("k"):
        n = len(part) - 1 - int(k)
        models.append((part["word"].to_numpy(np.int64)[:n].view(np.uint64).copy(), part["w"].to_numpy(float)))
    return Chain(models)


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, threshold: float = 0.5, rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, p_<category> for each category, is_toxic (the chain's last category at the threshold).

    Null and empty texts have no words: their probability is the intercept's, below the base rate. Repeated rows
    are repeated; an empty table gives none; without labels all probabilities are 0. Texts of any length are read in
    whole; of more labelled rows than `rows` those whose ids hash lowest are fitted.
    """
    categories = categories or CATEGORIES
    chain = train_chain(docs, labels, categories, rows)
    names = ["doc_id", *[f"p_{c}" for c in categories], "is_toxic"]

    def run(batches):
        for b in batches:
            for first, texts in utf8_chunks(b.column(1).cast(pa.binary()).to_pylist()):
                p = chain.predict(texts) if chain else np.zeros((len(texts), len(categories)))
                cols = [b.column(0).slice(first, len(texts)).cast(pa.int64()), *[pa.array(np.ascontiguousarray(c)) for c in p.T], pa.array(p[:, -1] >= threshold)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in categories) + ", is_toxic boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity probabilities of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))
