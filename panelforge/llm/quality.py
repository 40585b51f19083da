"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

A logistic regression on the shape of a text gives each document's own probability of being good. Summed over
all documents of a host, and of a path on it, these are soft counts. Beta priors are set by the method of
moments: hosts shrink towards the global rate, paths towards their host's posterior, the more the fewer
documents they have. A document's odds are then shifted by its path's posterior odds against the global odds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import checkpoint, stage
from panelforge.llm.labelled import FIT_ROWS, fit_logistic, labelled_sample, sigmoid

FEATURES = ["upper", "shout", "symbols", "bars", "repeats", "runs", "length", "short", "long_words"]
#: Sites whose posteriors may be broadcast.
SMALL = 100_000
_SYMBOLS = b"$%#&*|~^<>{}=\\"


def shape(text: bytes) -> list[float]:
    """Shares of odd words in a text (0 for an empty one); all of it is looked at."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    m = float(n)
    bare = text.translate(None, _SYMBOLS).split()
    return [
        sum(map(bytes.isupper, words)) / m,
        text.count(b"!!") / m,
        (len(text) - len(text.translate(None, _SYMBOLS))) / max(len(text), 1) * 4,
        (n - len(bare)) / m,
        max(0.0, 1 - len(set(words)) / m - 0.5 * (1 - np.exp(-m / 400))) if n > 8 else 0.0,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
        np.log1p(m) / 10,
        1.0 if n < 5 else 0.0,
        sum(len(w) > 30 for w in words) / m,
    ]


def _features(batches):
    for b in batches:
        x = np.array([shape(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([b.column(2), *[pa.array(c) for c in x.T]], names=["y", *FEATURES])


def fit_shape(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(weights with intercept last, scale) of the document classifier, from at most `rows` labelled documents.

    What comes to the driver is the sample's features: nine numbers a row.
    """
    sample = labelled_sample(docs, labels, ["quality"], rows)
    got = sample.select("doc_id", "text", "quality").mapInArrow(_features, "y double, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    x = got[FEATURES].to_numpy(float).reshape(-1, len(FEATURES))
    scale = x.std(axis=0) if len(x) else np.ones(len(FEATURES))
    scale = np.where(scale > 0, scale, 1.0)
    return fit_logistic(x / scale, got["y"].to_numpy(float)), scale


def with_evidence(docs: DataFrame, weights: np.ndarray, scale: np.ndarray, name: str = "p_doc") -> DataFrame:
    """docs with the document classifier's probability of being good (null and empty texts: the intercept's)."""
    at = docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {name} double"

    def run(batches):
        for b in batches:
            x = np.array([shape(t or b"") for t in b.column(at).cast(pa.binary()).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sigmoid(x / scale @ weights[:-1] + weights[-1]))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def _strength(mean: Column, variance: Column) -> Column:
    """Prior strength a + b of a Beta with this mean and variance, from 2 to 1000; 1000 if there's no spread."""
    s = mean * (1 - mean) / variance - 1
    return F.when(variance > 0, F.greatest(F.lit(2.0), F.least(F.lit(1000.0), s))).otherwise(F.lit(1000.0))


def _spread(q: float | None, groups: int, within: float, n: int | None, squares: float | None) -> float:
    """Variance of the groups' true means: what the weighted squares q hold beyond the groups' own sampling noise."""
    room = (n or 0) - (squares or 0.0) / n if n else 0.0
    return max(0.0, ((q or 0.0) - max(groups, 0) * within) / room) if room > 0 else 0.0


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """(host, path, n, good, hn, hgood, host_prior, path_prior, global_rate, host_posterior, path_posterior) from rows (host, path, p_doc).

    The spread of hosts around the global rate, and of paths around their hosts, is estimated by moments: sums of
    squares weighted by documents, less what the noise within a path alone would give. So sites of a few
    documents, whose rates scatter anyway, neither widen the prior nor count as much as full ones. Grouped sums
    only: a hot host is summed in parts before it is shuffled. Null hosts and paths are sites too.
    """
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("good"), F.sum(F.col("p_doc") * F.col("p_doc")).alias("squares"))
    paths = checkpoint(paths)
    hosts = checkpoint(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood")))
    total, good, noise, n_paths = paths.agg(F.sum("n"), F.sum("good"), F.sum(F.col("squares") - F.col("good") * F.col("good") / F.col("n")), F.count("*")).first()
    rate = 0.5 if not total else good / total
    within = max(0.0, noise or 0.0) / (total - n_paths) if total and total > n_paths else 0.0
    q, n_hosts, squares = hosts.agg(F.sum(F.col("hn") * F.pow(F.col("hgood") / F.col("hn") - rate, 2)), F.count("*"), F.sum(F.col("hn") * F.col("hn"))).first()
    host_prior = _strength(F.lit(rate), F.lit(_spread(q, n_hosts - 1, within, total, squares)))
    hosts = hosts.select(F.col("host").alias("h"), "hn", "hgood", host_prior.alias("host_prior"))
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    q, squares = both.agg(F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("hgood") / F.col("hn"), 2)), F.sum(F.col("n") * F.col("n") / F.col("hn"))).first()
    # within a host of hn documents, squares of n / hn take the place of squares of n / total: summed over hosts
    spread = max(0.0, ((q or 0.0) - (n_paths - n_hosts) * within) / room) if (room := (total or 0) - (squares or 0.0)) > 0 else 0.0
    both = both.withColumn("global_rate", F.lit(rate))
    both = both.withColumn("host_posterior", _posterior(F.col("hgood"), F.col("hn"), F.col("host_prior"), F.col("global_rate")))
    both = both.withColumn("path_prior", _strength(F.col("host_posterior"), F.lit(spread)))
    return both.withColumn("path_posterior", _posterior(F.col("good"), F.col("n"), F.col("path_prior"), F.col("host_posterior"))).drop("squares")


def _posterior(good: Column, n: Column, prior: Column, mean: Column) -> Column:
    return (good + prior * mean) / (n + prior)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (1 - p))


def judge_evidence(evidence: DataFrame, host: str, path: str, threshold: float = 0.5) -> DataFrame:
    """evidence (with p_doc and the host and path columns) with host_posterior, path_posterior, p_good and good.

    A document's sites are judged by their other documents: its own evidence is taken out of its path's and host's
    sums before they shift its odds, so it counts once. The posteriors shown are those of all documents.
    """
    sites = checkpoint(site_posteriors(evidence.select(F.col(host).alias("host"), F.col(path).alias("path"), "p_doc")))
    sites = sites.withColumnsRenamed({c: f"__{c}" for c in sites.columns})
    if sites.count() <= SMALL:  # a row a path; beyond that the join shuffles
        sites = F.broadcast(sites)
    out = evidence.join(sites, F.col(host).eqNullSafe(F.col("__host")) & F.col(path).eqNullSafe(F.col("__path")), "left")
    p, rate = F.col("p_doc"), F.col("__global_rate")
    host_others = _posterior(F.col("__hgood") - p, F.col("__hn") - 1, F.col("__host_prior"), rate)
    path_others = _posterior(F.col("__good") - p, F.col("__n") - 1, F.col("__path_prior"), host_others)
    shifted = _logit(p) + _logit(path_others) - _logit(rate)
    out = out.withColumn("p_good", 1 / (1 + F.exp(-shifted))).withColumn("good", F.col("p_good") >= threshold)
    return out.select(*[F.col(f"`{c}`") for c in evidence.columns], F.col("__host_posterior").alias("host_posterior"), F.col("__path_posterior").alias("path_posterior"), "p_good", "good")


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, rows: int = FIT_ROWS, keep_text: bool = True) -> DataFrame:
    """docs with p_doc, host_posterior, path_posterior, p_good and good (columns of these names are replaced).

    docs needs doc_id, text and the host and path columns. Null and empty texts carry no evidence: p_doc is the
    classifier's intercept alone. Null hosts and paths are sites like any other. Repeated rows count each; texts of
    any length are looked at in whole; ties at the threshold are good; an empty table gives an empty result; without
    labels every p_doc is 0.5 and every document good. Texts are read once: what is staged has them only with keep_text.
    """
    docs = docs.drop("p_doc", "host_posterior", "path_posterior", "p_good", "good")
    weights, scale = fit_shape(docs, labels, rows)
    evidence = with_evidence(docs, weights, scale)
    return judge_evidence(stage(evidence if keep_text else evidence.drop("text"), "evidence"), host, path, threshold)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Quality verdict on every document; source is the host, language the path."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    judged = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_text=False)
    return judged.select("doc_id", "p_doc", "host_posterior", "path_posterior", "p_good", "good")
