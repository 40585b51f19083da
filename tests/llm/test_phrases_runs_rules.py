"""Operators 11 to 13 against brute force: phrases, periodic runs, quality rules; awkward tables included."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ["n", "f", "id", "p", "s", "shard", "pos", "part", "score", "kept", "runs", "collapsed", "w", "a", "h", "g", "n_words", "rank", "phrase", "y"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    few = [f"w{i}" for i in range(12)]
    out = []
    for i in range(60):
        words = [few[int(x)] for x in r.zipf(1.4, 120) % 12]
        text = " ".join(w + str(r.choice(["", "", "", ",", ".", "\n", "\t"])) for w in words)
        out.append((i, text.replace("w1", "W1") if i % 3 else text, str(r.choice(["en", "fr"])), "a", 1))
    loop = " ".join(["x y z"] * 40)
    out += [
        (100, None, "en", None, 0), (101, "", None, "a", 0), (102, " \t\n\r ", "en", "a", 0), (103, "one", None, "a", 3), (104, loop, "und", "a", 9), (104, loop, "und", "a", 9),
        (None, "Café é ... !! $$$ " * 30, "fr", "d", 9), (105, "a " * 5_000, "de", "a", 9), (106, "the end.\nthe end.\n\n \nthe end.", "en", "a", 9), (107, " ".join(map(str, range(30_000))), "en", "a", 9),
        (108, "| ! # $ | ! # $ | ! # $ | ! # $", "en", "a", 9), (109, "p " * 3 + "nul\x00word \x1c x\x1cy", "en", "a", 9),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.selectExpr("*", *[f"1 AS `{c}`" for c in CLASH])


@pytest.fixture(scope="module")
def stored(docs, tmp_path_factory, spark):
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(40)] + [(None, 1, 1), (41, None, 0), (3, 1, 0), (105, 0, 0)], "doc_id long, quality int, toxic int")
    for path, cut in ((full, 10**6), (empty, 0)):
        docs.limit(cut).write.parquet(f"{path}/documents.parquet")
        labels.limit(cut).write.parquet(f"{path}/labels.parquet")
    return full, empty


# ---- 11: phrases


def brute_phrases(rows, least, longest, ratio):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in range(1, longest + 1):
                for i in range(len(w) - d + 1):
                    f[lang, tuple(w[i : i + d])] += 1
    out = set()
    some = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    inside = {(lang, p[i:j]) for (lang, p), v in some.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and ratio * v >= 100 * f[lang, p[i:j]]}
    for (lang, p), a in some.items():
        if (lang, p) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.add((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return out


@pytest.mark.parametrize(("size", "least", "longest", "ratio"), [(1 << 20, 20, 5, 100), (50, 20, 5, 100), (700, 5, 4, 150), (90, 3, 2, 100)])
def test_phrases_match_brute_force(spark, rows, docs, size, least, longest, ratio, monkeypatch):
    """Shards of any size: pieces longer than a shard, phrases spread over all of them, thin ones in each; one bucket or many."""
    from panelforge.llm import collocations as c
    from panelforge.llm.collocations import collocations

    monkeypatch.setattr(c, "BUCKET", 1 << 22 if size > 1000 else 500)
    got = collocations(docs, least, longest, ratio, size).collect()
    want = brute_phrases(rows, least, longest, ratio)
    assert len(got) == len(want) > 10 and {tuple(r) for r in got} == want


def test_best_phrases_and_the_query(spark, stored, rows):
    from panelforge.llm.collocations import best, op11_collocations

    got = op11_collocations(spark, stored[0]).collect()
    want = sorted(brute_phrases(rows, 100, 5, 100), key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    assert [(r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in sorted(got, key=lambda r: (r.lang, r["rank"]))] == want and want
    assert op11_collocations(spark, stored[1]).count() == 0
    top = best(spark.createDataFrame([("x", f"p{i:04}", 5, 1, 1, 9, i // 100) for i in range(900)], "lang string, phrase string, a long, l long, r long, n long, score long"), 150).collect()
    assert [r.phrase for r in sorted(top, key=lambda r: r["rank"])] == [f"p{i:04}" for i in [*range(800, 900), *range(700, 750)]]


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from panelforge.llm.collocations import _score

    values = [(10**12, 9 * 10**15, 10**12 + 7, 10**12 + 1), (3 * 10**14, 8 * 10**15, 3 * 10**14, 10**15), (1, 10, 7, 3)]
    got = spark.createDataFrame(values, "a long, n long, l long, r long").select(_score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect()
    assert [r[0] for r in got] == [1000 * a * n // (x * y) for a, n, x, y in values]


def test_fm_index_counts_patterns():
    from panelforge.llm.collocations import FMIndex, pack, unpack

    r = np.random.default_rng(5)
    text = np.concatenate(([0], r.integers(0, 5, 400)))
    back = unpack(pack((text * 70_000, 4), (-text << 40, 8)), text.size, 4, 8)
    assert (back[0] == text * 70_000).all() and (back[1] == -text << 40).all()
    index = FMIndex(text, 3)
    patterns = np.array([[a, b, c] for a in range(1, 5) for b in range(1, 5) for c in range(1, 5)])
    low, high = index.find(patterns)
    for p, n in zip(patterns.tolist(), (high - low).tolist(), strict=True):
        assert n == sum(text[i : i + 3].tolist() == p for i in range(text.size - 2))


# ---- 12: runs


def brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in out.items())


def test_runs_match_brute_force():
    from panelforge.llm.periodic_runs import find_runs

    r = np.random.default_rng(1)
    seen = set()
    for _ in range(150):
        docs = []
        for _ in range(r.integers(1, 6)):
            w = r.integers(0, r.choice([2, 3, 50]), r.integers(0, 40)).tolist()
            for _ in range(r.integers(0, 4)):
                p = int(r.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 31, 33, 40, 64, 65, 130]))
                unit = r.integers(0, r.choice([1, 2, 3, 1000]) + 1, p).tolist()
                w += [unit[i % p] for i in range(r.integers(2 * p, 7 * p + 3))] + r.integers(0, 5, r.integers(0, 6)).tolist()
            docs.append(w)
        want, at = [], 0
        for d in docs:
            want += [(a + at, n, q) for a, n, q in brute_runs(d)]
            at += len(d) + 1
        seen |= {q for *_, q in want}
        assert find_runs(np.concatenate([np.array([*d, -1 - i], np.int64) for i, d in enumerate(docs)]), np.array([len(d) for d in docs])) == want
    assert {1, 2, 8, 9, 16, 17, 64, 65, 130} <= seen


def test_op12(spark, stored, rows):
    from panelforge.llm.periodic_runs import op12_periodic_runs

    got = op12_periodic_runs(spark, stored[0]).collect()
    assert op12_periodic_runs(spark, stored[1]).count() == 0

    def want(doc_id, text):
        w = SPACE.findall(text or "")
        n = len(w)
        if doc_id is not None and n:
            h = zlib.crc32(str(doc_id).encode())
            g = h // 10
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w) if n < 10_000 else []
        gone = {i for a, m, q in runs for i in range(a + q, a + m)}
        top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))

    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(tuple, got), key=key) == sorted((want(r[0], r[1]) for r in rows), key=key)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) and sum(r.n_runs > 0 for r in got) > 5


# ---- 13: rules


def brute_counts(text):
    text = text or ""
    w = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_op13(spark, stored, rows):
    from panelforge.llm.quality_rules import op13_quality_rules

    got = op13_quality_rules(spark, stored[0]).collect()
    key = lambda r: (r[0] is None, *(v for v in r if v is not None))
    want = [(r[0], *brute_counts(r[1])) for r in rows]
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert op13_quality_rules(spark, stored[1]).count() == 0


def test_rules_without_labels(spark, docs):
    from panelforge.llm.quality_rules import judge_rules

    none = spark.createDataFrame([], "doc_id long, quality int")
    got = judge_rules(docs, none)
    assert got.where("kept = base_failed OR score IS NOT NULL").count() == 0 and "text" not in got.columns and got.count() == docs.count()
    one = judge_rules(docs, spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int"))
    assert one.where("kept = base_failed OR score IS NULL").count() == 0


def test_rules_held_out(spark):
    from panelforge.llm.quality_rules import judge_rules

    path = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = judge_rules(table, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    good, bad = got.where("quality = 1").selectExpr("avg(CAST(kept AS INT))").first()[0], got.where("quality = 0").selectExpr("avg(CAST(kept AS INT))").first()[0]
    assert good > 0.95 and bad < 0.2


def test_forest_paths_and_threshold():
    """Path lengths by walking each tree; an outlier's is short; the threshold leaves ties together."""
    import math

    from panelforge.llm.quality_rules import Forest, mean_path, threshold

    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(500, 3)), [[9.0, 9.0, 9.0]]])
    forest = Forest(x, 40, 64)
    assert forest.score(x)[-1] == forest.score(x).max()

    def path(t, p):
        node = 0
        while forest.feature[t, node] >= 0:
            node = 2 * node + (2 if p[forest.feature[t, node]] > forest.split[t, node] else 1)
        return forest.path[t, node]

    for p in x[::100]:
        assert abs(forest.score(p[None])[0] - 2 ** (-np.mean([path(t, p) for t in range(40)]) / mean_path(64))) < 1e-12
    assert abs(mean_path(256) - (2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)) < 1e-9
    assert threshold(np.array([0.1, 0.2, 0.3, 0.3, 0.9]), np.array([True, True, True, False, False])) == pytest.approx(0.6)
    assert threshold(np.array([0.5, 0.5]), np.array([True, False])) == math.inf and threshold(np.array([0.5]), np.array([True])) == math.inf
    assert Forest(np.ones((5, 2)), 3).score(np.ones((1, 2))) > 0
