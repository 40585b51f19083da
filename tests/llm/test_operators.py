"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, size=6):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghij"), size)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, shared = words(150, 1), words(80, 2)
    out = [
        (1, base, "en", "a", 1), (2, base, "en", "b", 1), (3, base.replace(base.split()[5], "zzz"), "en", None, 1), (4, None, "en", "a", 0), (5, "", None, "a", 0),
        (6, " \t\n ", "en", "b", 0), (7, "one", "en", "c", 3), (8, words(40, 3) + " " + shared, "en", "c", 9), (9, words(30, 4) + " " + shared + " " + words(9, 5), "fr", "c", 9),
        (10, "ab " * 700, "en", "b", 9), (11, words(5000, 6), "en", "a", 9), (None, words(30, 7), "de", "a", 9), (7, "one", "en", "c", 3), (12, "Café é NOISE!! $$$", "fr", "d", 9),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---- 1: mixing


def test_water_fill(spark):
    from panelforge.llm.mixing import water_fill

    s = spark.createDataFrame([("a", 1, 10.0), ("b", 2, 1000.0), ("c", 3, 5.0), (None, 1, 500.0)], "source string, weight int, source_size double")
    got = {r.source: r.target for r in water_fill(s).collect()}
    total, caps, weights = 1515.0, {"a": 30.0, "b": 3000.0, "c": 15.0, None: 1500.0}, {"a": 1, "b": 2, "c": 3, None: 1}
    want, capped = {}, set()
    while True:
        rest = total - sum(caps[k] for k in capped)
        w = sum(weights[k] for k in weights if k not in capped)
        want = {k: caps[k] if k in capped else rest * weights[k] / w for k in caps}
        over = {k for k in caps if k not in capped and want[k] > caps[k]}
        if not over:
            break
        capped |= over
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_mix_keeps_marginals_and_totals(spark):
    from panelforge.llm.mixing import copies

    r = np.random.default_rng(0)
    units = spark.createDataFrame([(i, 1 + i % 2, float(p), int(s)) for i, (p, s) in enumerate(zip(r.uniform(0.01, 0.99, 1500), r.integers(1, 200, 1500), strict=True))], "key long, source_no int, p double, size long").cache()
    want = {x.source_no: x.w for x in units.selectExpr("source_no", "p * size AS w").groupBy("source_no").sum("w").withColumnRenamed("sum(w)", "w").collect()}
    got = copies(units, 3).collect()
    assert len(got) == 1500 and {x.take for x in got} == {0, 1}
    for s, w in want.items():
        assert abs(sum(x.take * x.size for x in got if x.source_no == s) - w) <= 200
    again = {x.key: x.take for x in copies(units, 3).collect()}
    assert all(again[x.key] == x.take for x in got)


def test_op1(spark, docs, none, tmp_path):
    from panelforge.llm.mixing import mix_documents, op1_mix_sources

    docs.withColumnRenamed("n_chars", "size").write.parquet(str(tmp_path / "documents.parquet"))
    got = op1_mix_sources(spark, str(tmp_path)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.taken % max(r["size"], 1) == 0 and 0 <= r.taken <= 3 * r["size"]
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(r["size"] for r in got)) < 1e-6
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns and mix_documents(none).count() == 0
    taken = Counter()
    for r in mix_documents(docs.select("doc_id", "text", "source")).collect():
        taken[r.doc_id] += len((r.text or "").split())
    assert taken[11] == sum(r.taken for r in got if r.doc_id == 11)


# ---- 2: quality


def test_quality_shrinks_sparse_sites(spark):
    from panelforge.llm.quality import site_posteriors

    ev = [("h1", "p1", 1.0)] * 50 + [("h1", "p2", 0.0)] + [("h2", "p1", 0.2)] * 50 + [(None, None, 0.9)] * 2
    got = {(r.host, r.path): r for r in site_posteriors(spark.createDataFrame(ev, "host string, path string, p_doc double")).collect()}
    rate = sum(e[2] for e in ev) / len(ev)
    assert all(abs(r.global_rate - rate) < 1e-9 for r in got.values())
    sparse, full = got["h1", "p2"], got["h1", "p1"]
    assert 0 < sparse.path_posterior < sparse.host_posterior and full.path_posterior > 0.9
    assert min(0.9, rate) - 1e-9 <= got[None, None].host_posterior <= 0.9 + 1e-9


def test_quality_held_out(spark, docs, none):
    from panelforge.llm.quality import judge

    path = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    fit, rest = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").select("doc_id", "quality")
    got = judge(table, fit).join(rest, "doc_id").selectExpr("avg(CASE WHEN good = (quality = 1) THEN 1.0 ELSE 0 END)", "avg(CASE WHEN quality = 1 THEN CAST(good AS INT) END)").first()
    assert got[0] > 0.95 and got[1] > 0.97
    clash = docs.selectExpr("*", "1 AS p_doc", "'x' AS host")
    out = judge(clash, labels.limit(0))
    assert out.count() == docs.count() and out.where("good").count() == docs.count() and "host" in out.columns
    assert judge(none, labels).count() == 0


# ---- 3: media


@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 9), st.integers(1, 9), st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_resize_is_the_area_mean(h, w, th, tw, seed):
    from panelforge.llm.media import area_resize, decode, encode_bmp, encode_pgm

    a = np.random.default_rng(seed).integers(0, 256, (h, w)).astype(np.uint8)
    assert (decode(encode_pgm(a)) == a).all() and (decode(encode_bmp(a)) == a).all()
    fine = np.repeat(np.repeat(a.astype(float), th, 0), tw, 1)
    assert np.allclose(area_resize(a, th, tw), fine.reshape(th, h, tw, w).mean((1, 3)))


def test_media_formats_and_nulls(spark):
    from panelforge.llm.media import encode_bmp, media_tiles

    colour = b"P6\n# c\n2 1\n255\n" + bytes([255, 0, 0, 0, 255, 0])
    items = [(1, colour), (2, b"P2\n2 2\n15\n0 15 3 7"), (3, None), (4, b""), (5, b"P5\n9 9\n255\nxx"), (6, encode_bmp(np.zeros((3, 5), np.uint8))), (7, b"P4\n3 1\n\xa0"), (7, b"P4\n3 1\n\xa0")]
    got = {r.id: r for r in media_tiles(spark.createDataFrame(items, "id int, media binary").selectExpr("*", "1 AS dhash"), "media").collect()}
    assert (got[1].height, got[1].width, got[1].channels) == (1, 2, 3) and got[2].channels == 1 and got[6].width == 5
    assert all(got[i].tile_npy is None for i in (3, 4, 5)) and len(got[1].dhash) == 16
    import io

    assert np.load(io.BytesIO(bytes(got[1].tile_npy))).shape == (24, 24, 3)


def test_op3(spark, docs, rows, tmp_path):
    from panelforge.llm.media import op3_media_tiles

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op3_media_tiles(spark, str(tmp_path)).collect()
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append((r[1] or "").encode())
    assert len(got) == len(rows)
    for r in got:
        data = texts[r.doc_id][0]
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


# ---- 4: suffix dedup


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 2, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i + 1 : i + 1 + length] = 1
        kept = bytes(b for b, c in zip(t, cover[1:], strict=False) if not c)
        out.append((int(cover.sum()), int((np.diff(cover) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [16_384, 2, 1])
def test_op4_matches_brute_force(spark, rows, docs, crowd):
    from panelforge.llm.suffix_dedup import keyed, remove_repeats

    for length in (400, 120):
        got = {(r.k1, r.k2): (r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in remove_repeats(docs.select("text"), length, crowd).collect()}
        keys = [(r.k1, r.k2) for r in keyed(docs).select("k1", "k2").collect()]
        texts = [(r[1] or "").encode() for r in rows]
        for key, want, t in zip(keys, brute_repeats(texts, length), texts, strict=True):
            assert got.get(key, (0, 0, hashlib.sha256(t).hexdigest())) == want


def test_op4(spark, rows, docs, tmp_path):
    from panelforge.llm.suffix_dedup import op4_suffix_dedup

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter((r[0], len(t), *found) for r, t, found in zip(rows, texts, brute_repeats(texts, 400), strict=True))
    got = op4_suffix_dedup(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


@given(st.lists(st.text("ab", max_size=60), min_size=2, max_size=12), st.integers(8, 12))
@settings(max_examples=40, deadline=None)
def test_segments_and_sort_find_all_windows(texts, length):
    """Without Spark: segments by gram, mergesort in each group, against all windows."""
    from panelforge.llm.suffix_dedup import repeated_starts, segments

    data = [t.encode() for t in texts]
    doc, a, n, before, gram, h = segments(data, length, 4)
    groups = defaultdict(dict)
    for i in range(len(doc)):
        groups[gram[i]].setdefault((h[i][0], h[i][1]), []).append(i)
    cover = [set() for _ in data]
    for members in groups.values():
        reps = [m[0] for m in members.values()]
        blobs = [data[doc[i]][a[i] : a[i] + n[i] - 1 + length] for i in reps]
        lo, hi = repeated_starts(blobs, before[reps], gram[reps], length)
        for m, x, y in zip(members.values(), lo, hi, strict=True):
            if len(m) > 1:
                x, y = 0, n[m[0]] - 1
            if x >= 0:
                for i in m:
                    cover[doc[i]] |= set(range(a[i] + x, a[i] + y + length))
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    for t, c in zip(data, cover, strict=True):
        want = {j for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1 for j in range(i, i + length)}
        assert c == want


def test_suffix_order_sorts():
    from panelforge.llm.suffix_dedup import _sorted_extensions

    r = np.random.default_rng(5)
    rows_ = r.integers(97, 99, (60, 12)).astype(np.uint16)
    base = np.repeat([0, 25, 26], [25, 1, 34])
    size = np.repeat([25, 1, 34], [25, 1, 34])
    order, ext = _sorted_extensions(rows_, base, size)
    for b, n in ((0, 25), (25, 1), (26, 34)):
        part = [bytes(rows_[i].astype(np.uint8)) for i in order[b : b + n]]
        assert part == sorted(part) and set(order[b : b + n]) == set(range(b, b + n))
        for i in range(1, n):
            assert ext[b + i] == next((k for k in range(12) if part[i][k] != part[i - 1][k]), 12)


def test_dedup_documents(spark, docs, none):
    from panelforge.llm.suffix_dedup import dedup_documents

    got = dedup_documents(docs, 200)
    assert got.columns == docs.columns and got.count() == docs.count() and dedup_documents(none, 200).count() == 0
    r = {x.doc_id: x for x in got.collect()}
    assert r[1].text == "" and r[1].n_chars == 0 and r[7].text == "one" and r[4].text is None and len(r[8].text) < 350


# ---- 5: toxicity


def test_toxicity_chain_held_out(spark, docs, none):
    from panelforge.llm.toxicity import toxicity

    path = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    fit, rest = labels.where("doc_id % 4 <> 1"), labels.where("doc_id % 4 = 1").select("doc_id", "toxic")
    got = toxicity(table.join(labels.select("doc_id"), "doc_id", "left_semi"), fit).join(rest, "doc_id").groupBy("toxic", "is_toxic").count().collect()
    n = {(r.toxic, r.is_toxic): r["count"] for r in got}
    assert n.get((0, True), 0) <= 0.01 * n[0, False] and n[1, True] > 0.7 * (n[1, True] + n.get((1, False), 0))
    out = toxicity(docs, labels.limit(0)).collect()
    assert len(out) == docs.count() and not any(r.is_toxic for r in out) and toxicity(none, fit).count() == 0


# ---- 6: nearest neighbours


def test_ann_recall_ties_and_bad_vectors(spark):
    from panelforge.llm.ann import nearest, usable

    r = np.random.default_rng(1)
    x = r.normal(size=(600, 16))
    x[50:90] = x[40]
    items = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (None, [1.0] * 16), (5, [float(v) for v in x[5]])]
    v = usable(spark.createDataFrame(items, "vec_id long, embedding array<double>"))
    assert v.count() == 601
    v = v.where("vec_id <> 5").unionByName(v.where("vec_id = 5").limit(1))
    got = defaultdict(list)
    for q in nearest(v, v.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
    hits = total = 0
    for q in range(0, 600, 20):
        s = (x * x[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        assert len(got[q]) == 20 and all(abs(sc - s[i]) < 1e-12 for i, sc in got[q])
        assert [i for i, _ in got[q]] == [i for i in np.lexsort((np.arange(600), -s)) if i in dict(got[q])]
        hits, total = hits + len(set(want) & set(dict(got[q]))), total + 20
    assert hits / total >= 0.9
    few = v.where("vec_id < 5")
    assert nearest(few, few.where("vec_id = 0")).count() == 4 and nearest(v.limit(0), v.limit(0)).count() == 0


def test_ann_keeps_repeated_ids_and_odd_lengths(spark):
    """Every row is searched: ids that repeat, several lengths (one of a single row, with the lowest hash), each against its own length."""
    from panelforge.llm.ann import nearest, usable

    r = np.random.default_rng(4)
    items = [(i % 90, r.normal(size=8 if i % 3 else 5).tolist()) for i in range(200)] + [(i, r.normal(size=3).tolist()) for i in (0, 7, 20)] + [(40, [1.0])]
    v = usable(spark.createDataFrame(items, "vec_id long, embedding array<double>"))
    assert v.count() == len(items)
    got = nearest(v, v.where("vec_id % 20 = 0"), 5).collect()
    want = Counter()
    hits = total = 0
    for i, (qid, q) in enumerate(items):
        if qid % 20 == 0:
            near = sorted((-float(np.dot(q, x)), vid) for j, (vid, x) in enumerate(items) if j != i and len(x) == len(q))[:5]
            want[qid] += len(near)
            found = {(x.vec_id, round(x.score, 9)) for x in got if x.query_id == qid}
            hits, total = hits + sum((vid, round(-s, 9)) in found for s, vid in near), total + len(near)
    assert Counter(x.query_id for x in got) == want and hits / total >= 0.9


def test_index_retrieves_every_code_within_the_radius():
    from panelforge.llm.ann import Index

    r = np.random.default_rng(2)
    codes = r.integers(0, 1 << 63, (400, 2), dtype=np.uint64)
    for radius in (0, 7, 30, 50, 64, 128):
        q = codes[3] ^ np.uint64(5)
        want = np.flatnonzero(np.bitwise_count(codes ^ q).sum(1) <= radius)
        assert (Index(codes).within(q, radius) == want).all()


# ---- 7: url filter


def test_url_filter(spark):
    from panelforge.llm.url_filter import judge_urls

    urls = ["http://A.Example.NET/en/x?q", "https://example.net/de/", "http://x.example.com/de/1#t", "ftp://org/fr/", "http://net", "nourl", None, "http://foo.org/fr/", "http://bad.io/p", "http://bad.io/q", "http://notnet/en/", "://", "http://bad.io/p?x"]
    listed = spark.createDataFrame([("prefix", "net", "/", "block"), ("prefix", "example.net", "/en/", "allow"), ("prefix", "example.com", "/de/", "block"), ("prefix", "org", "/fr/", "allow"), ("page", "bad.io", "/p", "block"), ("page", None, "/", "block")], "kind string, host string, path string, verdict string")
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] + [(0, urls[0], "old")], "page_id int, url string, rule string")
    for blocks in (1, 1 << 15):  # one full block: every probe is a possible hit, the join decides
        got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, "url", listed, blocks=blocks).orderBy("page_id").collect()]
        assert got[0] == got[1] == (0, "a.example.net", "/en/x", "example.net/en/", "allow")
        by = {g[0]: g[3:] for g in got}
        assert by[1] == ("net/", "block") and by[2] == ("example.com/de/", "block") and by[3] == ("org/fr/", "allow") and by[4] == (None, "allow")
        assert by[5] == by[6] == by[10] == by[11] == (None, "allow") and by[8] == by[12] == (None, "block") and by[9] == (None, "allow")
    assert judge_urls(df, "url", listed.limit(0)).where("verdict = 'allow'").count() == len(urls) + 1 and judge_urls(df.limit(0), "url", listed).count() == 0


# ---- 8: packing


@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 9)), min_size=1, max_size=7, unique_by=lambda x: x[0]), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_bounds_are_optimal(hist, k):
    from panelforge.llm.packing import best_bounds

    hist.sort()
    lengths, counts = [h[0] for h in hist], [h[1] for h in hist]
    cost = lambda b: sum(c * (min(x for x in b if x >= n) - n) for n, c in hist)
    best = min(cost([*c, lengths[-1]]) for m in range(min(k, len(hist))) for c in combinations(lengths[:-1], m))
    got = best_bounds(np.array(lengths), np.array(counts), k)
    assert cost(got) == best and len(got) <= k


def test_pack(docs, none, rows):
    from panelforge.llm.packing import pack

    got = pack(docs, longest=512, buckets=4, budget=2048).collect()
    tokens = Counter()
    batches = defaultdict(list)
    for r in got:
        tokens[r.doc_id] += r.length
        batches[r.batch].append(r)
        assert 0 < r.length <= r.bucket <= 512 and r.start == r.piece * 512
    want = Counter()
    for r in rows:
        want[r[0]] += len((r[1] or "").split()) + 1
    assert tokens == want and pack(none).count() == 0
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1 and len(b) * b[0].bucket <= 2048 and sorted(r.place for r in b) == list(range(len(b)))


# ---- 9: simhash


def brute_components(fps, distance):
    comp = list(range(len(fps)))
    for _ in fps:
        for i, x in enumerate(fps):
            for j in range(i):
                if bin(x ^ fps[j]).count("1") <= distance:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return comp


@pytest.mark.parametrize("hot", [20_000, 2])
def test_near_duplicates_match_brute_force(spark, docs, rows, none, hot):
    import xxhash

    from panelforge.llm.simhash import fingerprint, near_duplicates

    def slow(t):
        w = t.encode().lower().split()
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for r in rows:
        assert fingerprint((r[1] or "").encode(), 4) == [slow(r[1] or "")]
    r = np.random.default_rng(3)
    extra = [(100 + i, words(60, 9).replace(words(60, 9).split()[r.integers(60)], "q" * int(r.integers(1, 4)))) for i in range(40)]
    every = [(x[0], x[1]) for x in rows] + extra
    got = near_duplicates(spark.createDataFrame(every, "doc_id long, text string"), hot=hot)
    fps = [slow(t or "") for _, t in every]
    comp = brute_components(fps, 4)
    least = {}
    for c, (i, _) in zip(comp, every, strict=True):
        least[c] = min(x for x in (least.get(c), i) if x is not None) if i is not None or c in least else None
    want = Counter((i, f - (1 << 64) if f >> 63 else f, least[c]) for (i, _), f, c in zip(every, fps, comp, strict=True))
    assert Counter((x.doc_id, x.fp, x.component_id) for x in got.collect()) == want
    assert near_duplicates(none).count() == 0


def test_keep_one(docs, none):
    from panelforge.llm.simhash import keep_one

    got = keep_one(docs)
    ids = sorted((r.doc_id or 0) for r in got.collect())
    assert got.columns == docs.columns and 1 in ids and 2 not in ids and 3 not in ids and ids.count(7) == 1 and len({4, 5, 6} & set(ids)) == 1 and {8, 9, 10, 11, 12} <= set(ids)
    assert keep_one(none).count() == 0


def edited(text, times, r):
    w = text.split()
    for i in r.integers(len(w), size=times):
        w[i] = "edit%d" % r.integers(10**9)
    return " ".join(w)


def jaccard_components(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts]
    comp = list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        if comp[i] != comp[j] and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
            comp = [comp[i] if c == comp[j] else c for c in comp]
    return comp


def test_keep_one_finds_every_pair_of_similarity_four_fifths(spark):
    from panelforge.llm.simhash import keep_one

    r = np.random.default_rng(8)
    texts = []
    for k in range(60):  # pairs near the bound: some 0.7 to 0.9
        base = words(200, 100 + k)
        texts += [base, edited(base, int(r.integers(2, 7)), r)]
    base = words(150, 99)  # a crowded group, of several components
    texts += [edited(base, int(r.integers(1, 9)), r) for _ in range(80)] + ["a b", "A  b", "a b c", "", "  "]
    comp = jaccard_components(texts)
    got = keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {x.doc_id for x in got.collect()} == {comp.index(c) for c in comp}
    assert 70 < len(set(comp)) < 200


@pytest.mark.parametrize("n", [30, 120, 700])
def test_multi_index_hashing_meets_pairs_of_similarity_four_fifths(n):
    """At the bound itself: the sets share 8/9 of their shingles."""
    from panelforge.llm.near_sets import set_fingerprint, sizes_for

    bits, segments, words, distance = sizes_for(10**6)
    r, met = np.random.default_rng(5), 0
    for _ in range(400):
        own = r.integers(-(2**63), 2**63 - 1, n + n // 9)
        x, y = (set_fingerprint(np.sort(s), words) for s in (own[:n], own[n // 9 :]))
        parts = np.bitwise_count((x ^ y).view(np.uint16)) if bits == 16 else None
        met += bool((parts[:segments] <= 2).any() and np.bitwise_count(x ^ y).sum() <= distance)
    assert met >= 394


def test_probes_meet_within_two_bits(spark):
    from panelforge.llm.near_sets import probes

    r = np.random.default_rng(7)
    for bits, segments, words in ((16, 8, 2), (20, 7, 3)):
        a = r.integers(-(2**63), 2**63 - 1, words)
        b = a ^ r.integers(-(2**63), 2**63 - 1, words)
        s = segments - 1  # the last segment of b is brought within two bits of a's
        w, at = s // (64 // bits), bits * (s % (64 // bits))
        mask = np.int64(-1 if bits == 64 else ((1 << bits) - 1 << at) - (1 << 64 if (1 << bits) - 1 << at >> 63 else 0))
        b[w] = (b[w] & ~mask) | ((a[w] ^ np.int64(5 << at)) & mask)
        rows = spark.createDataFrame([tuple(map(int, x)) for x in (a, b)], ", ".join(f"f{j} long" for j in range(words)))
        keys = [{k.key for k in probes(rows.where(rows.f0 == int(x[0])), bits, segments, words).collect()} for x in (a, b)]
        assert len(keys[0]) == segments * (bits + 1) and any(k >> bits == s for k in keys[0] & keys[1])


def test_crowded_entries_and_groups_are_cut_into_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from panelforge.llm import near_sets, simhash

    sets = spark.createDataFrame([(i, [int(x) for x in range(i, i + 10)]) for i in range(400)], "node long, v array<long>")
    cells = defaultdict(set)
    own = spark.range(400).select(F.lit(7).alias("key"), F.col("id").alias("node"), F.lit(10).alias("n"))
    for x in near_sets.in_cells(own.withColumn("away", F.lit(True)), sets, 500).collect():
        cells[x.cell].add(x.node)
    assert max(map(len, cells.values())) < 160 and len({p for c in cells.values() for p in combinations(sorted(c), 2)}) == 400 * 399 // 2
    # a family costs a pass: few are away, so each of the others is sent once; with none away nothing is
    few = near_sets.in_cells(own.withColumn("away", F.col("node") < 3), sets, 500).collect()
    pairs = {p for c in {x.cell for x in few} for p in combinations(sorted(x.node for x in few if x.cell == c), 2)}
    assert len(few) == 400 + 3 * 7 and {(i, j) for i in range(3) for j in range(i + 1, 400)} <= pairs
    assert near_sets.in_cells(own.withColumn("away", F.lit(False)), sets, 500).count() == 0
    monkeypatch.setattr(near_sets, "BLOCK", 500)
    monkeypatch.setattr(near_sets, "ENTRY", 16)
    r = np.random.default_rng(6)
    base = words(150, 98)
    texts = [edited(base, int(r.integers(1, 9)), r) for _ in range(120)]
    comp = jaccard_components(texts)
    got = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {x.doc_id for x in got.collect()} == {comp.index(c) for c in comp}


def test_a_crowded_entry_of_two_families_and_strangers(spark):
    """Entries far beyond the limit give the same components as all pairs."""
    from panelforge.llm import near_sets
    from panelforge.llm.graph import connected_components

    r = np.random.default_rng(8)
    low = r.integers(0, 1 << 16)
    centres = r.integers(0, 1 << 48, (2, 2)).astype(np.uint64) << np.uint64(16)
    rows = []
    for i in range(240):
        fp = centres[i % 2].copy() if i < 200 else r.integers(0, 1 << 48, 2).astype(np.uint64) << np.uint64(16)
        for bit in r.integers(16, 128, 5):
            fp[bit // 64] ^= np.uint64(1) << np.uint64(max(16, bit % 64))
        fp[0] |= np.uint64(low)
        rows.append(fp)
    fps = np.unique(np.array(rows), axis=0)
    distance = 12
    df = spark.createDataFrame([tuple(map(int, x)) for x in fps.view(np.int64)], "f0 long, f1 long")
    number = near_sets._candidate(fps).tolist()
    found = connected_components(near_sets.candidate_edges(df, (16, 8, 2, distance), 16)).collect()
    comp = {x.node: x.comp for x in found}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if np.bitwise_count(fps[i] ^ fps[j]).sum() <= distance:
            parent[root(j)] = root(i)
    got, want = defaultdict(set), defaultdict(set)
    for i, c in enumerate(number):
        got[comp.get(c, c)].add(i)
        want[root(i)].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) > 20


def test_sets_that_share_a_hash_are_hashed_anew(spark, monkeypatch):
    from panelforge.llm import near_sets, simhash

    real = near_sets._node
    texts = [words(40, s) for s in range(6)]

    def clashing(own, salt=0):
        return 5 if salt == 0 else real(own, salt)

    monkeypatch.setattr(near_sets, "_node", clashing)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.node for x in near_sets.with_fingerprints(docs, 5, 42, 2).collect()} == {5}
    assert simhash.keep_one(docs).count() == 6


def test_keep_one_tells_rows_apart_by_doc_id_too(spark, monkeypatch):
    from pyspark.sql import functions as F

    from panelforge.llm import simhash

    monkeypatch.setattr(simhash, "row_hash", lambda df: F.lit(1).cast("long"))
    texts = [words(40, s) for s in range(5)] + [words(40, 0)]
    got = simhash.keep_one(spark.createDataFrame([(None if i == 4 else i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert sorted(x.doc_id for x in got.collect() if x.doc_id is not None) == [0, 1, 2, 3] and got.count() == 5


# ---- 10: n-gram trie


@given(st.lists(st.integers(0, 2**40), max_size=200), st.integers(0, 60))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, spread):
    from panelforge.llm.elias_fano import EliasFano

    v = np.sort(np.array([x >> spread for x in values], np.uint64))
    e = EliasFano.build(v, int(v[-1]) + 1 if v.size else 10)
    assert (e.access(np.arange(v.size)) == v).all()
    assert (e.values() == v).all() and (EliasFano.from_bytes(e.to_bytes())[0].values() == v).all()
    probe = np.concatenate((v, v + np.uint64(1), np.array([0, 2**50], np.uint64)))
    got = e.find(probe)
    assert all((v[g] == p) if g >= 0 else p not in v for p, g in zip(probe, got, strict=True))


@pytest.mark.parametrize(("least", "shard"), [(2, 1 << 20), (1, 1 << 20), (1, 5)])
def test_trie_matches_the_formula_and_sums_to_one(spark, none, least, shard):
    """With tiny shards the successors of most contexts lie in several of them."""
    from panelforge.llm.ngram_trie import DISCOUNT, held_out, score, train

    r = np.random.default_rng(4)
    vocab = ["w%d" % i for i in range(12)]
    texts = [(i, " ".join(r.choice(vocab, int(r.integers(0, 30)))) if i else None) for i in range(60)] + [(None, "W1 w2\tw3"), (3, "unseen words")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    model = train(df, least=least, shard=shard)
    assert shard > 5 or (model.pairs.split.size > 1 and model.pairs.cuts.context.size > 20)
    tok = [(t or "").lower().split() + [None] for _, t in texts]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for (i, _), t in zip(texts, tok, strict=True):
        if not held_out(i):
            w = [None, *t]
            c1.update(t)
            c2.update(zip(w, w[1:], strict=False))
            c3.update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(c1.values()), len(c1)
    k2, k3 = {k: x for k, x in c2.items() if x >= least}, {k: x for k, x in c3.items() if x >= least}

    def p(a, b, w):
        out = (c1[w] + 1) / (n + v + 1)
        if c1[b]:
            kept = sum(x - DISCOUNT for k, x in k2.items() if k[0] == b)
            out = (k2[b, w] - DISCOUNT if (b, w) in k2 else 0) / c1[b] + (1 - kept / c1[b]) * out
        if a != "start" and (a, b) in k2:
            kept = sum(x - DISCOUNT for k, x in k3.items() if k[:2] == (a, b))
            out = (k3[a, b, w] - DISCOUNT if (a, b, w) in k3 else 0) / c2[a, b] + (1 - kept / c2[a, b]) * out
        return out

    assert abs(sum(p("w1", "w2", w) for w in [*c1, "never"]) - 1) < 1e-9
    got = score(df, model).collect()
    assert len(got) == len(texts) and score(none, model).count() == 0
    for g, (i, _), t in zip(sorted(got, key=lambda g: (g.doc_id is None, g.doc_id, g.n_tokens)), *zip(*sorted(zip(texts, tok, strict=True), key=lambda x: (x[0][0] is None, x[0][0], len(x[1])))), strict=True):
        w = ["start", None, *t]
        want = sum(math.log10(p(*w[j - 2 : j + 1])) for j in range(2, len(w)))
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (i, held_out(i), len(t), sum(c1[x] > 0 for x in t), n)
        assert abs(g.base_score - sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in t)) < 1e-9 and abs(g.score - want) < 2e-3 * len(t)
    assert score(df, train(none)).where("score = 0").count() == len(texts)


# ---- all queries on awkward tables


@pytest.fixture(scope="module")
def awkward(spark, rows, tmp_path_factory):
    """Nulls, empty texts, repeated rows, and extra columns whose names the operators use themselves; and the same without rows."""
    from pyspark.sql import functions as F

    full, empty = (tmp_path_factory.mktemp(n) for n in ("full", "empty"))
    clash = [F.lit(1).alias(c) for c in ("n", "key", "f0", "node", "size", "target", "copies", "k1", "k2", "comp", "p_doc", "host", "path", "bucket", "media", "rank", "verdict", "hash", "class")]
    vectors = [(i, [float(i % 7), 1.0, float(-i)], 1) for i in range(30)] + [(31, None, 1), (None, [1.0, 2.0, 3.0], 0), (20, [6.0, 1.0, -20.0], 1), (33, [0.0, 0.0, 0.0], 0), (34, [1.0], 0)]
    tables = {
        "documents": spark.createDataFrame(rows, DOCS),
        "labels": spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 1), (None, 1, 1), (4, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int"),
        "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"),
        "pages": spark.createDataFrame([(1, "http://a.net/x", "<p>"), (2, None, None), (None, "http://b.org/fr/", ""), (1, "http://a.net/x", "<p>"), (5, "no url", "x")], "page_id long, url string, html string"),
    }
    for name, df in tables.items():
        wide = df.select("*", *[c for c in clash if c._jc.toString().split(" AS ")[-1] not in df.columns])
        wide.write.parquet(f"{full}/{name}.parquet")
        wide.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return str(full), str(empty)


@pytest.mark.parametrize("name", ["op1_mix_sources", "op2_quality", "op3_media_tiles", "op4_suffix_dedup", "op5_toxicity", "op6_ann", "op7_url_filter", "op8_packing", "op9_simhash", "op10_ngram_trie"])
def test_queries_on_awkward_tables(spark, awkward, rows, name):
    from panelforge.llm.registry import queries

    full, empty = (queries()[name](spark, path) for path in awkward)
    got = full.collect()
    assert empty.columns == full.columns and empty.count() == 0
    if name == "op7_url_filter":
        assert Counter(r.page_id for r in got) == {1: 2, 2: 1, None: 1, 5: 1}
    elif name == "op6_ann":
        assert Counter(r.query_id for r in got) == {0: 20, 20: 40} and all(r.vec_id not in (None, 31, 33, 34) and (r.vec_id != r.query_id or r.vec_id == 20) for r in got)
    elif name != "op8_packing":
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)


def test_long_texts_are_cut_into_pieces_that_overlap(monkeypatch):
    """Segments of a text in pieces cover the same starts, with the same grams, as those of the whole."""
    import pyarrow as pa

    from panelforge.llm import suffix_dedup

    r = np.random.default_rng(11)
    text = r.integers(97, 110, 30_000).astype(np.uint8).tobytes().decode()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], names=["k1", "k2", "text"])

    def covered():
        out = {}
        for b in suffix_dedup._segment_rows(400, 64)([batch]):
            for g, starts, n, before in zip(b.column(0).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist(), b.column(7).to_pylist(), strict=True):
                for a in starts:
                    for i in range(n):
                        assert out.setdefault(a + i, (g, a + before)) == (g, a + before)
        return out

    whole = covered()
    monkeypatch.setattr(suffix_dedup, "PIECE", 4_096)
    monkeypatch.setattr(suffix_dedup, "utf8_chunks", lambda texts: [(0, [t]) for t in texts])
    assert covered() == whole and len(whole) == 30_000 - 399


def test_posteriors_by_hand(spark):
    """Spread of sites less their sampling noise; a document doesn't count in its own sites."""
    from panelforge.llm.quality import judge_evidence, site_posteriors

    r = np.random.default_rng(12)
    rows_ = [(h, p, float(np.clip(r.normal(0.3 + 0.1 * h + 0.05 * p, 0.1), 0.01, 0.99))) for h in range(5) for p in range(3) for _ in range(int(r.integers(1, 9)))]
    got = {(x.host, x.path): x for x in site_posteriors(spark.createDataFrame(rows_, "host int, path int, p_doc double")).collect()}
    p = np.array([x[2] for x in rows_])
    rate, total = p.mean(), len(p)
    by = lambda f: {k: np.array([x[2] for x in rows_ if f(x) == k]) for k in {f(x) for x in rows_}}
    paths, hosts = by(lambda x: x[:2]), by(lambda x: x[0])
    within = sum(((v - v.mean()) ** 2).sum() for v in paths.values()) / (total - len(paths))
    spread = max(0, (sum(v.size * (v.mean() - rate) ** 2 for v in hosts.values()) - (len(hosts) - 1) * within) / (total - sum(v.size**2 for v in hosts.values()) / total))
    strength = lambda m, s: np.clip(m * (1 - m) / s - 1, 2, 1000) if s > 0 else 1000.0
    prior = strength(rate, spread)
    in_host = {k: (v.sum() + prior * rate) / (v.size + prior) for k, v in hosts.items()}
    q = sum(v.size * (v.mean() - hosts[k[0]].mean()) ** 2 for k, v in paths.items()) - (len(paths) - len(hosts)) * within
    spread = max(0, q / (total - sum(v.size**2 / hosts[k[0]].size for k, v in paths.items())))
    for k, v in paths.items():
        own = strength(in_host[k[0]], spread)
        assert got[k].host_posterior == pytest.approx(in_host[k[0]]) and got[k].path_posterior == pytest.approx((v.sum() + own * in_host[k[0]]) / (v.size + own))
    alone = judge_evidence(spark.createDataFrame([("h", "p", 0.9)], "host string, path string, p_doc double"), "host", "path").first()
    assert alone.p_good == pytest.approx(0.9)


def test_the_chain_sees_earlier_categories():
    """The last category holds where either of the earlier ones does, in texts that share no word with each other."""
    from panelforge.llm.labelled import folds_of
    from panelforge.llm.toxicity import Chain, word_sets

    r = np.random.default_rng(13)
    y, texts = np.zeros((600, 3)), []
    for i in range(600):
        w = ["plain%s" % chr(97 + k) for k in r.integers(0, 20, 12)]
        if i % 6 == 0:
            w.append("vile")
            y[i, [0, 2]] = 1
        elif i % 6 == 1:
            w.append("foul")
            y[i, [1, 2]] = 1
        texts.append(" ".join(w).encode())
    text, hashes = word_sets(texts)
    chain = Chain.fit(text, hashes, y, folds_of(np.arange(600), 3))
    p = chain.predict([b"a vile thing", b"a foul thing", b"a plain thing", b""])
    assert (p[:2, 2] > 0.5).all() and (p[2:, 2] < 0.5).all() and p[0, 0] > 0.5 > p[1, 0] and p[1, 1] > 0.5 > p[0, 1]
    words, weights = chain.models[2]
    assert weights.size == words.size + 2 + 1 and (weights[words.size : words.size + 2] > 0).any()


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
    assert seen[1] <= seen[0] and seen[2] <= seen[1] and seen[3] == seen[2] and len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, path).count() == seen[-1]


def test_the_query_stores_ngrams_seen_once(spark, tmp_path):
    from panelforge.llm.ngram_trie import DISCOUNT, held_out, op10_ngram_trie

    i = next(k for k in range(99) if not held_out(k))
    spark.createDataFrame([(i, "a b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op10_ngram_trie(spark, str(tmp_path)).first()
    p = 2 / (4 + 4 + 1)  # four tokens, each seen once
    two = (1 - DISCOUNT) + DISCOUNT * p
    three = (1 - DISCOUNT) + DISCOUNT * two
    assert abs(got.score - (math.log10(two) + 3 * math.log10(three))) < 0.01


def test_levels_are_closed_again(tmp_path, monkeypatch):
    """More shards than a process may keep open: the oldest mappings are closed, and read again when asked for."""
    import os

    from panelforge.llm import ngram_trie

    monkeypatch.setattr(ngram_trie, "MAPPED", 5)
    ngram_trie._OPEN.clear()
    paths = [f"file:{tmp_path}/level-{i}.level" for i in range(40)]
    for i, p in enumerate(paths):
        ngram_trie.write_level(p, {"x": np.arange(i + 1)})
    before = len(os.listdir("/proc/self/fd"))
    for _ in range(2):
        for i, p in enumerate(paths):
            assert ngram_trie.open_level(p)["x"].tolist() == list(range(i + 1))
    assert len(ngram_trie._OPEN) == 5 and len(os.listdir("/proc/self/fd")) <= before + 6
    ngram_trie._OPEN.clear()


def test_paths_without_a_scheme_are_spark_s(spark):
    from panelforge.llm.ngram_trie import _qualified

    assert _qualified(spark, "/x/y") == "file:/x/y" and _qualified(spark, "file:/x") == "file:/x"
