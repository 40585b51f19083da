"""Removal of long repeated byte strings by a distributed, hash-compared suffix sort.

Every window of `length` bytes has an anchor: the gram of GRAM bytes in it whose hash is least (leftmost on
ties), which hangs on the window's bytes alone. So equal windows have equal anchors at equal offsets, and the
windows of a text fall into runs ("segments") that share one anchor occurrence: about one per 170 bytes. Only
segments whose anchor gram occurs again can hold a repeat. Equal segments collapse into one. Where segments of
one gram differ, the suffixes that start at the anchors are sorted (and, mirrored, what precedes them): a
mergesort whose comparisons find the common extension by binary search over prefix polynomial hashes. The
common extensions of neighbours in the two orders tell which windows are equal; they are verified byte by byte.
No group is gathered beyond CROWD segments. Those of a gram that many segments share are split by the bytes around
the anchor: two equal windows agree in r bytes from the anchor on and in l before it, for one of PARTS + 1 pairs
(r, l) that leave at most length / PARTS bytes open, so each segment joins one finer group for each pair and meets
every partner in one. What still crowds there shares all but a few bytes of its windows, which are then counted
one by one: suffixes that are equal to the last byte need no sorting.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import checkpoint, mix64, stage, utf8_chunks

LENGTH = 400
GRAM = 64
CROWD = 16_384
#: Pairs of lengths around the anchor by which crowded grams are split.
PARTS = 16
#: Crowded grams (a long each) that may be broadcast.
SMALL = 100_000
#: Texts (16 bytes each) whose keys may be broadcast, so that only they are shuffled; beyond that all are.
SMALL_TEXTS = 1 << 20
#: Items sorted together in one task; groups are never split over sorts.
TOGETHER = 8_192
#: Longest piece of a text that is hashed at once (positions must fit 24 bits).
PIECE = 1 << 22

_rng = np.random.default_rng(20240229)
_BYTE = np.concatenate([_rng.integers(1, 1 << 63, 257, dtype=np.uint64) | np.uint64(1)])
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (kept between calls, grown when needed)."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 21)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.ones(size, np.uint64)
            p[1:] = np.uint64(base)
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from block-wise running minima in both directions."""
    n = x.size
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Segments of some texts: arrays text number, first start, number of starts, bytes before the anchor, gram hash, and digests (n, 2) of the segment's bytes."""
    data = b"".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    empty = np.empty(0, np.int64)
    if len(data) < length or sizes.max(initial=0) < length:
        return empty, empty, empty, empty, empty, np.empty((0, 2), np.int64)
    buf = np.frombuffer(data, np.uint8)
    up, down = _powers(buf.size + 1)
    sums = np.zeros(buf.size + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:-1], out=sums[1:])
    g = mix64((sums[gram:] - sums[:-gram]) * down[: buf.size - gram + 1])
    at = np.uint64((1 << 24) - 1)
    key = (g & ~at) | np.arange(g.size, dtype=np.uint64)
    where = (_sliding_min(key, length - gram + 1) & at).astype(np.int64)
    long_ = np.flatnonzero(sizes >= length)
    n = sizes[long_] - length + 1
    text = np.repeat(long_, n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat((ends - sizes)[long_], n)
    anchor = where[start]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    count = np.diff(np.concatenate((first, [start.size])))
    a, p, doc = start[first], anchor[first], text[first]
    ends_ = (a + count - 1 + length).tolist()
    digest = b"".join([hashlib.blake2b(data[x:y], digest_size=16).digest() for x, y in zip(a.tolist(), ends_, strict=True)])
    return doc, a - (ends - sizes)[doc], count, p - a, g[p].view(np.int64), np.frombuffer(digest, np.int64).reshape(-1, 2)


def _segment_rows(length: int, gram: int):
    """Arrow function over (k1, k2, text): one row per text and distinct segment, with the list of its starts."""
    names = ["gram", "h1", "h2", "k1", "k2", "a", "n", "before"]

    def run(batches):
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts = b.column(2).cast(pa.binary()).to_pylist()
            for first, chunk in utf8_chunks(texts):
                if len(chunk) == 1 and len(chunk[0]) > PIECE:  # a very long text, in pieces that share length - 1 bytes
                    whole = chunk[0]
                    parts = [(at, [whole[at : at + PIECE + length - 1]]) for at in range(0, len(whole), PIECE)]
                else:
                    parts = [(0, chunk)]
                for offset, part in parts:
                    doc, a, n, before, g, h = segments(part, length, gram)
                    if not doc.size:
                        continue
                    order = np.lexsort((a, h[:, 1], h[:, 0], g, doc))
                    doc, a, g, h = doc[order], a[order] + offset, g[order], h[order]
                    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (g[1:] != g[:-1]) | (h[1:] != h[:-1]).any(axis=1))))
                    starts = pa.ListArray.from_arrays(pa.array(np.append(new, doc.size).astype(np.int32)), pa.array(a.astype(np.int32)))
                    doc = doc[new] + first
                    cols = [g[new], np.ascontiguousarray(h[new, 0]), np.ascontiguousarray(h[new, 1]), k1[doc], k2[doc], starts, n[order][new].astype(np.int32), before[order][new].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)

    return run


def _common(hp: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common extension of rows x and y: binary search over their prefix hashes."""
    low, high = np.zeros(x.size, np.int64), np.full(x.size, hp.shape[1], np.int64)
    for _ in range(int(hp.shape[1]).bit_length()):
        mid = (low + high + 1) >> 1
        same = (mid == 0) | (hp[x, np.maximum(mid, 1) - 1] == hp[y, np.maximum(mid, 1) - 1])
        low = np.where(same, mid, low)
        high = np.where(same, high, mid - 1)
    return low


def suffix_order(rows: np.ndarray, hp: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of the rows inside each group (adjacent rows; base: first row, size: rows of a row's group) by
    mergesort; a comparison takes log2(columns) hash tests, whatever the common extension's length."""
    order, place, width = np.arange(rows.shape[0]), np.arange(rows.shape[0]) - base, 1
    columns = rows.shape[1]
    while width < size.max(initial=1):
        run = place // width
        low = (run ^ 1) * width
        high = np.minimum(low + width, size)
        p = np.flatnonzero(low < size)  # with a sibling run to merge with
        lo, hi, b, right = low[p].copy(), high[p].copy(), base[p], (run[p] & 1).astype(bool)
        x = order[p]
        live = np.arange(p.size)
        while live.size:
            mid = (lo[live] + hi[live]) >> 1
            y, xs = order[b[live] + mid], x[live]
            ext = _common(hp, xs, y)
            at = np.minimum(ext, columns - 1)
            cx, cy = rows[xs, at], rows[y, at]
            before = np.where(ext == columns, right[live], cy < cx)  # sibling's element goes first
            lo[live] = np.where(before, mid + 1, lo[live])
            hi[live] = np.where(before, hi[live], mid)
            live = live[lo[live] < hi[live]]
        moved = order.copy()
        moved[b + (run[p] >> 1) * 2 * width + place[p] - run[p] * width + lo - low[p]] = x
        order, width = moved, width * 2
    return order


def _sorted_extensions(rows: np.ndarray, base: np.ndarray, size: np.ndarray):
    """(order, common extension of each with its predecessor; -1 at a group's start), verified byte by byte."""
    up, _ = _powers(rows.shape[1])
    hp = np.cumsum(_BYTE[rows] * up[None, :], axis=1, dtype=np.uint64)
    order = suffix_order(rows, hp, base, size)
    ext = np.full(rows.shape[0], -1, np.int64)
    again = np.flatnonzero(np.arange(rows.shape[0]) != base)
    ext[again] = _common(hp, order[again], order[again - 1])
    for at in range(0, again.size, 4096):
        i = again[at : at + 4096]
        differ = rows[order[i]] != rows[order[i - 1]]
        if (differ & (np.arange(rows.shape[1]) < ext[i][:, None])).any():  # a hash collision: order by the bytes
            group = base.copy()
            order = np.lexsort([*rows.T[::-1], group])
            same = rows[order[again]] == rows[order[again - 1]]
            ext[again] = np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1))
            break
    return order, ext


def repeated_starts(blobs: list[bytes], before: np.ndarray, group: np.ndarray, length: int = LENGTH):
    """First and last start (offset in the segment; -1 if none) of windows equal to one of another segment of the group.

    Segments of a group are adjacent and differ; all share the gram at their anchor (`before` bytes from the start).
    """
    n = len(blobs)
    sizes = np.fromiter(map(len, blobs), np.int64, n)
    buf = np.frombuffer(b"".join(blobs) + b"\0", np.uint8)
    begin = np.cumsum(sizes) - sizes
    reach = int(before.max(initial=0))
    new = np.concatenate(([True], group[1:] != group[:-1]))
    base = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = np.diff(np.concatenate((np.flatnonzero(new), [n])))[np.cumsum(new) - 1]

    def gather(step: int, columns: int, room: np.ndarray) -> np.ndarray:
        j = np.arange(columns)
        at = (begin + before)[:, None] + (j if step > 0 else -1 - j)[None, :]
        inside = j[None, :] < room[:, None]
        return np.where(inside, buf[np.where(inside, at, 0)], np.uint16(256)).astype(np.uint16)

    ahead = sizes - before
    r_order, r_ext = _sorted_extensions(gather(1, length, ahead), base, size)
    l_order, l_ext = _sorted_extensions(gather(-1, max(reach, 1), before), base, size)
    lo, hi = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    for u in range(reach, -1, -1):  # windows that start u bytes before the anchor
        fits = np.flatnonzero((before >= u) & (ahead >= length - u))
        if fits.size < 2:
            continue
        left[l_order] = np.cumsum(l_ext < u)
        right[r_order] = np.cumsum(r_ext < length - u)
        key = left[fits] * (n + 1) + right[fits]
        o = np.argsort(key, kind="stable")
        same = key[o[1:]] == key[o[:-1]]
        hit = np.zeros(fits.size, bool)
        hit[o[1:][same]] = True
        hit[o[:-1][same]] = True
        at = fits[hit]
        hi[at] = before[at] - u
        lo[at] = np.where(lo[at] < 0, before[at] - u, lo[at])
    return lo, hi


def _resolve(length: int):
    """Arrow function over rows (gram, k1, k2, a, before, data) sorted by gram: (k1, k2, s, e), the bytes that repeat."""

    def solve(gram, k1, k2, a, before, data):
        cut = np.concatenate(([0], np.flatnonzero(np.diff(gram)) + 1, [gram.size]))
        at = 0
        while at < cut.size - 1:
            to = max(at + 1, int(np.searchsorted(cut, cut[at] + TOGETHER, "right")) - 1)
            x, y = cut[at], cut[to]
            lo, hi = repeated_starts(data[x:y], before[x:y], gram[x:y], length)
            f = np.flatnonzero(lo >= 0)
            if f.size:
                start = a[x:y][f]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (k1[x:y][f], k2[x:y][f], (start + lo[f]).astype(np.int32), (start + hi[f] + length).astype(np.int32))], names=["k1", "k2", "s", "e"])
            at = to

    def run(batches):
        held = None
        for b in batches:
            now = [b.column(i).to_numpy() for i in range(5)] + [b.column(5).to_pylist()]
            if held is not None:
                now = [np.concatenate((p, q)) for p, q in zip(held[:5], now[:5], strict=True)] + [held[5] + now[5]]
            gram = now[0]
            last = int(np.searchsorted(gram, gram[-1])) if gram.size else 0
            if last:
                yield from solve(*[c[:last] for c in now])
            held = [c[last:] for c in now]
        if held is not None and held[0].size:
            yield from solve(*held)

    return run


def _rows_of(make, kinds: dict[str, pa.DataType]):
    """Arrow function over (k1, k2, text, wanted: list of gram, a, n, before): make(data, w) gives the rows of a segment, less k1 and k2."""
    names = [*kinds, "k1", "k2"]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate([*kinds.values(), pa.int64(), pa.int64()])], names=names)

    def run(batches):
        for b in batches:
            out = []
            for k1, k2, t, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), b.column(3), strict=True):
                data = t.as_py()
                for w in wanted.as_py():
                    out += [(*row, k1, k2) for row in make(data, w)]
                    if len(out) > 20_000:
                        yield batch(out)
                        out = []
            if out:
                yield batch(out)

    return run


def _segment(length: int):
    """The bytes of a segment."""
    return lambda data, w: [(w["gram"], w["a"], w["before"], data[w["a"] : w["a"] + w["n"] - 1 + length])]


def _windows(length: int):
    """A row per window of a segment, with its digest."""
    return lambda data, w: [(w["gram"], i, hashlib.blake2b(data[i : i + length], digest_size=16).digest()) for i in range(w["a"], w["a"] + w["n"])]


def _parts(length: int, gram: int):
    """The finer groups that a segment joins: a hash of the bytes around its anchor for each pair of lengths that it has."""
    right = sorted({*np.linspace(gram, length, PARTS + 1).astype(int).tolist()})
    around = [(r, length + 1 - after) for r, after in zip(right, right[1:], strict=False)] + [(length, 0)]

    def make(data, w):
        anchor, end = w["a"] + w["before"], w["a"] + w["n"] - 1 + length
        for i, (r, l) in enumerate(around):
            if w["before"] >= l and anchor + r <= end:
                part = hashlib.blake2b(data[anchor - l : anchor + r], digest_size=8, key=bytes([i]))
                yield int.from_bytes(part.digest(), "little", signed=True), w["gram"], w["a"], w["n"], w["before"]

    return make


def merge_spans(spans) -> list[tuple[int, int]]:
    """Disjoint, non-adjacent spans that cover the same bytes, in order."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with k1, k2: a 128-bit key of the text (null counts as empty), the same for equal texts."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("k1", F.xxhash64(text)).withColumn("k2", F.xxhash64(F.lit("second"), F.length(text), F.reverse(F.right(text, F.lit(64))), text))


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(k1, k2, text): the distinct texts of docs whose keys (k1, k2) are asked for, or, where many are, all."""
    rows = keyed(docs.select("text"))
    if keys.count() <= SMALL_TEXTS:
        rows = rows.join(F.broadcast(keys.select("k1", "k2")), ["k1", "k2"], "left_semi")
    return rows.groupBy("k1", "k2").agg(F.first("text").alias("text"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(k1, k2, spans) of the distinct texts of docs (text) that have repeated bytes.

    spans is an array of struct<s, e>: byte ranges covered by `length`-byte strings that start elsewhere too
    (same text included, overlaps count). Ranges may overlap; merge_spans joins them. crowd: segments of a group
    beyond which it is split; it bounds a task, results don't hang on it.
    """
    gram = min(GRAM, max(8, length // 4))
    seg = keyed(docs.select(F.coalesce("text", F.lit("")).alias("text"))).select("k1", "k2", "text")
    seg = stage(seg.where(F.octet_length("text") >= length).mapInArrow(_segment_rows(length, gram), "gram long, h1 long, h2 long, k1 long, k2 long, a array<int>, n int, before int"), "segments")
    grams = seg.groupBy("gram").agg(F.sum(F.size("a")).alias("c"), F.min("h1").alias("l1"), F.max("h1").alias("g1"), F.min("h2").alias("l2"), F.max("h2").alias("g2")).where("c > 1")
    # staged, so that the join's sides are plain exchanges: then a hot gram's rows can be split over tasks
    grams = stage(grams.select("gram", ((F.col("l1") == F.col("g1")) & (F.col("l2") == F.col("g2"))).alias("pure")), "grams")
    again = stage(seg.join(grams, "gram"), "repeats")
    whole = F.transform("a", lambda a: F.struct(a.alias("s"), (a + F.col("n") - 1 + length).alias("e"))).alias("spans")
    pure = again.where("pure").select("k1", "k2", whole)
    mixed = again.where("not pure")
    firsts = [F.first(c).alias(c) for c in ("k1", "k2", "n", "before")]
    one = mixed.groupBy("gram", "h1", "h2").agg(F.sum(F.size("a")).alias("c"), F.first(F.element_at("a", 1)).alias("a"), *firsts)
    one = stage(one, "differing")
    # a segment that occurs again as a whole repeats wherever it occurs
    copies = mixed.join(one.where("c > 1").select("gram", "h1", "h2"), ["gram", "h1", "h2"], "left_semi").select("k1", "k2", whole)
    many = checkpoint(one.groupBy("gram").agg(F.count("*").alias("different")).where(F.col("different") > crowd).select("gram"))
    crowded = many.count()
    if crowded <= SMALL:  # else the joins below shuffle by gram
        many = F.broadcast(many)

    def cut(rows: DataFrame, make, kinds: dict[str, pa.DataType], schema: str) -> DataFrame:
        wanted = stage(rows.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "a", "n", "before")).alias("wanted")), "wanted")
        return texts_of(docs, wanted).join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted").mapInArrow(_rows_of(make, kinds), f"{schema}, k1 long, k2 long")

    long_, int_ = pa.int64(), pa.int32()
    few, window = one.join(many, "gram", "left_anti").select("gram", "k1", "k2", "a", "n", "before"), None
    if crowded:
        kinds = {"part": long_, "gram": long_, "a": int_, "n": int_, "before": int_}
        parts = stage(cut(one.join(many, "gram", "left_semi"), _parts(length, gram), kinds, "part long, gram long, a int, n int, before int"), "parts")
        met = stage(parts.groupBy("part").agg(F.count("*").alias("c")).where("c > 1"), "parts-met")
        parts = parts.join(met, "part")
        few = few.unionByName(parts.where(F.col("c") <= crowd).select(F.col("part").alias("gram"), "k1", "k2", "a", "n", "before"))
        full = stage(parts.where(F.col("c") > crowd).select("gram", "k1", "k2", "a", "n", "before").distinct(), "full-parts")
        if not full.isEmpty():
            window = stage(cut(full, _windows(length), {"gram": long_, "a": int_, "data": pa.binary()}, "gram long, a int, data binary"), "windows")
    few = cut(few, _segment(length), {"gram": long_, "a": int_, "before": int_, "data": pa.binary()}, "gram long, a int, before int, data binary")
    found = few.select("gram", "k1", "k2", "a", "before", "data").repartition("gram").sortWithinPartitions("gram").mapInArrow(_resolve(length), "k1 long, k2 long, s int, e int")
    if window is not None:
        twice = stage(window.groupBy("gram", "data").agg(F.count("*").alias("c")).where("c > 1").select("gram", "data"), "windows-met")
        found = found.unionByName(window.join(twice, ["gram", "data"], "left_semi").select("k1", "k2", F.col("a").alias("s"), (F.col("a") + length).alias("e")))
    found = found.select("k1", "k2", F.array(F.struct("s", "e")).alias("spans"))
    spans = pure.unionByName(copies).unionByName(found).groupBy("k1", "k2").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    return stage(spans, "spans")


def _without(as_text: bool):
    """Arrow function over (k1, k2, text, spans): what is left of each text, and the counts of bytes and runs removed."""

    def run(batches):
        for b in batches:
            kept, removed, runs = [], [], []
            for t, spans in zip(b.column(2).cast(pa.binary()), b.column(3), strict=True):
                data = t.as_py()
                cut = merge_spans((x["s"], x["e"]) for x in spans.as_py())
                edges = [0, *[v for s in cut for v in s], len(data)]
                kept.append(b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                removed.append(len(data) - len(kept[-1]))
                runs.append(len(cut))
            left = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), left, pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], names=["k1", "k2", "kept", "n_removed", "n_spans"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, as_text: bool = False) -> DataFrame:
    """(k1, k2, kept, n_removed, n_spans) of each distinct text of docs that loses bytes.

    kept is binary; as_text: a string, without the halves of characters that were cut. Null and empty texts, and
    those under `length` bytes, lose nothing. A text that occurs twice loses all its bytes if it has `length` of
    them. Other columns don't matter; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, length, crowd)
    rows = texts_of(docs, spans).join(spans, ["k1", "k2"]).select("k1", "k2", "text", "spans")
    return rows.mapInArrow(_without(as_text), f"k1 long, k2 long, kept {'string' if as_text else 'binary'}, n_removed long, n_spans long")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat in strings of 400, and the digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = remove_repeats(docs.select("text")).select("k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    text = F.coalesce("text", F.lit(""))
    rows = keyed(docs).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("own"), "k1", "k2")
    out = rows.join(cut, ["k1", "k2"], "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_bytes", count("n_removed"), count("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"))


def dedup_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated bytes taken out of text (a character cut in half goes too); columns and rows as before.

    n_chars, where docs has it, counts the text that is left.
    """
    names = docs.columns
    cut = remove_repeats(docs.select("text"), length, as_text=True).select("k1", "k2", "kept")
    rows = keyed(docs.select(*[F.col(f"`{c}`").alias(f"__{c}") for c in names]).withColumn("text", F.col("__text")))
    out = rows.join(cut, ["k1", "k2"], "left").withColumn("__text", F.coalesce("kept", "__text"))
    if "n_chars" in names:
        out = out.withColumn("__n_chars", F.coalesce(F.when(F.col("kept").isNotNull(), F.length("__text").cast("long")), F.col("__n_chars")))
    return out.select(*[F.col(f"`__{c}`").alias(c) for c in names])
