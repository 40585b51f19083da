"""SimHash near-duplicates by multi-index hashing over 64-bit fingerprints.

Each fingerprint is cut into two halves; a pair within 4 (or 5) bits differs by at most 2 in one half. Both
sides of such a pair enumerate the ball of radius 1 around that half, so they meet in a table entry. Entries are
verified on the complete distance. Equal fingerprints are one node throughout. Within an entry a few members
are compared in pairs; many members are searched breadth first, which yields a spanning forest instead of all
pairs; an entry beyond HOT members is resolved exactly without being gathered: fingerprints within 4 bits
share a midpoint at most 2 bits from either, and all that share a midpoint are within 4 of each other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import checkpoint, mix64, row_hash, stage
from panelforge.llm.graph import connected_components

#: Bits in which linked fingerprints may differ: what two balls of radius 1 in a half guarantee to find.
DISTANCE = 4
FEW = 8
HOT = 20_000


def shingles(text: bytes, n: int) -> list[bytes]:
    """Word n-grams of a lower-cased UTF-8 text, repeats included; the whole sequence if it is shorter, none if empty."""
    words = text.lower().split()
    if not words:
        return []
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(words) - n + 1)
    return [flat[s:e] for s, e in zip(starts[:k].tolist(), ends[min(n, len(words)) - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, n: int, seed: int = 42, words: int = 1) -> list[int]:
    """SimHash of 64 bits a word: a bit is set if it is set in over half of the shingles' hashes; 0 without words.

    The first word votes with XXH64, further ones with mixed values of it.
    """
    found = shingles(text, n)
    if not found:
        return [0] * words
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in found), np.uint64, len(found))
    out = []
    for j in range(words):
        own = mix64(h + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))) if j else h
        votes = np.zeros(64, np.int64)
        for at in range(0, h.size, 1 << 16):
            votes += np.unpackbits(own[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * votes > h.size).tobytes(), "big"))
    return out


def with_fingerprint(docs: DataFrame, n: int = 4, seed: int = 42, words: int = 1) -> DataFrame:
    """docs (text and any others) without text, with longs f0, f1, ...: the fingerprint's words. Null texts have no words."""
    rest = [c for c in docs.columns if c != "text"]
    fps = [f"f{j}" for j in range(words)]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != "text") + ", ".join(f"{f} long" for f in fps)

    def run(batches):
        for b in batches:
            texts = b.column(0).cast(pa.binary())
            fp = np.array([fingerprint(t.as_py() or b"", n, seed, words) for t in texts], np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *[pa.array(np.ascontiguousarray(c)) for c in fp.T]], names=[*rest, *fps])

    return docs.select("text", *rest).mapInArrow(run, schema)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1)


def _pairs(fps: np.ndarray, group: np.ndarray, distance: int):
    """Linked pairs of small groups; rows of a group are adjacent."""
    out = []
    for off in range(1, FEW):
        same = np.flatnonzero(group[off:] == group[:-off])
        if not same.size:
            break
        near = same[_distance(fps[same], fps[same + off]) <= distance]
        out.append((fps[near], fps[near + off]))
    return out


def _forest(fps: np.ndarray, distance: int):
    """Spanning forest of one entry: each search step compares one member with those not yet reached."""
    left, out = fps, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _distance(left, at) <= distance
            if near.any():
                new = left[near]
                out.append((np.repeat(at[None, :], len(new), axis=0), new))
                queue.extend(new)
                left = left[~near]
    return out


def _entries(words: int, distance: int, hot: float):
    """Arrow function over rows (key, fingerprint) sorted by key: edges a*, b*; b* is null for members of entries beyond hot."""
    names = [f"{x}{j}" for x in "ab" for j in range(words)]

    def edges(found):
        none = np.empty((0, words), np.uint64)
        a = np.concatenate([none, *[x for x, _ in found]])
        b = np.concatenate([none, *[y for _, y in found]])
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for m in (a, b) for c in m.T], names=names)

    def members(fps):
        return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in fps.T], *[pa.nulls(len(fps), pa.int64())] * words], names=names)

    def resolve(key, fps):
        cut = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [key.size]))
        n = ends - starts
        few = (n > 1) & (n <= FEW)
        rows = np.repeat(few, n)
        found = _pairs(fps[rows], key[rows], distance) if rows.any() else []
        for s, e in zip(starts[n > FEW], ends[n > FEW], strict=True):
            found += _forest(fps[s:e], distance)
        return edges(found)

    def run(batches):
        held_key, held, flowing = np.empty(0, np.int64), np.empty((0, words), np.uint64), None
        for b in batches:
            key = np.concatenate((held_key, b.column(0).to_numpy()))
            fps = np.concatenate((held, np.stack([c.to_numpy() for c in b.columns[1:]], axis=1).view(np.uint64)))
            if flowing is not None:  # members of an entry that is known to be too large pass through
                same = int(np.searchsorted(key, flowing, "right"))
                if same:
                    yield members(fps[:same])
                if same < key.size:
                    flowing = None
                key, fps = key[same:], fps[same:]
            if not key.size:
                held_key, held = key, fps
                continue
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield resolve(key[:last], fps[:last])
            held_key, held = key[last:], fps[last:]
            if len(held) > hot:
                flowing = held_key[0]
                yield members(held)
                held_key, held = held_key[:0], held[:0]
        if len(held):
            yield resolve(held_key, held)

    return run


def _midpoints(members: DataFrame) -> DataFrame:
    """Edges among fingerprints by shared midpoints: each lists all 2,081 values at most two bits away."""
    masks = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)]
    near = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    balls = members.select(F.col("a").alias("fp"), F.explode(F.transform(near, lambda m: m.bitwiseXOR(F.col("a")))).alias("mid"))
    centre = balls.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    return balls.join(centre, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b")


def link_fingerprints(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (f0) that connect all pairs within DISTANCE bits."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i) for i in range(32)])

    def ball(value: Column, half: int) -> Column:
        return F.transform(flips, lambda m: value.bitwiseXOR(m).bitwiseOR(F.lit(half << 32)))

    low = F.col("f0").bitwiseAND(F.lit((1 << 32) - 1))
    keys = [ball(low, 0), ball(F.shiftrightunsigned("f0", 32), 1)]
    rows = fps.select("f0").distinct().select(F.explode(F.concat(*keys)).alias("key"), "f0")
    rows = rows.repartition("key").sortWithinPartitions("key")
    found = stage(rows.mapInArrow(_entries(1, DISTANCE, hot), "a0 long, b0 long"), "simhash-edges")
    edges = found.where("b0 is not null").select(F.col("a0").alias("a"), F.col("b0").alias("b")).distinct()
    crowded = found.where("b0 is null").select(F.col("a0").alias("a")).distinct()
    if not crowded.isEmpty():
        edges = edges.unionByName(_midpoints(crowded))
    return edges


def _components(fp: DataFrame, hot: int) -> DataFrame:
    """(node, comp) of every fingerprint of fp."""
    nodes = fp.select("f0").distinct()
    comp = connected_components(link_fingerprints(nodes, hot)).withColumnRenamed("node", "of")
    own = nodes.select(F.col("f0").alias("node"))
    return own.join(comp, own.node == comp.of, "left").select("node", F.coalesce("comp", "node").alias("comp"))


def near_duplicates(docs: DataFrame, n: int = 4, seed: int = 42, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text).

    Links: fingerprints at DISTANCE or fewer differing bits, equal ones included; component_id is the smallest
    doc_id reachable (nulls don't count; null if a component has none). Null, empty and blank texts have
    fingerprint 0, which links like any other. Repeated rows are repeated in the result; an empty table gives none.
    """
    fp = stage(with_fingerprint(docs.select("doc_id", "text"), n, seed), "simhash-fp")
    comp = _components(fp, hot)
    least = fp.groupBy("f0").agg(F.min("doc_id").alias("least"))
    # checkpointed, so that the joins' sides are plain exchanges: then a large component's or copies' rows can be split over tasks
    named = checkpoint(least.join(comp, F.col("f0") == F.col("node")).select("node", "least", "comp"))
    ids = checkpoint(named.groupBy("comp").agg(F.min("least").alias("component_id")))
    of = checkpoint(named.join(ids, "comp").select("node", "component_id"))
    return fp.join(of, F.col("f0") == F.col("node")).select("doc_id", F.col("f0").alias("fp"), "component_id")


def keep_one(docs: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """docs with one row of each near-duplicate group: the least doc_id (nulls last; then the least row hash).

    Links: sets of five-word shingles with a Jaccard similarity of 0.8 or more, found by multi-index hashing over
    SimHash fingerprints of 128 bits or more and verified on the sets (see near_sets for what may be missed). Columns
    and texts stay as they are (names starting with two underscores are the operator's own); rows that repeat in full
    become one: rows are told apart by doc_id and row hash. Texts of any length are read in whole; all without words,
    nulls among them, are one group. An empty table stays empty.
    """
    from panelforge.llm.near_sets import similar_components

    rows = docs.withColumn("__row", row_hash(docs))
    fp = checkpoint(similar_components(rows.select("doc_id", "__row", "text"), n, seed))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "__row"))
    best = fp.groupBy("comp").agg(first.alias("best")).select(F.col("best.doc_id").alias("__id"), F.col("best.__row").alias("__best"))
    kept = rows.join(best, (F.col("__row") == F.col("__best")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    if not fp.groupBy("doc_id", "__row").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "__row"])
    return kept.drop("__row")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint (4-word shingles) and near-duplicate component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
