"""Texts whose sets of word n-grams have a Jaccard similarity of at least 4/5: SimHash by multi-index hashing, verified on the sets.

A set's fingerprint is cut into segments; both sides of a pair enumerate the ball of radius 1 around each of theirs,
so two fingerprints meet in a table entry unless all segments differ in more than two bits. Candidates are those that
meet and whose complete distance is at most a third above its mean at similarity 4/5. Where the bits of such a pair
differ independently, one in a thousand pairs at 4/5 is missed, fewer above; up to 3 x segments - 1 bits none.

Candidates only tell which sets may belong together: each connected group of them is cut into cells of bounded size,
in which the sets themselves are searched breadth first for links. A group of more than one cell is first searched cell
by cell, its least member being in all of them; where that leaves several components, those outside the largest one
that may be linked to another meet all others in cells. Crowded table entries are resolved likewise. So a family of any
size costs one pass, and only what it leaves over is met again. Equal sets are one node throughout (their hashes are
compared with second ones; should two sets share one, all are hashed anew), equal fingerprints one candidate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import checkpoint, mix64, stage
from panelforge.llm.graph import connected_components
from panelforge.llm.simhash import shingles

#: Bits of a segment, segments and greatest distance, by the number of fingerprints (a power of two) up to which they
#: serve: an entry holds some (bits + 1) / 2 ** bits of all, and as many segments are taken as a miss of one in a thousand asks for.
SIZES = [(21, 16, 8), (25, 20, 13), (29, 24, 20), (33, 28, 31), (64, 32, 48)]
#: Share of bits that differ between sets of similarity 4/5 (arccos(8/9) / pi), and how much above it candidates may be.
DIFFER, ROOM = 0.1516, 1.85
#: Fingerprints of an entry that one task compares; a larger entry is cut into blocks of half as many.
ENTRY = 1 << 18
#: Shingles of the members of a group that one block holds; two blocks are compared in a task.
BLOCK = 1 << 20
#: Rows of a few numbers that may be broadcast.
SMALL = 1 << 21


def sizes_for(n: int) -> tuple[int, int, int, int]:
    """(bits of a segment, segments, 64-bit words, greatest distance) for n fingerprints."""
    bits, segments = next((b, s) for power, b, s in SIZES if n <= 1 << power)
    words = -(-segments // (64 // bits))
    return bits, segments, words, round(64 * words * DIFFER * ROOM)


def shingle_set(text: bytes, n: int, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; empty without words."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles(text, n)), np.uint64)).view(np.int64)


def set_fingerprint(own: np.ndarray, words: int) -> np.ndarray:
    """SimHash of a set of hashes: a bit is set if it is set in over half of them. Words after the first vote with mixed values."""
    out = np.zeros(words, np.uint64)
    h = own.view(np.uint64)
    for j in range(words if h.size else 0):
        mixed = mix64(h + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))) if j else h
        votes = np.zeros(64, np.int64)
        for at in range(0, h.size, 1 << 16):
            votes += np.unpackbits(mixed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[j] = np.packbits(2 * votes > h.size, bitorder="little").view(np.uint64)[0]
    return out


def _node(own: np.ndarray, salt: int = 0) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), salt) - (1 << 63)


def _small(df: DataFrame) -> DataFrame:
    """df (materialised) for the small side of a join: broadcast if it is small indeed, else the join shuffles."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _candidate(fps: np.ndarray) -> np.ndarray:
    """One number for each fingerprint (row)."""
    out = np.zeros(fps.shape[0], np.uint64)
    for c in fps.T:
        out = mix64(out ^ c) + np.uint64(0x9E3779B97F4A7C15)
    return out.view(np.int64)


def _mapped(docs: DataFrame, n: int, seed: int, columns: dict[str, str], make) -> DataFrame:
    """docs (text and any others) without text, with the columns that make(sets) gives."""
    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"] + [f"{c} {t}" for c, t in columns.items()])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1 << 9):
                part = b.slice(at, 1 << 9)
                sets = [shingle_set(t.as_py() or b"", n, seed) for t in part.column(0).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *make(sets)], names=[*rest, *columns])

    return docs.select("text", *rest).mapInArrow(run, schema)


def with_fingerprints(docs: DataFrame, n: int, seed: int, words: int, salt: int = 0) -> DataFrame:
    """docs without text, with its set's node (its hash), a second hash, size n, candidate number and fingerprint f0, f1, ... Null texts have an empty set."""

    def make(sets):
        fps = np.array([set_fingerprint(s, words) for s in sets], np.uint64).reshape(-1, words)
        return [*[pa.array([_node(s, x) for s in sets], pa.int64()) for x in (salt, ~salt & 0xFFFFFFFF)], pa.array([s.size for s in sets], pa.int64()), pa.array(_candidate(fps)), *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in fps.T]]

    return _mapped(docs, n, seed, {"node": "long", "second": "long", "n": "long", "candidate": "long"} | {f"f{j}": "long" for j in range(words)}, make)


def with_sets(docs: DataFrame, n: int, seed: int = 42, salt: int = 0) -> DataFrame:
    """docs without text, with its set's node and sorted shingles."""

    def make(sets):
        ends = np.cumsum([0, *map(len, sets)])
        return [pa.array([_node(s, salt) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))]

    return _mapped(docs, n, seed, {"node": "long", "shingles": "array<long>"}, make)


# ---- candidates


def probes(fps: DataFrame, bits: int, segments: int, words: int) -> DataFrame:
    """(key, f0, f1, ...): a row for each value at most one bit away from each segment."""
    per_word = 64 // bits
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i) for i in range(bits)])

    def ball(s: int):
        own = F.shiftrightunsigned(f"f{s // per_word}", bits * (s % per_word)).bitwiseAND(F.lit((1 << bits) - 1))
        return F.transform(flips, lambda m: own.bitwiseXOR(m).bitwiseOR(F.lit(s << bits)))

    return fps.select(F.explode(F.concat(*map(ball, range(segments)))).alias("key"), *[f"f{j}" for j in range(words)])


def forest(fps: np.ndarray, distance: int, blocks: int = 1 << 22):
    """Edges (rows a, b) that connect all fingerprints linked by distances up to `distance`: breadth first, many at a time."""
    a, b, left = [], [], np.arange(len(fps))
    while left.size:
        front, left = left[:1], left[1:]
        while front.size and left.size:
            take, front = front[: max(1, blocks // left.size)], front[max(1, blocks // left.size) :]
            near = np.bitwise_count(fps[take][:, None, :] ^ fps[left][None, :, :]).sum(axis=2, dtype=np.int64) <= distance
            hit = near.any(axis=0)
            if hit.any():
                new = left[hit]
                a.append(take[near[:, hit].argmax(axis=0)])
                b.append(new)
                front, left = np.concatenate((front, new)), left[~hit]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _pairwise(fps: np.ndarray, distance: int, blocks: int = 1 << 22):
    """Edges of all pairs within the distance, if there are fewer than fingerprints; else a forest. Most entries hold unrelated ones: no search pays there."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, blocks // max(1, len(fps)))
    for at in range(0, len(fps), step):
        x, y = np.nonzero(np.bitwise_count(fps[at : at + step, None, :] ^ fps[None, at:, :]).sum(axis=2, dtype=np.int64) <= distance)
        keep = y > x
        a.append(x[keep] + at)
        b.append(y[keep] + at)
        if sum(map(len, a)) > len(fps):
            return forest(fps, distance)
    return np.concatenate(a), np.concatenate(b)


def _entries(words: int, distance: int, limit: int):
    """Arrow function over (key, f0, ...) sorted by key: edges (a, b) of candidate numbers; members of larger entries pass through with their key, their number in b."""
    names = ["a", "b", "key", *[f"f{j}" for j in range(words)]]

    def edges(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.nulls(a.size, pa.int64())] * (1 + words)], names=names)

    def members(key, fps):
        return pa.RecordBatch.from_arrays([pa.nulls(len(fps), pa.int64()), pa.array(_candidate(fps)), pa.array(key), *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in fps.T]], names=names)

    def resolve(key, fps):
        own = _candidate(fps)
        order = np.lexsort((own, key))  # a large group's forests start from the same fingerprint in all entries that hold it
        key, fps, own = key[order], fps[order], own[order]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [key.size]))
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if e - s > 1:
                a, b = _pairwise(fps[s:e], distance)
                found.append((own[s:e][a], own[s:e][b]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        if a.size:
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield edges(pairs[0], pairs[1])

    def run(batches):
        held_key, held, flowing = np.empty(0, np.int64), np.empty((0, words), np.uint64), None
        for batch in batches:
            key = np.concatenate((held_key, batch.column(0).to_numpy()))
            fps = np.concatenate((held, np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1).view(np.uint64)))
            if flowing is not None:  # members of an entry that is known to be too large pass through
                same = int(np.searchsorted(key, flowing, "right"))
                if same:
                    yield members(key[:same], fps[:same])
                key, fps, flowing = key[same:], fps[same:], flowing if same == key.size else None
            last = int(np.searchsorted(key, key[-1])) if key.size else 0
            if last:
                yield from resolve(key[:last], fps[:last])
            held_key, held = key[last:], fps[last:]
            if held_key.size > limit:
                flowing = held_key[0]
                yield members(held_key, held)
                held_key, held = held_key[:0], held[:0]
        if held_key.size:
            yield from resolve(held_key, held)

    return run


def candidate_edges(fps: DataFrame, sizes: tuple[int, int, int, int], limit: int) -> DataFrame:
    """(a, b) candidate numbers that connect all fingerprints which meet in an entry within the distance."""
    bits, segments, words, distance = sizes
    schema = "a long, b long, key long, " + ", ".join(f"f{j} long" for j in range(words))
    f = [f"f{j}" for j in range(words)]
    rows = probes(fps.select(*f).distinct(), bits, segments, words)
    found = stage(_by_key(rows, _entries(words, distance, limit), schema), "near-entries")
    edges = found.where("key is null").select("a", "b")
    crowded = found.where("key is not null").select("key", F.col("b").alias("candidate"), *f)
    if crowded.isEmpty():
        return edges
    blocks = checkpoint(crowded.groupBy("key").agg(F.ceil(F.count("*") / F.lit(limit // 2)).cast("int").alias("blocks"), F.min("candidate").alias("pivot")))
    block = F.when(F.col("candidate") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("candidate"), F.col("blocks")).cast("int")))
    dealt = crowded.join(_small(blocks), "key").select("key", *f, F.explode(block).alias("block"))
    whole = _entries(words, distance, 1 << 62)
    first = _by_key(dealt.select(F.xxhash64("key", "block").alias("key"), *f), whole, schema).select("a", "b")
    edges = stage(edges.unionByName(first), "near-first")
    comp = connected_components(edges).withColumnRenamed("node", "candidate")
    of = stage(crowded.join(comp, "candidate", "left").withColumn("comp", F.coalesce("comp", "candidate")), "near-crowded")
    cells = _met(with_away(of).withColumn("n", F.lit(1)), limit // 2, "candidate", *f)
    return edges.unionByName(_by_key(cells.select(F.col("cell").alias("key"), *f), whole, schema).select("a", "b"))


def _by_key(rows: DataFrame, found, schema: str) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(found, schema)


def with_away(members: DataFrame) -> DataFrame:
    """members (key, comp, ...) with away: whether they lie outside their key's largest component."""
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("size"))
    home = checkpoint(sizes.groupBy("key").agg(F.max(F.struct("size", "comp"))["comp"].alias("home")))
    return members.join(_small(home), "key").withColumn("away", F.col("comp") != F.col("home")).drop("home")


def _met(members: DataFrame, block: int, own: str, *columns: str) -> DataFrame:
    """(cell, key, own, columns...) of members (key, own, n, away, columns...): any two of a key, one of them away, share a cell of about two blocks (sums of n).

    A member at home is sent once for each block of those away: keys without any send nothing, and keys with few send a pass.
    """
    away = F.sum(F.when(F.col("away"), F.col("n")).otherwise(0))
    sized = members.groupBy("key").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("blocks"), F.ceil(away / F.lit(block)).cast("int").alias("others"), F.max("away").alias("any"))
    sized = checkpoint(sized.where("any").select("key", F.greatest("blocks", F.lit(1)).alias("blocks"), F.greatest("others", F.lit(1)).alias("others")))
    dealt = members.join(_small(sized), "key").withColumn("block", F.pmod(F.xxhash64(own), F.col("blocks")).cast("int")).withColumn("other", F.pmod(F.xxhash64(F.lit(1), own), F.col("others")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda x: F.struct(F.col("block").alias("x"), x.alias("y")))
    all_ = F.transform(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block")), lambda x: F.struct(x.alias("x"), F.col("other").alias("y")))
    dealt = dealt.select("key", own, *columns, F.explode(F.when(F.col("away"), F.concat(met, all_)).otherwise(met)).alias("at"))
    return dealt.select(F.xxhash64("key", "at.x", "at.y").alias("cell"), "key", own, *columns)


# ---- links inside groups of candidates


def _search(node: np.ndarray, sets: list[np.ndarray]):
    """Spanning forest of one cell by similarity: each search step compares one set with those not yet reached."""
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    size = np.array([s.size for s in sets])
    end = np.cumsum(size)
    mark = np.zeros(flat.max(initial=0) + 1, bool)
    left, tokens = np.arange(node.size), flat
    a, b = [], []
    while left.size:
        queue, tokens, left = [left[0]], tokens[size[left[0]] :], left[1:]
        while queue and left.size:
            at = queue.pop()
            own = flat[end[at] - size[at] : end[at]]
            mark[own] = True
            both = np.add.reduceat(np.concatenate((mark[tokens], [False])), np.cumsum(size[left]) - size[left], dtype=np.int64) * (size[left] > 0)
            mark[own] = False
            near = 5 * both >= 4 * (size[left] + size[at] - both)
            if near.any():
                new = left[near]
                a.append(np.full(new.size, node[at]))
                b.append(node[new])
                queue.extend(new)
                tokens, left = tokens[np.repeat(~near, size[left])], left[~near]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _cells(found):
    """Arrow function over (cell, key, node, values) sorted by cell: found(key, node, values) of each cell."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            for cell, key, node, own in zip(*[c.to_pylist() for c in batch.columns[:3]], batch.column(3), strict=True):
                if cell != now and len(held) > 1:
                    yield found(*zip(*held, strict=True))
                if cell != now:
                    held = []
                now = cell
                held.append((key, node, own.values.to_numpy().copy()))
        if len(held) > 1:
            yield found(*zip(*held, strict=True))

    return run


def _links(key, node, sets):
    a, b = _search(np.array(node, np.int64), sets)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _possible(distance: int):
    """The members of a cell that are near enough to one of another component; values are the component and the fingerprint."""

    def found(key, node, values):
        comp = np.array([v[0] for v in values])
        fps = np.array([v[1:] for v in values]).view(np.uint64)
        near = np.zeros(comp.size, bool)
        step = max(1, (1 << 22) // comp.size)
        for at in range(0, comp.size, step):
            met = np.bitwise_count(fps[at : at + step, None] ^ fps[None]).sum(axis=2, dtype=np.int64) <= distance
            near[at : at + step] = (met & (comp[at : at + step, None] != comp[None])).any(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.array(key, np.int64)[near]), pa.array(np.array(node, np.int64)[near])], names=["key", "node"])

    return found


def _in_turn(cells: DataFrame, found, schema: str) -> DataFrame:
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells(found), schema)


def in_cells(members: DataFrame, values: DataFrame, block: int) -> DataFrame:
    """(cell, key, node, v) of the members (key, node, n, away) of groups: any two of a group, one of them away, share a cell of at most about two blocks."""
    return _met(members, block, "node").join(values, "node").select("cell", "key", "node", "v")


def similar_components(docs: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """docs (__row, text and any others) without text, with comp: equal where texts are linked by similarities of 4/5 or more.

    Rows of one __row are repeats of each other. Texts without words are one component, shorter ones than n words
    have their whole sequence for a set. Texts of any length are read in whole; an empty table gives none.
    """
    sizes = sizes_for(docs.count())
    words, distance = sizes[2:]
    f = [f"f{j}" for j in range(words)]
    salt = 0
    while True:
        nodes = stage(with_fingerprints(docs, n, seed, words, salt), "near-nodes")
        if nodes.groupBy("node").agg(F.min("second").alias("x"), F.max("second").alias("y")).where("x <> y").isEmpty():
            break
        salt += 1
    group = connected_components(candidate_edges(nodes, sizes, ENTRY)).withColumnRenamed("node", "candidate")
    one = nodes.groupBy("node").agg(F.min("__row").alias("__row"), F.first("n").alias("n"), F.first("candidate").alias("candidate"), *[F.first(c).alias(c) for c in f])
    one = one.join(group, "candidate", "left").select("node", "__row", "n", F.coalesce("comp", "candidate").alias("key"), *f)
    # checkpointed, so that the join's sides are plain exchanges: then a large group's rows can be split over tasks
    many = checkpoint(one.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("pivot")).where("members > 1"))
    open_ = stage(one.join(many, "key"), "near-groups")

    sets = with_sets(docs.select("__row", "text").join(_small(open_.select("__row")), "__row", "left_semi"), n, seed, salt).select("node", "shingles").dropDuplicates(["node"])
    sized = sets.join(open_.select("node", "key", "pivot"), "node")
    blocks = stage(open_.groupBy("key").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("blocks")).where("blocks > 1"), "near-large")
    if blocks.isEmpty():
        cells = sized.select(F.col("key").alias("cell"), "key", "node", F.col("shingles").alias("v"))
    else:
        block = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")))
        dealt = sized.join(_small(blocks), "key", "left").select("key", "node", "shingles", F.explode(block).alias("block"))
        cells = dealt.select(F.xxhash64("key", "block").alias("cell"), "key", "node", F.col("shingles").alias("v"))
    comp = connected_components(_in_turn(cells, _links, "a long, b long"))

    if not blocks.isEmpty():
        of = checkpoint(open_.join(_small(blocks.select("key")), "key", "left_semi").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
        of = stage(with_away(of).select("key", "node", "n", "away", F.concat(F.array("comp"), F.array(*f)).alias("v")), "near-away")
        ends = checkpoint(_in_turn(in_cells(of.select("key", "node", F.lit(1).alias("n"), "away"), of.select("node", "v"), BLOCK // 64), _possible(distance), "key long, node long").distinct())
        if not ends.isEmpty():
            met = in_cells(ends.join(of.select("node", "n", "away"), "node"), sets.select("node", F.col("shingles").alias("v")), BLOCK)
            comp = connected_components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(_in_turn(met, _links, "a long, b long")))
    own = nodes.drop("second", "n", "candidate", *f)
    return own.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).drop("node")
