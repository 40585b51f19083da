"""Trigram scoring from an Elias-Fano trie of quantised, smoothed probabilities.

Three levels, each cut into shards by (context, successor) and written once to the shared folder, where every task
maps the files it needs into memory: words (by 64-bit hash, with exact counts), successors of words, and successors
of word pairs. A level keeps its contexts, pointers and successors as Elias-Fano sequences. In the last level a
successor is not a word but its place among the successors of the pair's second word: a lookup first finds the
pair (w2, w3), then searches that place among the successors of (w1, w2).

Counting sends no n-gram as a row of its own: a chunk of text gives one Elias-Fano block of sorted keys for each
range of keys, and whoever gets a range adds its blocks up and writes the shard. The ranges of a level come from the
exact counts of the level before, so that each holds about SHARD tokens; the successors of a context that is more
frequent than that are spread over several shards, and what its back-off weight needs is put together from them.

Probabilities: p1 = (c + 1) / (N + V + 1), words never seen included; above it, with absolute discount D (n-grams seen
less than `least` times are left out, what they had goes to the back-off weight, so that each context's
probabilities still sum to one): p = (c - D) / c(context) + backoff(context) * p(lower). Codes are 16 bits, rounded down.
"""

from __future__ import annotations

import json
import math
import mmap
import os
import uuid
import zlib
from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import mix64, shared_dir, utf8_chunks
from panelforge.llm.elias_fano import EliasFano
from panelforge.llm.suffix_dedup import _BYTE, _powers

DISCOUNT = 0.75
#: The hash that stands for the end of a text (and for what precedes its first word).
END = np.uint64(0x5E5E_5E5E_0000_0001)
#: Tokens that one shard of a level aims at.
SHARD = 1 << 22
#: Bytes of text that are counted or scored together: lookups visit each shard once a chunk.
CHUNK = 1 << 22
#: Chunks after which mapped pages are given back.
CHUNKS = 8
#: Bytes of level files that a process keeps where they can't be mapped, and files that it keeps mapped.
HELD, MAPPED = 1 << 28, 256
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OPEN: OrderedDict[str, tuple[dict[str, np.ndarray], mmap.mmap | None, int]] = OrderedDict()


# ---- files of the levels


def _local(path: str) -> str | None:
    """The path on a mounted file system, or None if only a file system client reaches it."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def _qualified(spark, path: str) -> str:
    """The path with the scheme of the file system that Spark takes it for: on a cluster, one without a scheme isn't a local one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def write_level(path: str, parts: dict[str, np.ndarray]) -> None:
    """Write arrays as one file (under a temporary name first: a retried task leaves no half file)."""
    at, index = 0, {}
    for k, a in parts.items():
        index[k] = [a.dtype.str, at, a.size]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(index).encode()
    head += b" " * (-(len(head) + 8) % 64)
    body = [len(head).to_bytes(8, "little"), head]
    for a in parts.values():
        body += [a.tobytes(), b"\0" * (-a.nbytes % 64)]
    if local := _local(path):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{local}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.writelines(body)
        os.replace(part, local)
    else:
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(os.path.dirname(inner), recursive=True)
        with fs.open_output_stream(inner) as f:
            for x in body:
                f.write(x)


def open_level(path: str) -> dict[str, np.ndarray]:
    """Arrays of a level file: memory-mapped where the shared folder is mounted; otherwise read, and at most HELD bytes kept."""
    if path not in _OPEN:
        mapped = None
        if local := _local(path):
            with open(local, "rb") as f:
                mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            raw = np.frombuffer(mapped, np.uint8)
        else:
            fs, inner = pyarrow.fs.FileSystem.from_uri(path)
            with fs.open_input_file(inner) as f:
                raw = np.frombuffer(f.read(), np.uint8)
        n = int(raw[:8].view(np.int64)[0])
        index = json.loads(bytes(raw[8 : 8 + n]))
        arrays = {k: raw[8 + n + at : 8 + n + at + size * np.dtype(kind).itemsize].view(kind) for k, (kind, at, size) in index.items()}
        _OPEN[path] = arrays, mapped, 0 if mapped else raw.size
        # the mapping of a file that is let go closes, and its descriptor with it, when the last array on it goes
        while (sum(x[2] for x in _OPEN.values()) > HELD or len(_OPEN) > MAPPED) and len(_OPEN) > 1:
            _OPEN.popitem(last=False)
    _OPEN.move_to_end(path)
    return _OPEN[path][0]


_USED = [0]


def release() -> None:
    """Once in CHUNKS calls, give mapped pages back (they stay in the system's cache), so that a task's memory doesn't grow with the levels."""
    _USED[0] += 1
    if _USED[0] % CHUNKS == 0:
        for _, mapped, _ in _OPEN.values():
            if mapped is not None:
                mapped.madvise(mmap.MADV_DONTNEED)


# ---- tokens


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of lower-cased texts in a row, each text closed by END; and each text's number of tokens."""
    data = b"\n".join(texts).lower() + b"\n"
    buf = np.frombuffer(data, np.uint8)
    gap = _SPACE[buf]
    before = np.concatenate(([True], gap[:-1]))
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(gap & ~before)
    up, down = _powers(buf.size + 1)
    sums = np.zeros(buf.size + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:-1], out=sums[1:])
    words = mix64((sums[end] - sums[start]) * down[start] + mix64((end - start).astype(np.uint64)))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    upto = np.searchsorted(start, ends)
    n = np.diff(np.concatenate(([0], upto)))
    out = np.full(words.size + len(texts), END, np.uint64)
    out[np.arange(words.size) + np.repeat(np.arange(len(texts)), n)] = words
    return out, n + 1


def _pieces(batch: pa.RecordBatch, column: int):
    yield from utf8_chunks(batch.column(column).cast(pa.binary()).to_pylist(), CHUNK)


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


# ---- levels as lookups


class Cuts:
    """Ranges of (context, successor) pairs by their first pairs, in order."""

    def __init__(self, context: np.ndarray, successor: np.ndarray):
        self.context, self.successor = context, successor
        again = np.flatnonzero(context[1:] == context[:-1]) + 1
        self.split = np.unique(context[again])  # contexts that several ranges begin with

    def of(self, ctx: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The range of each pair (-1: before the first). At most one range that begins inside a context's successors is told by the context alone."""
        at = np.searchsorted(self.context, ctx, "right") - 1
        # the last range that begins with this context may begin behind the successor
        check = np.flatnonzero((at >= 0) & (self.context[np.maximum(at, 0)] == ctx) & (self.successor[np.maximum(at, 0)] > successor))
        at[check] -= 1
        if self.split.size and check.size:
            deep = check[np.isin(ctx[check], self.split)]
            for c in np.unique(ctx[deep]).tolist():
                rows = deep[ctx[deep] == c]
                low, high = np.searchsorted(self.context, [c, c + 1])
                at[rows] = low - 1 + np.searchsorted(self.successor[low:high], successor[rows], "right")
        return at


def _gap(sums: EliasFano, i: np.ndarray) -> np.ndarray:
    """Differences of a sequence of running totals: total[i + 1] - total[i]."""
    return (sums.access(i + 1) - sums.access(i)).astype(np.int64)


def _code(p: np.ndarray) -> np.ndarray:
    """-log2(p) in steps of 1/1024, rounded up; 65535 for 0."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.ceil(-np.log2(p) * 1024), 65535).astype(np.uint16)


def _decode(code: np.ndarray) -> np.ndarray:
    return np.where(code == 65535, 0.0, np.exp2(code / -1024.0))


class Words:
    """Level 1: word hash -> number (its place among all sorted hashes) and exact count."""

    def __init__(self, folder: str, files: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, total: int):
        self.folder, self.files, self.firsts, self.total = folder, files, firsts, total
        self.bases, self.size = np.cumsum(sizes) - sizes, int(sizes.sum())

    def _shard(self, s: int) -> dict[str, np.ndarray]:
        return open_level(f"{self.folder}/words-{self.files[s]}.level")

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of each distinct hash."""
        number, count = np.full(hashes.size, -1, np.int64), np.zeros(hashes.size, np.int64)
        of = np.searchsorted(self.firsts, hashes, "right") - 1
        for s in np.unique(of[of >= 0]).tolist():
            parts = self._shard(s)
            rows = np.flatnonzero(of == s)
            at = EliasFano.of(parts, "hash").find(hashes[rows] - self.firsts[s])
            rows, at = rows[at >= 0], at[at >= 0]
            number[rows] = at + self.bases[s]
            count[rows] = _gap(EliasFano.of(parts, "counts"), at)
        return number, count

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(numbers.size, np.int64)
        of = np.searchsorted(self.bases, numbers, "right") - 1
        for s in np.unique(of).tolist():
            rows = np.flatnonzero(of == s)
            out[rows] = _gap(EliasFano.of(self._shard(s), "counts"), numbers[rows] - self.bases[s])
        return out


class Successors:
    """Level 2 or 3: (context, successor) -> place in the level, probability; context -> back-off weight, pointer."""

    def __init__(self, folder: str, name: str, width: int, made: list):
        """made: the shards' rows (see _write_successors)."""
        made = sorted(made, key=lambda r: r.file)
        column = lambda c: np.array([getattr(r, c) for r in made], np.int64)
        self.folder, self.name, self.width = folder, name, width
        self.files, sizes = column("file"), column("n")
        self.cuts, self.bases, self.size = Cuts(column("context"), column("successor")), np.cumsum(sizes) - sizes, int(sizes.sum())
        # contexts at the edges of shards, put together from all that hold a part
        edges: dict[int, list] = {}
        for r, base in zip(made, self.bases.tolist(), strict=True):
            for e in r.edges:
                got = edges.setdefault(e.context, [base + e.at, 0.0, e.total, 0])
                got[1] += e.kept
                got[3] += 1
        split = sorted(c for c, e in edges.items() if e[3] > 1)
        self.split = np.array(split, np.int64)
        self.split_pointer = np.array([edges[c][0] for c in split], np.int64)
        self.split_backoff = np.array([1 - edges[c][1] / edges[c][2] for c in split], np.float64)

    def _shard(self, s: int) -> dict[str, np.ndarray]:
        return open_level(f"{self.folder}/{self.name}-{self.files[s]}.level")

    def find(self, ctx: np.ndarray, successor: np.ndarray, pointers: bool = True):
        """Of pairs, equal contexts next to each other: place (-1: absent) and probability (0); of their contexts: pointer (place of the first successor; 0 where not asked for) and back-off weight (0 and 1 if absent)."""
        place, p = np.full(ctx.size, -1, np.int64), np.zeros(ctx.size)
        pointer, backoff = np.zeros(ctx.size, np.int64), np.ones(ctx.size)
        live = np.flatnonzero(ctx >= 0)
        if not live.size:
            return place, p, pointer, backoff
        of = self.cuts.of(ctx[live], successor[live])
        # a context that a shard begins with is wholly there unless it is split, even where the pair would come before its first
        after = np.minimum(of + 1, self.bases.size - 1)
        of = np.where((self.cuts.context[after] == ctx[live]) & ~np.isin(ctx[live], self.split), after, of)
        order = np.argsort(of, kind="stable")
        live, of = live[order], of[order]
        start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        for x, y in zip(start.tolist(), [*start[1:].tolist(), of.size], strict=True):
            s = int(of[x])
            if s < 0:
                continue
            parts, rows = self._shard(s), live[x:y]
            own = ctx[rows] - self.cuts.context[s]
            new = np.concatenate(([True], own[1:] != own[:-1]))
            own, back = own[new], np.cumsum(new) - 1
            row = EliasFano.of(parts, "context").find(own)
            known = row >= 0
            weight = np.ones(own.size)
            weight[known] = _decode(parts["backoff"][row[known]])
            backoff[rows] = weight[back]
            if pointers:
                first = np.zeros(own.size, np.int64)
                first[known] = EliasFano.of(parts, "pointers").access(row[known]).astype(np.int64) + self.bases[s]
                pointer[rows] = first[back]
            row = row[back]
            ask = (row >= 0) & (successor[rows] >= 0)
            rows, row = rows[ask], row[ask]
            at = EliasFano.of(parts, "next").find(row * self.width + successor[rows])
            rows, at = rows[at >= 0], at[at >= 0]
            place[rows] = at + self.bases[s]
            p[rows] = _decode(parts["p"][at])
        if self.split.size:  # contexts that several shards hold a part of
            at = np.minimum(np.searchsorted(self.split, ctx), self.split.size - 1)
            own = np.flatnonzero(self.split[at] == ctx)
            pointer[own], backoff[own] = self.split_pointer[at[own]], self.split_backoff[at[own]]
        return place, p, pointer, backoff

    def counts(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(places.size, np.int64)
        of = np.searchsorted(self.bases, places, "right") - 1
        for s in np.unique(of).tolist():
            rows = np.flatnonzero(of == s)
            out[rows] = _gap(EliasFano.of(self._shard(s), "counts"), places[rows] - self.bases[s])
        return out


def _distinct(x: np.ndarray, y: np.ndarray):
    """Distinct pairs of two arrays (each at least -1), in order: the pairs' arrays and the inverse."""
    if max(x.max(initial=0), y.max(initial=0)) < (1 << 32) - 1:
        both, back = np.unique((x + 1).astype(np.uint64) << np.uint64(32) | (y + 1).astype(np.uint64), return_inverse=True)
        return (both >> np.uint64(32)).astype(np.int64) - 1, (both & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1, back
    order = np.lexsort((y, x))
    new = np.concatenate(([True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])))
    back = np.empty(x.size, np.int64)
    back[order] = np.cumsum(new) - 1
    return x[order][new], y[order][new], back


class Model:
    def __init__(self, words: Words | None, pairs: Successors | None = None, triples: Successors | None = None):
        self.words, self.pairs, self.triples = words, pairs, triples
        self.end = int(words.find(np.array([END]))[0][0]) if words else -1

    def numbers(self, hashes: np.ndarray):
        """Number and count of each token."""
        back, own = pd.factorize(hashes)
        order = np.argsort(own)
        number, count = np.empty((2, own.size), np.int64)
        number[order], count[order] = self.words.find(own[order])
        return number[back], count[back]

    def previous(self, number: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What precedes each token; END before a text's first."""
        before = np.concatenate(([self.end], number[:-1]))
        before[np.cumsum(sizes) - sizes] = self.end
        return before

    def pair_places(self, before: np.ndarray, number: np.ndarray):
        """Of each token after its predecessor: place in level 2, probability, place among the context's successors, back-off weight."""
        a, b, back = _distinct(before, number)
        place, p, pointer, backoff = self.pairs.find(a, b)
        relative = np.where(place >= 0, place - pointer, -1)
        return place[back], p[back], relative[back], backoff[back]

    def pair_contexts(self, place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The place of the word pair before each token; -1 where there are no two words before it in its text."""
        context = np.concatenate(([-1], place[:-1]))
        context[np.cumsum(sizes) - sizes] = -1
        return context

    def score(self, texts: list[bytes]):
        """Per text: tokens, known tokens, base score, score (log10)."""
        hashes, sizes = token_hashes(texts)
        first = np.cumsum(sizes) - sizes
        total = lambda x: np.add.reduceat(x, first)
        if self.words is None:  # no training text: one word never seen, of probability 1
            none = np.zeros(len(texts))
            return sizes, none.astype(np.int64), none, none
        number, count = self.numbers(hashes)
        p1 = (count + 1) / (self.words.total + self.words.size + 1)
        p = p1
        if self.pairs is not None:
            place, p2, relative, backoff = self.pair_places(self.previous(number, sizes), number)
            p = p2 + backoff * p1
            if self.triples is not None:
                a, b, back = _distinct(self.pair_contexts(place, sizes), relative)
                _, p3, _, weight = self.triples.find(a, b, pointers=False)
                p = p3[back] + weight[back] * p
        release()
        return sizes, total((count > 0).astype(np.int64)), total(np.log10(p1)), total(np.log10(p))


# ---- counting: the sorted keys of a chunk travel as one block for each range of keys


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as an Elias-Fano sequence; counts as marks and values of those above one."""
    more = counts > 1
    rest = zlib.compress(np.packbits(more).tobytes() + counts[more].astype(np.int64).tobytes(), 1)
    return keys[:1].tobytes() + EliasFano.build(keys - keys[0], int(keys[-1] - keys[0]) + 1).to_bytes() + rest


def _unpack(n: int, block: bytes) -> tuple[np.ndarray, np.ndarray]:
    sequence, at = EliasFano.from_bytes(block[8:])
    rest = zlib.decompress(block[8 + at :])
    more = np.unpackbits(np.frombuffer(rest, np.uint8, -(-n // 8)), count=n).astype(bool)
    counts = np.ones(n, np.int64)
    counts[more] = np.frombuffer(rest, np.int64, offset=-(-n // 8))
    return sequence.values() + np.frombuffer(block, np.uint64, 1), counts


def _emit(keys_of):
    """Arrow function over (doc_id, text): blocks of the ranges and keys keys_of(texts), of training documents."""

    def run(batches):
        for b in batches:
            mask = pa.array([not held_out(x.as_py()) for x in b.column(0)])
            for _, texts in _pieces(b.filter(mask), 1):
                ranges, keys, counts = keys_of(texts)
                cut = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1]))).tolist() if ranges.size else []
                ends = [*cut[1:], ranges.size]
                blocks = [_pack(keys[x:y], counts[x:y]) for x, y in zip(cut, ends, strict=bool(cut))]
                release()
                if blocks:
                    yield pa.RecordBatch.from_arrays([pa.array(ranges[cut]), pa.array(np.subtract(ends, cut).astype(np.int32)), pa.array(blocks, pa.binary())], names=["range", "n", "block"])

    return run


def _reduce(write, least: int):
    """Arrow function over blocks sorted by range: write(range, keys, counts) of each, n-grams seen `least` times or more."""

    def add(held):
        keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(counts, first)

    def out(number, held):
        keys, counts = add(held)
        keep = counts >= least
        if keep.any():
            yield write(number, keys[keep], counts[keep])
            release()

    def run(batches):
        now, held, size = None, [], 0
        for b in batches:
            for number, n, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if number != now and held:
                    yield from out(now, held)
                    held, size = [], 0
                now = number
                held.append(_unpack(n, block.as_py()))
                size += n
                if size > 2 * SHARD:  # fold what has come so far
                    held = [add(held)]
                    size = held[0][0].size
        if held:
            yield from out(now, held)

    return run


def _made(docs: DataFrame, keys_of, ranges: int, write, schema: str, least: int) -> list:
    """Count the keys of the training documents, and write a shard for each range: the rows that write gives."""
    blocks = docs.mapInArrow(_emit(keys_of), "range long, n int, block binary")
    return blocks.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_reduce(write, least), schema).collect()


# ---- building the levels


def _row(values: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.struct(k)) if k else None) for v, k in values.values()], names=list(values))


_NEXT_CUTS = [("at", pa.int64()), ("piece", pa.int64()), ("pieces", pa.int64())]
_EDGES = [("context", pa.int64()), ("at", pa.int64()), ("kept", pa.float64()), ("total", pa.int64())]


def next_cuts(counts: np.ndarray, shard: int) -> list[dict]:
    """Where the next level is cut so that a range has about `shard` tokens: before the first successor of entry `at`,
    or, where an entry alone has more, at `piece` of its `pieces` parts."""
    mark = (np.cumsum(counts) - counts) // shard
    starts = np.flatnonzero(np.concatenate(([True], mark[1:] != mark[:-1])))
    out = [(i, 0, 1) for i in starts.tolist()]
    for i in np.flatnonzero(counts > shard).tolist():
        pieces = -(-int(counts[i]) // shard)
        out += [(i, j, pieces) for j in range(1, pieces)]
    return [dict(zip(("at", "piece", "pieces"), c, strict=True)) for c in sorted(out)]


def _cuts_of(made: list, bases: np.ndarray, width: int) -> Cuts:
    """The ranges of the next level from the cuts that the shards of this one gave (in the shards' order)."""
    at = [(base + c.at, width * c.piece // c.pieces) for r, base in zip(made, bases.tolist(), strict=True) for c in r.cuts]
    return Cuts(*(np.array(x, np.int64) for x in zip(*at, strict=True)))


def _write_words(folder: str, ranges: int, shard: int):
    def write(number: int, keys: np.ndarray, counts: np.ndarray):
        first = int(keys[0])
        parts = EliasFano.build(keys - keys[0], int(keys[-1]) - first + 1).parts("hash")
        sums = np.concatenate(([0], np.cumsum(counts)))
        parts |= EliasFano.build(sums, int(sums[-1]) + 1).parts("counts")
        write_level(f"{folder}/words-{number}.level", parts)
        return _row({"file": (number, None), "first": (str(first), None), "n": (keys.size, None), "tokens": (int(sums[-1]), None), "cuts": (next_cuts(counts, shard), _NEXT_CUTS)})

    return write


def _write_successors(folder: str, name: str, width: int, cuts: Cuts, denominators, shard: int, last: bool):
    """Writer of a shard; its row tells its first pair, the widest context, the contexts at its edges and where the next level is cut."""

    def write(number: int, keys: np.ndarray, c: np.ndarray):
        ctx, nxt = (keys // np.uint64(width)).astype(np.int64), (keys % np.uint64(width)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
        of = np.cumsum(np.concatenate(([False], ctx[1:] != ctx[:-1])))
        own = ctx[start]
        total = denominators(own + cuts.context[number])
        sizes = np.diff(np.concatenate((start, [ctx.size])))
        kept = np.add.reduceat(c, start) - DISCOUNT * sizes
        # contexts count from the range's first, as lookups do
        parts = EliasFano.build(own - own[0], int(own[-1] - own[0]) + 1).parts("context")
        parts |= EliasFano.build(start, ctx.size + 1).parts("pointers")
        parts |= EliasFano.build(of * width + nxt, own.size * width).parts("next")
        if not last:
            sums = np.concatenate(([0], np.cumsum(c)))
            parts |= EliasFano.build(sums, int(sums[-1]) + 1).parts("counts")
        parts["p"] = _code((c - DISCOUNT) / total[of])
        parts["backoff"] = _code(1 - kept / total)
        write_level(f"{folder}/{name}-{number}.level", parts)
        base = int(cuts.context[number])
        edges = [{"context": base + int(own[i]), "at": int(start[i]), "kept": float(kept[i]), "total": int(total[i])} for i in sorted({0, own.size - 1})]
        row = {"file": (number, None), "context": (base + int(own[0]), None), "successor": (int(nxt[0]), None), "n": (ctx.size, None), "widest": (int(sizes.max()), None)}
        return _row(row | {"edges": (edges, _EDGES), "cuts": ([] if last else next_cuts(c, shard), _NEXT_CUTS)})

    return write


_CUTS = "cuts array<struct<at: long, piece: long, pieces: long>>"
_SHARD_ROW = f"file long, context long, successor long, n long, widest long, edges array<struct<context: long, at: long, kept: double, total: long>>, {_CUTS}"


def _by_range(cuts: Cuts, width: int, ctx: np.ndarray, nxt: np.ndarray):
    """Ranges, keys and counts of pairs, in order. A key is (context - the range's first context) * width + successor."""
    a, b, back = _distinct(ctx, nxt)
    counts = np.bincount(back, minlength=a.size)
    ranges = cuts.of(a, b)
    return ranges, (a - cuts.context[ranges]).astype(np.uint64) * np.uint64(width) + b.astype(np.uint64), counts


def train(docs: DataFrame, folder: str | None = None, least: int = 1, shard: int = SHARD) -> Model:
    """Model of the training documents of docs (doc_id, text); its levels are files in the shared folder.

    Counts cover every training text in whole. What comes to the driver is a row per shard of a level: its first
    entry, and the first entries of the next level's shards.
    """
    spark = docs.sparkSession
    folder = _qualified(spark, folder or f"{shared_dir(spark)}/ngrams-{uuid.uuid4().hex}")
    docs = docs.select("doc_id", "text")
    volume = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(1, volume // (24 * shard))

    def word_keys(texts):
        keys, counts = np.unique(token_hashes(texts)[0], return_counts=True)
        at = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        return at, keys, counts

    made = _made(docs, word_keys, ranges, _write_words(folder, ranges, shard), f"file long, first string, n long, tokens long, {_CUTS}", 1)
    if not made:
        return Model(None)
    made = sorted(made, key=lambda r: r.file)
    firsts, sizes = np.array([int(r.first) for r in made], np.uint64), np.array([r.n for r in made], np.int64)
    words = Words(folder, np.array([r.file for r in made], np.int64), firsts, sizes, sum(r.tokens for r in made))
    one = Model(words)
    cuts = _cuts_of(made, words.bases, words.size)

    def pair_keys(texts):
        hashes, sizes = token_hashes(texts)
        number, _ = one.numbers(hashes)
        return _by_range(cuts, words.size, one.previous(number, sizes), number)

    made = _made(docs, pair_keys, cuts.context.size, _write_successors(folder, "pairs", words.size, cuts, words.counts, shard, False), _SHARD_ROW, least)
    if not made:
        return one
    pairs = Successors(folder, "pairs", words.size, made)
    two = Model(words, pairs)
    widest = _widest(made)
    cuts_ = _cuts_of(sorted(made, key=lambda r: r.file), pairs.bases, widest)

    def triple_keys(texts):
        hashes, sizes = token_hashes(texts)
        number, _ = two.numbers(hashes)
        place, _, relative, _ = two.pair_places(two.previous(number, sizes), number)
        context = two.pair_contexts(place, sizes)
        both = (context >= 0) & (relative >= 0)
        return _by_range(cuts_, widest, context[both], relative[both])

    made = _made(docs, triple_keys, cuts_.context.size, _write_successors(folder, "triples", widest, cuts_, pairs.counts, shard, True), _SHARD_ROW, least)
    return Model(words, pairs, Successors(folder, "triples", widest, made)) if made else two


def _widest(made: list) -> int:
    """Most successors that a context has, its parts in several shards together (an upper bound)."""
    parts: dict[int, int] = {}
    for r in made:
        for e in r.edges:
            parts[e.context] = parts.get(e.context, 0) + r.widest
    return max([r.widest for r in made] + list(parts.values()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts of any length are scored in whole. Null and empty texts are the end token alone. A null doc_id isn't held out. Repeated rows are repeated; an
    empty table gives none; without training documents every probability is 1.
    """
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        for b in batches:
            ids = b.column(0).cast(pa.int64())
            for first, texts in _pieces(b, 1):
                n, known, base, full = model.score(texts)
                own = ids.slice(first, len(texts))
                cols = [own, pa.array([held_out(x.as_py()) for x in own]), pa.array(n), pa.array(known), pa.array(np.full(n.size, model.words.total if model.words else 0, np.int64)), pa.array(base), pa.array(full)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_ngram_trie(spark, sf_dir: str) -> DataFrame:
    """Trigram and unigram log10 probability of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train(docs))
