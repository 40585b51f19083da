"""Phrase collocations: an FM-index per shard over word ids, counts summed across shards.

The words of a task's documents are dealt into shards of about SHARD words: a stream of numbers, 0 between pieces.
Phrases are found length by length. A shard gets back which of its phrases of d - 1 words are frequent over all
shards, keeps the words that they cover, and builds the Burrows-Wheeler transforms of the stream and of its
mirror image (sorted as deep as d words, which is as deep as they are searched). Each frequent phrase is an interval
in both; the interval's letters in the one are the words before the phrase, in the other the words after it.
A phrase of d words is kept if it is found both ways, so both of its parts are frequent: it travels with the ids of
the two phrases that it extends and its count. Shards deal their phrases into buckets by (prefix, suffix), as compressed columns of
numbers; a bucket sums the counts and gives the phrase its id. A shard's share of a phrase is one entry, so no phrase, however
common, has more of them than there are shards, and a bucket holds those of some BUCKET words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import mix64, stage

LEAST, LONGEST, RATIO, TOP = 100, 5, 100, 2000
#: Words of a shard; a piece is never cut, so one of more words makes a larger shard.
SHARD = 2_200_000
#: Words for each of the buckets in which phrases of all shards are summed.
BUCKET = 1 << 22
#: Words of a stored part of a shard's stream.
PART = 1 << 20
#: Shards that one task of the first pass may make.
SHARDS = 1 << 10
#: Parts into which each language is dealt before its best phrases are ranked.
DEAL = 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STOP = re.compile(rb"[.,;:!?\n\x0b\x0c\r]+")


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words of a text, with b"." (which no word holds) before each piece."""
    return (b". " + _STOP.sub(b" . ", text.translate(_LOWER))).split()


def _squeeze(x: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of numbers, place by place."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _spread(planes: np.ndarray) -> np.ndarray:
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<i8").ravel()


def pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Numbers (an array, and the bytes that each needs) of some columns, compressed."""
    return pa.compress(b"".join(_squeeze(x, size) for x, size in columns), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int, *sizes: int) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(blob, n * sum(sizes), codec="zstd", asbytes=True), np.uint8).reshape(sum(sizes), n)
    ends = np.cumsum(sizes)
    return [_spread(planes[e - size : e]) for e, size in zip(ends, sizes, strict=True)]


def _shards(size: int):
    """Arrow function over (lang, text): rows (shard, lang, word, n, pos) of each shard's words, and (shard, part, n, blob) of its stream."""
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), ("part", pa.int32()), ("blob", pa.binary())])

    def rows(**columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches):
        numbers, shard, own, held, total = None, -1, {}, [], 0

        def flush():
            stream = np.concatenate(held)
            n = np.bincount(stream, minlength=1 + sum(len(words) - 1 for words in own.values()))
            # the more common, the smaller its number: then the stream's upper bytes are few
            rank = np.concatenate(([0], 1 + np.argsort(-n[1:], kind="stable")))
            number = np.empty(n.size, np.int64)
            number[rank] = np.arange(n.size)
            stream, n = number[stream], n[rank]
            first = np.zeros(n.size, np.int64)
            first[stream[::-1]] = np.arange(stream.size - 1, -1, -1)
            for lang, words in own.items():
                at = number[np.fromiter(words.values(), np.int64, len(words))[1:]]
                for x in range(0, at.size, 1 << 16):
                    some = at[x : x + (1 << 16)]
                    named = [w.decode() for w in list(words)[1 + x : 1 + x + (1 << 16)]]
                    yield rows(shard=np.full(some.size, shard), lang=[lang] * some.size, word=named, n=n[some], pos=first[some])
            for part, x in enumerate(range(0, stream.size, PART)):
                cut = stream[x : x + PART]
                yield rows(shard=[shard], part=[part], n=[cut.size], blob=[pack((cut, 4))])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = tokens(text or b"")
                while len(found) > 1:
                    if not held:
                        numbers, shard, own, total = count(1), shard + 1, {}, 0
                        if shard >= SHARDS:
                            raise ValueError("a partition has too many words; read smaller ones")
                    room = max(size - total, size // 2)
                    cut = len(found)
                    if cut > room:  # a long text is cut between pieces
                        cut = next((i for i in range(room, 0, -1) if found[i] == b"."), 0) or next((i for i in range(room, cut) if found[i] == b"."), cut)
                    if lang not in own:
                        own[lang] = defaultdict(numbers.__next__, {b".": 0})
                    held.append(np.fromiter(map(own[lang].__getitem__, found[:cut]), np.int64, cut))
                    total, found = total + cut, found[cut:]
                    if total >= size:
                        yield from flush()
                        held = []
        if held:
            yield from flush()

    def numbered(batches):
        base = TaskContext.get().partitionId() * SHARDS
        for b in run(batches):
            yield b.set_column(0, "shard", pa.array(b.column(0).to_numpy() + base))

    return numbered


def _order(key: np.ndarray) -> np.ndarray:
    """Some order that sorts key. Where key and place fit one number, numbers are sorted, which is faster."""
    bits = key.size.bit_length()
    if int(key.max(initial=0)).bit_length() + bits > 63:
        return np.argsort(key)
    return np.sort((key << bits) | np.arange(key.size)) & ((1 << bits) - 1)


class FMIndex:
    """Burrows-Wheeler transform of a cyclic stream, its rotations sorted by their first `depth` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        self.n, self.symbols = text.size, int(text.max(initial=0)) + 1
        rank, known, order = text.astype(np.int64), 1, None
        while order is None or known < depth:
            step = min(known, max(depth - known, 0))
            key = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -step) if step else rank
            order = _order(key)
            known += step
            if known < depth:
                new = key[order]
                rank[order] = np.cumsum(np.concatenate(([False], new[1:] != new[:-1])))
        self.order, self.bwt = order.astype(np.int32), text[order - 1].astype(np.int32)
        self.ranked = np.sort(self.bwt * np.int64(self.n) + np.arange(self.n))

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Where the rotations begin that put `symbol` before those from `row` on: C[symbol] + Occ(symbol, row)."""
        return np.searchsorted(self.ranked, symbol * np.int64(self.n) + row)

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of some patterns (rows), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for symbol in patterns.T[::-1]:
            low, high = self.step(symbol, low), self.step(symbol, high)
        return low, high

    def before(self, low: np.ndarray, high: np.ndarray):
        """What precedes the rotations of some intervals: (interval, symbol, how many, how many of smaller symbols), sorted."""
        n = high - low
        starts = np.cumsum(n) - n
        key = np.sort(np.repeat(np.arange(n.size) * self.symbols, n) + self.bwt[np.arange(n.sum()) + np.repeat(low - starts, n)])
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if key.size else np.empty(0, np.int64)
        of, symbol = key[first] // self.symbols, key[first] % self.symbols
        return of, symbol, np.diff(np.append(first, key.size)), first - starts[of]


def pruned(stream: np.ndarray, pos: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The stream with 0 for the words that no phrase of `width` words like those at pos covers (but for a few, by chance), runs of 0 as one; where its words were."""
    h = np.zeros(stream.size - width + 1, np.uint64)
    for j in range(width):
        h = mix64(h + stream[j : j + h.size].astype(np.uint64))
    h = (h & np.uint64((1 << 22) - 1)).astype(np.int32)
    known = np.zeros(1 << 22, bool)
    known[h[pos]] = True
    hit, text = known[h], np.zeros(stream.size, np.int64)
    for j in range(width):
        at = slice(j, j + hit.size)
        text[at][hit] = stream[at][hit]
    keep = np.flatnonzero((text > 0) | np.concatenate(([True], text[:-1] > 0)))
    return text[keep], keep


def extend(stream: np.ndarray, pos: np.ndarray, d: int):
    """Phrases of d words both of whose parts are among the phrases of d - 1 words at pos, in a stream that these cover.

    Arrays: prefix and suffix (which of pos), n, position of one occurrence.
    """
    words = stream[pos[:, None] + np.arange(d - 1)]
    used = np.unique(words)
    remap = np.zeros(int(stream.max(initial=0)) + 1, np.int32)
    remap[used] = np.arange(1, used.size + 1, dtype=np.int32)
    text, words = remap[stream], remap[words].astype(np.int64)
    ahead = FMIndex(text, d)
    low, high = ahead.find(words)
    by = np.argsort(low)
    low, high, words = low[by], high[by], words[by]
    suffix, symbol, n, _ = ahead.before(low, high)
    real = symbol > 0
    suffix, n = suffix[real], n[real]
    left = ahead.step(symbol[real], low[suffix])
    order = ahead.order
    del ahead
    back = FMIndex(text[::-1], d)
    prefix, symbol, _, smaller = back.before(*back.find(words[:, ::-1]))
    real = symbol > 0
    prefix, right = prefix[real], (low[prefix] + smaller)[real]  # ascending, as low is
    at = np.minimum(np.searchsorted(right, left), max(right.size - 1, 0))
    both = np.flatnonzero(right[at] == left) if right.size else np.empty(0, np.int64)
    both = both[_order(at[both])]
    return by[prefix[at[both]]], by[suffix[both]], n[both], order[left[both]].astype(np.int64)


def _extender(d: int, buckets: int):
    """Cogroup function of a shard's stream and its frequent phrases of d - 1 words.

    Rows: its phrases of d words by bucket, packed, and (part not null, from the third word on) what is left of the stream.
    """

    def run(stream: pa.Table, known: pa.Table) -> pa.Table:
        rows = []
        if stream.num_rows and known.num_rows:
            shard = stream["shard"][0].as_py()
            parts = sorted(zip(stream["part"].to_pylist(), stream["n"].to_pylist(), stream["blob"].to_pylist(), strict=True))
            if "blob" in known.column_names:
                pos, ids = (np.concatenate(c) for c in zip(*[unpack(blob, n, 4, 8) for n, blob in zip(known["n"].to_pylist(), known["blob"].to_pylist(), strict=True)], strict=True))
            else:
                pos, ids = known["pos"].to_numpy(), known["id"].to_numpy()
            order = np.argsort(pos)  # so that a repeated task names the same occurrences
            pos, ids = pos[order], ids[order]
            text, kept = pruned(np.concatenate([unpack(blob, size, 4)[0] for _, size, blob in parts]), pos, d - 1)
            p, s, n, pos = extend(text, np.searchsorted(kept, pos), d)
            p, s, pos = ids[p], ids[s], kept[pos] if d == 2 else pos
            of = (mix64(mix64(p.view(np.uint64)) + s.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((s, p, of))
            p, s, n, pos, of = p[order], s[order], n[order], pos[order], of[order]
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if of.size else np.empty(0, np.int64)
            for x, y in zip(first, np.append(first, of.size)[1:], strict=True):
                rows.append((shard, int(of[x]), None, int(y - x), pack((p[x:y], 8), (s[x:y], 8), (pos[x:y], 4), (n[x:y], 4))))
            if d > 2:
                rows += [(shard, None, i, text[x : x + PART].size, pack((text[x : x + PART], 4))) for i, x in enumerate(range(0, text.size, PART))]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)], names=["shard", "bucket", "part", "n", "blob"])

    return run


def _adder(least: int):
    """Group function of a bucket's phrases from all shards.

    Rows: (p, s, f, id) of those counted `least` times or more, and (shard, n, blob) of where each shard has them: positions and ids, packed.
    """

    def run(packed: pa.Table) -> pa.Table:
        packed = packed.sort_by("shard")
        parts = [unpack(blob, n, 8, 8, 4, 4) for n, blob in zip(packed["n"].to_pylist(), packed["blob"].to_pylist(), strict=True)]
        p, s, pos, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        own = (np.repeat(packed["shard"].to_numpy(), packed["n"].to_numpy()) << 32) | pos
        order = np.lexsort((s, p))  # stable, so a phrase's first own is its least
        p, s, own, n = p[order], s[order], own[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (s[1:] != s[:-1]))))
        f, times = np.add.reduceat(n, first), np.diff(np.append(first, p.size))
        f, every = np.repeat(f, times), np.repeat(own[first], times)
        first = first[f[first] >= least]
        keep = np.flatnonzero(f >= least)
        own, same = own[keep], every[keep]
        order = np.argsort(own)
        own, same = own[order], same[order]
        shard = own >> 32
        cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if shard.size else np.empty(0, np.int64)
        places = [(shard[x], y - x, pack((own[x:y] & ((1 << 32) - 1), 4), (same[x:y], 8))) for x, y in zip(cut, np.append(cut, shard.size)[1:], strict=True)]
        phrases = pa.table({"p": p[first], "s": s[first], "f": f[first], "id": every[first]})
        shares = pa.table([pa.array([r[i] for r in places], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["shard", "n", "blob"])
        return pa.concat_tables([phrases, shares], promote_options="default").select(["p", "s", "f", "id", "shard", "n", "blob"])

    return run


def _frequent_words(rows: DataFrame, least: int) -> DataFrame:
    """Rows of words counted `least` times or more over all shards, with that number as f and an id of the word: its least own."""
    w = Window.partitionBy("lang", "word")
    return rows.withColumn("f", F.sum("n").over(w)).withColumn("id", F.min("own").over(w)).where(F.col("f") >= least).drop("n")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), exact: products are decimals of 38 digits."""
    d = "decimal(18,0)"
    wide = (F.lit(1000).cast(d) * a.cast(d)).cast("decimal(20,0)") * n.cast(d)
    return F.call_function("div", wide.cast("decimal(38,0)"), (left.cast(d) * right.cast(d)).cast("decimal(38,0)")).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, ratio: int = RATIO, size: int = SHARD) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): phrases of 2 to `longest` words that occur `least` times or more in a language of docs (lang, text).

    Words are lower-cased (A-Z), split at spaces and tabs; phrases lie within pieces, which end at .,;:!? and line
    breaks. Null languages are `und`, null texts empty; repeated rows count each; texts of any length are read in
    whole; an empty table gives none. The cut with the lowest score counts (ties: the first). A phrase is left out if it
    lies in a longer one with ratio * f(longer) >= 100 * f(phrase): then one that is a word longer has as many.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    shards = stage(rows.mapInArrow(_shards(size), "shard long, lang string, word string, n long, pos long, part int, blob binary"), "phrase-shards")
    streams = shards.where("blob is not null").select("shard", "part", "n", "blob")
    words = shards.where("word is not null").select("lang", "word", "n", F.shiftleft("shard", 32).bitwiseOR(F.col("pos")).alias("own"))
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    level = stage(_frequent_words(words, least), "phrase-1")
    buckets = max(1, -(-(total.agg(F.sum("n")).first()[0] or 0) // BUCKET))
    none = F.array().cast("array<long>")
    named = level.where("own = id").select("id", "lang", F.array("word").alias("words"), "f", none.alias("ls"), none.alias("rs"))
    known = level.select(F.shiftright("own", 32).alias("shard"), F.col("own").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"), "id")
    found = []
    for d in range(2, longest + 1):
        pairs = streams.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_extender(d, buckets), "shard long, bucket long, part int, n long, blob binary")
        if d > 2:
            pairs = stage(pairs, f"phrase-pairs-{d}")
            streams = pairs.where("part is not null").select("shard", "part", "n", "blob")
        packed = pairs.where("bucket is not null").select("bucket", "shard", "n", "blob")
        level = stage(packed.groupBy("bucket").applyInArrow(_adder(least), "p long, s long, f long, id long, shard long, n long, blob binary"), f"phrase-{d}")
        known = level.where("shard is not null").select("shard", "n", "blob")
        p = named.select(F.col("id").alias("p"), "lang", F.col("words").alias("pw"), F.col("f").alias("pf"), "ls")
        s = named.select(F.col("id").alias("s"), F.element_at("words", -1).alias("last"), F.col("f").alias("sf"), "rs")
        both = level.where("id is not null").select("id", "p", "s", "f").join(p, "p").join(s, "s")
        words_, ls, rs = F.concat("pw", F.array("last")), F.concat("ls", F.array("pf")), F.concat(F.array("sf"), "rs")
        nxt = stage(both.select("id", "lang", words_.alias("words"), "f", ls.alias("ls"), rs.alias("rs"), "p", "s", "pf", "sf"), f"phrase-named-{d}")
        if d > 2:
            full = F.lit(ratio) * F.col("f")
            within = nxt.where(full >= 100 * F.col("pf")).select(F.col("p").alias("id")).union(nxt.where(full >= 100 * F.col("sf")).select(F.col("s").alias("id")))
            found[-1] = found[-1].join(within.distinct(), "id", "left_anti")
        named = nxt.select("id", "lang", "words", "f", "ls", "rs")
        found.append(named)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = every.join(F.broadcast(total), "lang")  # a row a language
    cuts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(_score(F.col("f"), F.col("n"), F.element_at("ls", k), F.element_at("rs", k)).alias("score"), k.alias("k")))
    every = every.withColumn("cut", F.array_min(cuts))
    return every.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.element_at("ls", F.col("cut.k")).alias("l"), F.element_at("rs", F.col("cut.k")).alias("r"), "n", F.col("cut.score").alias("score"))


def best(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The `top` phrases of each language, with their rank. Each language is ranked in DEAL parts first, so no task sorts all of it."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(DEAL)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("part")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The best 2000 phrases of each language of the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    return best(collocations(docs)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
grams AS (
  SELECT lang, len, array_to_string(w[i:i + len - 1], ' ') AS phrase
  FROM (SELECT lang, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM split, (SELECT unnest(range(1, 6)) AS len) WHERE len(w) >= len)),
f AS (SELECT lang, len, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, len, phrase, f, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, len)) AS k FROM f WHERE len > 1)),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, h.f AS l, t.f AS r, n, k, CAST((1000::HUGEINT * c.f * n) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail JOIN total ON total.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, f, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len - m + 2)) AS i FROM (SELECT *, unnest(range(2, len)) AS m FROM f WHERE len > 2))),
inside AS (SELECT DISTINCT p.lang, p.phrase FROM parts p JOIN f ON f.lang = p.lang AND f.phrase = p.phrase WHERE 100 * p.f >= 100 * f.f),
kept AS (SELECT * FROM lowest l WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = l.lang AND i.phrase = l.phrase)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
