"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

A row's expected number of copies is its source's target over its source's size. The whole part is taken for
sure; the fraction is rounded so that each row keeps its probability while the words taken from the source stay
near the target: two fractions exchange mass (fraction times size) at random until one of them is 0 or 1, and
the other, still fractional, meets the next. Blocks of about 256 rows do this first; what each block leaves
over (one fraction) is combined 256 blocks at a time, level by level, until one fraction a source is left.
The fraction that is left last belongs to a long document, as short ones can't take up its mass. So documents are
drawn in classes of length, long ones first, and each class makes up for what the longer ones missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import checkpoint, row_hash, stage, unit_hash, word_count

#: Rows (or residuals) that one node of the reduction tree combines, on average.
FAN_IN = 256
#: Sources whose table (a row each) may be broadcast.
SMALL = 10_000
#: A class spans lengths within a factor of 2 ** CLASS_BITS.
CLASS_BITS = 4


def water_fill(sources: DataFrame, cap: float = 3.0) -> DataFrame:
    """sources (source, source_size, weight) with target: shares of the total by weight, none above cap x size.

    The excess of capped sources is shared by weight among the others until none is above. One row a source:
    the unpartitioned windows run over sources, not documents.
    """
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = sources.withColumn("cap", F.lit(cap) * F.col("source_size"))
    before = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - before) / rest)
    s = s.withColumn("place", F.row_number().over(by_room))
    # capped sources come first in this order; the first that is not capped tells the common level
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    s = s.withColumn("first", F.min(fits).over(everything))
    target = F.when(F.col("place") >= F.col("first.place"), F.col("first.level") * F.col("weight")).otherwise(F.col("cap"))
    return s.withColumn("target", target).drop("cap", "level", "place", "first")


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pivot(acc: Column, x: Column, seed: int) -> Column:
    """One exchange between the carried unit and the next; the one that became whole goes to `done`."""
    c = acc["carry"]

    def moved(unit: Column, p: Column) -> Column:
        return unit.withField("p", p)

    def exchange(v: Column) -> Column:
        up = v["u"] * (v["gain"] + v["lose"]) < v["lose"]
        c_fills = (1 - c["p"]) * c["size"] <= x["p"] * x["size"]
        c_empties = c["p"] * c["size"] <= (1 - x["p"]) * x["size"]
        return (
            F.when(up & c_fills, F.struct(moved(x, x["p"] - v["gain"] / x["size"]).alias("carry"), moved(c, F.lit(1.0)).alias("done")))
            .when(up, F.struct(moved(c, c["p"] + v["gain"] / c["size"]).alias("carry"), moved(x, F.lit(0.0)).alias("done")))
            .when(c_empties, F.struct(moved(x, x["p"] + v["lose"] / x["size"]).alias("carry"), moved(c, F.lit(0.0)).alias("done")))
            .otherwise(F.struct(moved(c, c["p"] - v["lose"] / c["size"]).alias("carry"), moved(x, F.lit(1.0)).alias("done")))
        )

    v = F.struct(
        F.least((1 - c["p"]) * c["size"], x["p"] * x["size"]).alias("gain"),
        F.least(c["p"] * c["size"], (1 - x["p"]) * x["size"]).alias("lose"),
        unit_hash(F.lit(seed), c["key"], x["key"], c["p"]).alias("u"),
    )
    step = _let(v, exchange)
    grown = _let(step, lambda s: F.struct(s["carry"].alias("carry"), F.concat(acc["done"], F.array(s["done"])).alias("done")))
    return F.when(c.isNull(), F.struct(x.alias("carry"), acc["done"].alias("done"))).otherwise(grown)


def _combine(level: DataFrame, seed: int) -> DataFrame:
    """Fold each node (source_no, node): what is decided, and the one unit left fractional."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("unit.size")).alias("large"), F.xxhash64(F.lit(seed), "unit.key").alias("mixed"), "unit")))
    nodes = level.groupBy("source_no", "node").agg(F.transform(items, lambda i: i["unit"]).alias("units"))
    unit = nodes.schema["units"].dataType.elementType
    start = F.struct(F.lit(None).cast(unit).alias("carry"), F.array().cast(nodes.schema["units"].dataType).alias("done"))
    return nodes.select("source_no", "node", F.aggregate("units", start, lambda acc, x: _pivot(acc, x, seed)).alias("r"))


def copies(units: DataFrame, seed: int = 17, n: int | None = None) -> DataFrame:
    """Whole copies of units (key long, source_no, size > 0, p in (0, 1), any more columns): adds take (0 or 1).

    n: nodes that the largest source is dealt to, if known; then units carry their source's number as n_nodes.

    Within each source_no the words taken, sum(take x size), miss sum(p x size) by less than one unit's size.
    """
    rest = [c for c in units.columns if c not in ("source_no", "node", "n_nodes")]
    if n is None:
        nodes = checkpoint(units.groupBy("source_no").agg(F.ceil(F.count("*") / FAN_IN).alias("n_nodes")))
        n, sources = nodes.agg(F.coalesce(F.max("n_nodes"), F.lit(0)), F.count("*")).first()
        units = units.join(F.broadcast(nodes) if sources <= SMALL else nodes, "source_no")
    placed = units.withColumn("node", F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("n_nodes")))
    placed = placed.repartition("source_no", "node")  # by node, even where the join dealt rows by source
    level = placed.select("source_no", "node", F.struct(*rest).alias("unit"))
    decided = []
    while True:
        done = checkpoint(_combine(level, seed))
        decided.append(done.select("source_no", F.explode("r.done").alias("unit")).select("source_no", "unit.*", F.col("unit.p").alias("take")))
        level = done.select("source_no", F.floor(F.col("node") / FAN_IN).alias("node"), F.col("r.carry").alias("unit"))
        if n <= 1:
            break
        n, seed = -(-n // FAN_IN), seed + 1
    last = level.where("unit is not null").select("source_no", "unit.*", (unit_hash(F.lit(seed), "unit.key") < F.col("unit.p")).cast("double").alias("take"))
    out = last
    for d in decided:
        out = out.unionByName(d)
    return out.withColumn("take", F.col("take").cast("int"))


def mix(docs: DataFrame, weights=None, cap: float = 3.0, seed: int = 17) -> DataFrame:
    """One row for each distinct row of docs: doc_id, source, size, hash, n, source_size, target, copies.

    docs needs doc_id, text and source. Rows that repeat in full form one unit of n rows whose copies are drawn
    together (a group of any size weighs one row in the tree). Null sources are one source, ordered last; null
    and empty texts have size 0: they take no words and are kept once. weights: function of the sources
    DataFrame (source, source_size, source_no) that adds `weight` > 0; default 1, 2, 3, repeating in code point
    order. Empty tables give empty results. The draw hangs on (seed, row hash) alone, so reruns agree.

    Units are rounded class by class, the longest documents first (a class spans a factor of sixteen in length).
    The rate of a class is what is left of its source's target over the words of all documents not yet drawn, so
    what the rounding of long documents missed is spread over all shorter ones in proportion. The miss has mean
    zero, hence each document's expected copies are its source's rate as long as no rate is cut off at 0 or cap.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(docs).alias("hash"))
    units = rows.groupBy("doc_id", "source", "size", "hash").agg(F.count("*").alias("n"))
    units = units.withColumn("class", F.floor(F.log2(F.greatest("size", F.lit(1))) / CLASS_BITS).cast("int"))
    units = stage(units, "mix-units", "class")
    classes = units.groupBy("source", "class").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.ceil(F.count("*") / FAN_IN).alias("n_nodes"))
    classes = checkpoint(classes)  # a row per source and class
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = sources.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    sources = weights(sources) if weights else sources.withColumn("weight", (F.col("source_no") - 1) % 3 + 1)
    sources = checkpoint(water_fill(sources, cap))
    few = sources.count() <= SMALL  # a row a source; beyond that the joins shuffle
    keep = ["doc_id", "source", "size", "hash", "n", "source_size", "target"]
    found, taken = [], None
    for k, nodes in classes.groupBy("class").agg(F.max("n_nodes")).orderBy(F.desc("class")).collect():  # at most 16 classes
        open_ = classes.where(F.col("class") <= k).groupBy(F.col("source").alias("s")).agg(F.sum("words").alias("open_words"), F.max(F.when(F.col("class") == k, F.col("n_nodes"))).alias("n_nodes"))
        rates = sources.join(open_, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        if taken is not None:
            rates = rates.join(taken.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        left = F.col("target") - (F.coalesce("taken", F.lit(0)) if taken is not None else F.lit(0))
        rates = rates.select(F.col("source").alias("s"), "source_no", "source_size", "target", "n_nodes", F.least(F.greatest(F.try_divide(left, F.col("open_words")), F.lit(0.0)), F.lit(cap)).alias("rate"))
        drawn = stage(_draw(units.where(F.col("class") == k), F.broadcast(rates) if few else rates, keep, seed + 1000 * k, nodes), f"mix-class-{k}")
        found.append(drawn)
        now = drawn.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
        taken = now if taken is None else now.unionByName(taken).groupBy("source").agg(F.sum("taken").alias("taken"))
    if not found:
        return units.join(sources, "source").withColumn("copies", F.lit(0).cast("long")).select(*keep, "copies")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _draw(units: DataFrame, rates: DataFrame, keep: list[str], seed: int, nodes: int) -> DataFrame:
    """Units of one class with copies: whole parts of rate x n for sure, fractions by pivotal rounding."""
    u = units.join(rates, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    u = u.withColumn("expected", F.when(F.col("size") > 0, F.col("rate") * F.col("n")).otherwise(F.col("n").cast("double")))
    u = u.withColumn("base", F.floor("expected")).withColumn("p", F.col("expected") - F.col("base"))
    u = u.withColumn("key", F.xxhash64("doc_id", "hash", "source", "size"))
    whole = u.where("p <= 0").select(*keep, F.col("base").alias("copies"))
    open_ = copies(u.where("p > 0").select("key", "source_no", "n_nodes", "p", "base", *keep), seed, nodes)
    return whole.unionByName(open_.select(*keep, (F.col("base") + F.col("take")).alias("copies")))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document. Rows of a repeated row share its copies as evenly as they go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    m = mix(docs).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    own = F.floor(F.col("copies") / F.col("n")) + (F.col("k") <= F.col("copies") % F.col("n")).cast("long")
    return m.select("doc_id", "size", "source_size", "target", (own * F.col("size")).cast("long").alias("taken"), "source")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus itself: each row of docs as often as the mix takes it (columns of docs)."""
    m = mix(docs, **how).where("copies > 0").select("doc_id", "source", "size", "hash", "n", "copies")
    m = m.withColumnsRenamed({c: f"__{c}" for c in m.columns})
    rows = docs.withColumn("__key", row_hash(docs)).join(m, (F.col("__key") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")))
    again = rows.where("__n > 1").dropDuplicates(["__key", "__doc_id"])
    out = rows.where("__n = 1").unionByName(again)
    return out.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies").cast("long")))).select(*[F.col(f"`{c}`") for c in docs.columns])
