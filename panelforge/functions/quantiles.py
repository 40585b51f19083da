"""Exact quantiles of large groups by selection: counts by bracket, and only the brackets that hold a wanted rank are looked into."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.shared import materialised

#: Cuts of a bracket; a round leaves about this part of its rows.
CUTS = 32
#: Brackets (a row for each group and wanted rank) that may be broadcast.
SMALL = 100_000


def exact_quantiles(df: DataFrame, groups: list[str], value: str, shares: list[float]) -> DataFrame:
    """(groups..., n, share, value): exact quantiles, linear between the two ranks around (n - 1) * share, of the value's numbers (nulls and NaN left out).

    A wanted rank lies in a bracket of values, first the whole group. A round cuts each open bracket at approximate quantiles of
    its rows (mergeable sketches), counts what lies on and between the cuts, and keeps what holds the rank: a single
    value, however frequent, settles it. No group is gathered or sorted; rounds are logarithmic in the rows.
    """
    names = [f"__g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)], F.col(value).cast("double").alias("__x"))
    rows = materialised(rows.where("__x IS NOT NULL AND NOT isnan(__x)"))
    sizes = materialised(rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi")))
    wanted = sizes.select("*", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")).withColumn("h", (F.col("n") - 1) * F.col("share"))
    ends = F.explode(F.array(F.floor("h"), F.ceil("h")))
    open_ = materialised(wanted.select(*names, "lo", "hi", F.lit(0).cast("long").alias("below"), ends.alias("rank")).distinct())
    found = open_.where("lo = hi")
    open_ = open_.where("lo < hi")
    while not open_.isEmpty():
        brackets = open_.select(*names, "lo", "hi").distinct()
        if brackets.count() <= SMALL:
            brackets = F.broadcast(brackets)
        inside = _joined(rows, brackets, names).where("__x BETWEEN lo AND hi")
        cuts = inside.groupBy(*names, "lo", "hi").agg(F.array_distinct(F.percentile_approx("__x", [i / CUTS for i in range(1, CUTS)], 10_000)).alias("cuts"))
        cuts = materialised(cuts)
        if cuts.count() <= SMALL:
            cuts = F.broadcast(cuts)
        cut = _joined(rows, cuts, names).where("__x BETWEEN lo AND hi")
        place = 2 * F.size(F.filter("cuts", lambda c: c < F.col("__x"))) + F.array_contains("cuts", F.col("__x")).cast("int")
        counts = cut.groupBy(*names, "lo", "hi", place.alias("place")).agg(F.count("*").alias("c"), F.min("__x").alias("least"), F.max("__x").alias("most"))
        before = F.sum("c").over(Window.partitionBy(*names, "lo", "hi").orderBy("place")) - F.col("c")  # twice CUTS rows at most
        counts = counts.withColumn("before", before)
        mine = _joined(open_, counts.withColumnsRenamed({"lo": "__lo", "hi": "__hi"}), names).where("lo = __lo AND hi = __hi AND rank - below >= before AND rank - below < before + c")
        new = materialised(mine.select(*names, F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("before")).alias("below"), "rank"))
        found = found.unionByName(new.where("lo = hi"))
        open_ = new.where("lo < hi")
    at = lambda side: found.select(*names, F.col("rank").alias(side), F.col("lo").alias(f"v_{side}"))
    both = wanted.select(*names, "n", "share", "h", F.floor("h").alias("low"), F.ceil("h").alias("high"))
    both = _joined(both, at("low"), [*names, "low"])
    both = _joined(both, at("high"), [*names, "high"])
    out = F.when(F.col("v_low") == F.col("v_high"), F.col("v_low")).otherwise(F.col("v_low") + (F.col("h") - F.col("low")) * (F.col("v_high") - F.col("v_low")))
    return both.select(*[F.col(n).alias(g) for n, g in zip(names, groups, strict=True)], "n", "share", out.alias("value"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys that may be null; the right side's keys go."""
    right = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
    on = [left[k].eqNullSafe(right[f"{k}__r"]) for k in keys]
    return (left.join(right, on) if keys else left.crossJoin(right)).drop(*[f"{k}__r" for k in keys])
