"""Region statistics texts: header checks, units, positional columns, one row a region; every fault is named, none repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.contracts import ContractError

#: Units that the columns must have, and the annotation's file name.
UNITS = {"ThickAvg": "mm", "SurfArea": "mm^2"}
ANNOTATION = "aparc.annot"


def parse_region_statistics(texts: DataFrame, roster: DataFrame) -> DataFrame:
    """(subject, hemi, roi, ord, thickness, area, problem) from texts (subject, hemi, text) and a roster (hemi, structure, roi, ord).

    Comment lines carry `key value` pairs (the first of a key counts), `TableCol` lines the columns' units and one
    `ColHeaders` line their order. A text whose header, units or columns are wrong gives one row that names the
    first fault; a data line that is malformed, unknown, repeated or out of range, and a region that is missing,
    give a row with the fault as well. Sound regions have a null problem.
    """
    lines = texts.select("subject", "hemi", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    comment = F.startswith("line", F.lit("#"))
    body = F.trim(F.substring("line", 2, 1 << 20))
    words = F.split(body, r"\s+")
    notes = lines.where(comment & (body != "")).select("subject", "hemi", "line_no", body.alias("body"), words.alias("w"))
    one = lambda key: F.trim(F.substring(F.min_by("body", F.when(F.get("w", F.lit(0)) == key, F.col("line_no"))), len(key) + 1, 1 << 20))
    is_unit = (F.get("w", F.lit(0)) == "TableCol") & (F.size("w") >= 4)
    column = F.when(is_unit & F.get("w", F.lit(2)).isin("ColHeader", "Units"), F.struct(F.get("w", F.lit(1)).alias("no"), F.get("w", F.lit(2)).alias("what"), F.array_join(F.slice("w", 4, 99), " ").alias("is")))
    head = notes.groupBy("subject", "hemi").agg(
        one("hemi").alias("h"), one("subjectname").alias("s"), one("AnnotationFile").alias("annotation"), one("cmdline").alias("cmdline"),
        F.collect_list(column).alias("columns"), F.count_if(F.get("w", F.lit(0)) == "ColHeaders").alias("n_headers"),
        F.min_by("w", F.when(F.get("w", F.lit(0)) == "ColHeaders", F.col("line_no"))).alias("order"),
    )

    def unit_of(name: str):
        named = F.filter("columns", lambda c: (c["what"] == "ColHeader") & (c["is"] == name))
        return F.get(F.filter("columns", lambda c: (c["what"] == "Units") & (c["no"] == F.get(named, F.lit(0))["no"])), F.lit(0))["is"]

    fault = F.when(~F.col("h").eqNullSafe(F.col("hemi")) | ~F.col("s").eqNullSafe(F.col("subject")), "header mismatch")
    fault = fault.when(~F.coalesce(F.endswith("annotation", F.concat("hemi", F.lit(f".{ANNOTATION}"))), F.lit(False)), "annotation")
    fault = fault.when(~F.coalesce(F.endswith("cmdline", F.concat_ws(" ", F.lit(""), "subject", "hemi", F.lit("white"))), F.lit(False)), "surface")
    for name, unit in UNITS.items():
        fault = fault.when(~unit_of(name).eqNullSafe(F.lit(unit)), f"units of {name}")
    fault = fault.when(F.col("n_headers") != 1, "column headers")
    place = lambda name: F.array_position("order", name) - 2  # noqa: E731  # ColHeaders itself comes first
    head = texts.select("subject", "hemi").join(head, ["subject", "hemi"], "left").select(
        "subject", "hemi", fault.alias("fault"), (F.size("order") - 1).alias("width"), place("StructName").alias("at_name"), place("SurfArea").alias("at_area"), place("ThickAvg").alias("at_thick"),
    )
    broken = head.where("fault is not null").select("subject", "hemi", F.lit(None).cast("string").alias("roi"), F.lit(None).cast("long").alias("ord"), *[F.lit(None).cast("double").alias(c) for c in ("thickness", "area")], F.col("fault").alias("problem"))

    data = lines.where(~comment & (F.trim("line") != "")).join(head.where("fault is null"), ["subject", "hemi"])
    f = F.split(F.trim("line"), r"\s+")
    number = lambda at: F.get(f, F.col(at).cast("int")).try_cast("double")
    rows = data.select("subject", "hemi", "line_no", (F.size(f) == F.col("width")).alias("whole"), F.get(f, F.col("at_name").cast("int")).alias("structure"), number("at_thick").alias("thickness"), number("at_area").alias("area"))
    again = rows.where("whole").groupBy("subject", "hemi", "structure").agg(F.min("line_no").alias("first"))
    rows = rows.join(again, ["subject", "hemi", "structure"], "left").join(roster.withColumn("known", F.lit(True)), ["hemi", "structure"], "left")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    problem = F.when(~F.col("whole"), "malformed row").when(F.col("known").isNull(), "unknown region").when(F.col("line_no") > F.col("first"), "repeated region")
    problem = problem.when(~(finite("thickness") & finite("area")), "not finite").when(F.col("area") <= 0, "area not positive")
    rows = rows.select("subject", "hemi", "roi", "ord", "thickness", "area", problem.alias("problem"))
    wanted = head.where("fault is null").select("subject", "hemi").join(roster, "hemi")
    missing = wanted.join(again, ["subject", "hemi", "structure"], "left_anti").select("subject", "hemi", "roi", "ord", *[F.lit(None).cast("double").alias(c) for c in ("thickness", "area")], F.lit("missing region").alias("problem"))
    return rows.unionByName(missing).unionByName(broken)


def region_statistics(texts: DataFrame, roster: DataFrame) -> DataFrame:
    """(subject, hemi, roi, ord, thickness, area); raises if any text has a problem."""
    rows = parse_region_statistics(texts, roster)
    bad = rows.where("problem is not null").groupBy("problem").count().orderBy("problem").limit(20).collect()
    if bad:
        raise ContractError("statistics texts: " + ", ".join(f"{r['count']} x {r.problem}" for r in bad))
    return rows.drop("problem")
