"""Linear transform texts: kind, matrix and the geometries on both sides, parsed in the JVM, and normalised to world coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.affine import as_columns, compose, from_array, inverse, vox2ras

#: Kinds of transform.
VOX2VOX, RAS2RAS = 0, 1
_FIELDS = ("volume", "voxelsize", "xras", "yras", "zras", "cras")


def _numbers(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))


def parse_transforms(texts: DataFrame) -> DataFrame:
    """texts (text and any others) with kind, matrix (16 numbers) and src and dst (structs of the six geometry fields).

    What can't be read is null: kind or matrix null means that the text is no transform.
    """
    whole = F.regexp_replace("text", r"\r\n", "\n")
    matrix = _numbers(F.regexp_extract(whole, r"(?m)^[ \t]*1 4 4[ \t]*\n((?:.*\n?){4})", 1))
    src = F.regexp_extract(whole, r"(?s)src volume info(.*?)(?:dst volume info|$)", 1)
    dst = F.regexp_extract(whole, r"(?s)dst volume info(.*)$", 1)
    side = lambda part: F.struct(*[_numbers(F.regexp_extract(part, rf"(?m)^[ \t]*{name}[ \t]*=([^#\n]*)", 1)).alias(name) for name in _FIELDS])
    kind = F.regexp_extract(whole, r"(?m)^[ \t]*type[ \t]*=[ \t]*(-?[0-9]+)", 1).try_cast("int")
    good = (F.size(matrix) == 16) & F.forall(matrix, lambda x: x.isNotNull())
    return texts.select("*", kind.alias("kind"), F.when(good, matrix).alias("matrix"), side(src).alias("src"), side(dst).alias("dst"))


def world_transforms(parsed: DataFrame, *keep: str) -> DataFrame:
    """(keep..., kind, m00 .. m23): each transform from source to target in world coordinates; null for other kinds than the two known."""

    def geometry(side: str):
        at = lambda field, i: F.get(F.col(f"{side}.{field}"), F.lit(i))
        three = lambda field: [at(field, i) for i in range(3)]
        cosines = [[at(axis, i) for axis in ("xras", "yras", "zras")] for i in range(3)]
        return vox2ras(three("volume"), three("voxelsize"), cosines, three("cras"))

    names = lambda p: [f"{p}{i}{j}" for i in range(3) for j in range(4)]
    matrix = lambda p: [[F.col(f"{p}{i}{j}") for j in range(4)] for i in range(3)]
    flat = lambda m: [c for row in m for c in row]
    steps = parsed.select(*keep, "kind", *[c.alias(n) for p, m in (("s", geometry("src")), ("d", geometry("dst")), ("t", from_array("matrix"))) for c, n in zip(flat(m), names(p), strict=True)])
    steps = steps.select(*keep, "kind", *names("d"), *names("t"), *[c.alias(n) for c, n in zip(flat(inverse(matrix("s"))), names("i"), strict=True)])
    steps = steps.select(*keep, "kind", *names("d"), *names("t"), *[c.alias(n) for c, n in zip(flat(compose(matrix("t"), matrix("i"))), names("u"), strict=True)])
    mapped = compose(matrix("d"), matrix("u"))
    chosen = [[F.when(F.col("kind") == RAS2RAS, t).when(F.col("kind") == VOX2VOX, m) for t, m in zip(a, b, strict=True)] for a, b in zip(matrix("t"), mapped, strict=True)]
    return steps.select(*keep, "kind", *as_columns(chosen))
