"""Alignment of each scan with its group's mean volume: profiles, mirrored control, bounded optimum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.affine import from_array
from panelforge.functions.alignment import AXES, Alignment, displacements, transform_of
from panelforge.sources.adapters import DuckDialect

_SHAPE, _BINS, _CLIP = (4, 4, 4), 6, (0.02, 0.98)
#: Offsets of the profiles: half voxels, and steps of 7 degrees; bounds of the search.
_SHIFTS, _DEGREES, _BOUNDS = [x / 2 for x in range(-3, 4)], [7.0 * x for x in range(-3, 4)], (2.0, 20.0)


def _points(kept) -> F.Column:
    """Voxels (structs x, y, z) of an array of 64 whose value is kept."""
    at = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.struct(F.floor(p / 16).cast("double").alias("x"), F.floor(p / 4 % 4).cast("double").alias("y"), (p % 4).cast("double").alias("z"), F.get("values", p).alias("v")))
    return F.filter(at, lambda s: kept(s["v"]))


def _alignment(spark: SparkSession, sf_dir: str) -> Alignment:
    """Each vector as a volume; the anatomy is the mean of its label's, the centre that of its positive voxels."""
    scans = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("scan"), "label", F.col("embedding").cast("array<double>").alias("values"))
    means = scans.groupBy("label").agg(F.array(*[F.avg(F.get("values", F.lit(i))) for i in range(64)]).alias("anatomy"))
    inside = _points(lambda v: v > 0)
    centre = F.array(*[F.aggregate(inside, F.lit(0.0), lambda s, p: s + p[c]) / F.size(inside) for c in "xyz"])  # noqa: B023
    return Alignment(scans.join(means, "label").withColumn("centre", centre), _SHAPE, _BINS, _CLIP)


def perturbation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NMI of each scan with its anatomy moved along and about every axis, and its difference from the unmoved one."""
    found = _alignment(spark, sf_dir)
    header = found.score(found.scans, found.unit, "header").select("scan", "header")
    rows = found.profiles(_SHIFTS, _DEGREES).join(header, "scan")
    return rows.select("scan", "axis", "offset", F.round("nmi", 6).alias("nmi"), (F.round(F.col("nmi") - F.col("header"), 6) + 0.0).alias("minus_header"))


def alignment_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NMI as given and mirrored, and the offset of each axis' greatest NMI (the first of equals)."""
    found = _alignment(spark, sf_dir)
    header = found.score(found.scans, found.unit, "header").select("scan", "header")
    best = found.profiles(_SHIFTS, _DEGREES).groupBy("scan").agg(*[F.min_by("offset", F.when(F.col("axis") == a, F.struct(-F.round("nmi", 9), "offset"))).alias(f"argmax_{a}") for a in AXES])
    rows = header.join(found.mirrored(), "scan").join(best, "scan")
    return rows.select("scan", F.round("header", 6).alias("nmi_header"), F.round("nmi", 6).alias("nmi_mirrored"), *[f"argmax_{a}" for a in AXES])


def alignment_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rigid transform of greatest NMI within bounds: parameters, gain, evaluations, and how far it moves the scan's positive voxels."""
    found = _alignment(spark, sf_dir)
    best = found.optimum(*_BOUNDS).join(found.scans.select("scan", "values", "centre"), "scan")
    m = transform_of([F.get("x", F.lit(i)) for i in range(6)], found.centre)
    best = best.withColumn("m", F.array(*[c for row in m for c in row])).withColumn("moved", displacements(_points(lambda v: v > 0), from_array("m")))
    return best.select("scan", "header", *[F.get("x", F.lit(i)).alias(a) for i, a in enumerate(AXES)], F.col("best").alias("nmi"), (F.col("best") - F.col("header")).alias("gain"), "evaluations", F.col("moved.mean").alias("mean_moved"), F.col("moved.most").alias("most_moved"))


# The oracle samples voxel by voxel through joins.
_V = DuckDialect()
_T = f"""v AS (SELECT vec_id AS scan, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT p, CAST(p // 16 AS DOUBLE) AS i, CAST(p // 4 % 4 AS DOUBLE) AS j, CAST(p % 4 AS DOUBLE) AS k FROM range(64) t(p)),
a AS (SELECT label, p, avg(e[p + 1]) AS x FROM v, p GROUP BY label, p),
l AS (SELECT label, list(x ORDER BY p) AS x, quantile_cont(x, {_CLIP[0]}) AS lo, quantile_cont(x, {_CLIP[1]}) AS hi FROM a GROUP BY label),
s AS (SELECT scan, label, e, ci, cj, ck, lo, hi FROM v JOIN (SELECT scan, avg(i) AS ci, avg(j) AS cj, avg(k) AS ck FROM v, p WHERE e[p + 1] > 0 GROUP BY scan) c USING (scan)
  JOIN (SELECT scan, quantile_cont(e[p + 1], {_CLIP[0]}) AS lo, quantile_cont(e[p + 1], {_CLIP[1]}) AS hi FROM v, p GROUP BY scan) q USING (scan)),
f AS (SELECT s.scan, label, p, i, j, k, ci, cj, ck, least(floor((e[p + 1] - lo) / (hi - lo) * {_BINS}), {_BINS - 1}) AS code FROM s, p WHERE e[p + 1] BETWEEN lo AND hi)"""


def _nmi_sql(places: str) -> str:
    """WITH relations down to `n` (scan, axis, o, nmi), from the FROM and SELECT that give x, y, z, axis and o of each voxel's place."""
    return f"""{_T}, t AS ({places}),
u AS (SELECT *, x BETWEEN 0 AND 3 AND y BETWEEN 0 AND 3 AND z BETWEEN 0 AND 3 AS inside, CAST(least(greatest(floor(x), 0), 2) AS INTEGER) AS a, CAST(least(greatest(floor(y), 0), 2) AS INTEGER) AS b, CAST(least(greatest(floor(z), 0), 2) AS INTEGER) AS c FROM t),
w AS (SELECT scan, axis, o, code, lo, hi, CASE WHEN inside THEN list_sum([l.x[16 * (a + d // 4) + 4 * (b + d // 2 % 2) + c + d % 2 + 1] * CASE d // 4 WHEN 1 THEN u.x - a ELSE 1 - (u.x - a) END * CASE d // 2 % 2 WHEN 1 THEN y - b ELSE 1 - (y - b) END
  * CASE d % 2 WHEN 1 THEN z - c ELSE 1 - (z - c) END for d in range(8)]) ELSE 0 END AS m FROM u JOIN l USING (label)),
g AS (SELECT scan, axis, o, code, least(floor((m - lo) / (hi - lo) * {_BINS}), {_BINS - 1}) AS other FROM w WHERE m BETWEEN lo AND hi),
h AS (SELECT scan, axis, o, code, other, count(*) AS n FROM g GROUP BY ALL),
h1 AS (SELECT scan, axis, o, sum(n) AS n, sum(n * ln(n)) AS s FROM h GROUP BY ALL),
h2 AS (SELECT scan, axis, o, sum(n * ln(n)) AS s FROM (SELECT scan, axis, o, code, sum(n) AS n FROM h GROUP BY ALL) GROUP BY ALL),
h3 AS (SELECT scan, axis, o, sum(n * ln(n)) AS s FROM (SELECT scan, axis, o, other, sum(n) AS n FROM h GROUP BY ALL) GROUP BY ALL),
n AS (SELECT scan, axis, o, (2 * ln(h1.n) - h2.s / h1.n - h3.s / h1.n) / (ln(h1.n) - h1.s / h1.n) AS nmi FROM h1 JOIN h2 USING (scan, axis, o) JOIN h3 USING (scan, axis, o) WHERE ln(h1.n) - h1.s / h1.n > 0)"""


def _turned(u: str, v: str, cu: str, cv: str) -> tuple[str, str]:
    return f"co * {u} - si * {v} + ({cu} - (co * {cu} - si * {cv}))", f"si * {u} + co * {v} + ({cv} - (si * {cu} + co * {cv}))"


_YZ, _ZX, _XY = _turned("j", "k", "cj", "ck"), _turned("k", "i", "ck", "ci"), _turned("i", "j", "ci", "cj")
_PLACES = f"""SELECT scan, label, axis, o, code,
  CASE axis WHEN 'tx' THEN i + o WHEN 'ry' THEN {_ZX[1]} WHEN 'rz' THEN {_XY[0]} ELSE i END AS x, CASE axis WHEN 'ty' THEN j + o WHEN 'rx' THEN {_YZ[0]} WHEN 'rz' THEN {_XY[1]} ELSE j END AS y,
  CASE axis WHEN 'tz' THEN k + o WHEN 'rx' THEN {_YZ[1]} WHEN 'ry' THEN {_ZX[0]} ELSE k END AS z
  FROM f, (SELECT axis, CASE WHEN axis LIKE 't%' THEN r / 2e0 ELSE r * 7e0 END AS o, cos(radians(r * 7e0)) AS co, sin(radians(r * 7e0)) AS si FROM range(-3, 4) r(r), (VALUES ('tx'), ('ty'), ('tz'), ('rx'), ('ry'), ('rz')) AS b(axis)) m"""
_MIRROR = "SELECT scan, label, 'mirror' AS axis, 0e0 AS o, code, -i + 2 * ci AS x, j AS y, k AS z FROM f UNION ALL SELECT scan, label, 'header', 0e0, code, i, j, k FROM f"

#: name -> (job, SQL)
QUERIES = {
    "perturbation_profile": (perturbation_profile, f"WITH {_nmi_sql(_PLACES)} SELECT scan, axis, o AS \"offset\", round(nmi, 6) AS nmi, round(nmi - max(CASE WHEN axis = 'tx' AND o = 0 THEN nmi END) OVER (PARTITION BY scan), 6) + 0e0 AS minus_header FROM n"),
    "alignment_control": (alignment_control, f"""WITH {_nmi_sql(_PLACES + " UNION ALL " + _MIRROR)}, r AS (SELECT scan, axis, o, nmi, row_number() OVER (PARTITION BY scan, axis ORDER BY round(nmi, 9) DESC, o) AS place FROM n)
SELECT scan, round(max(CASE WHEN axis = 'header' THEN nmi END), 6) AS nmi_header, round(max(CASE WHEN axis = 'mirror' THEN nmi END), 6) AS nmi_mirrored, {", ".join(f"max(CASE WHEN axis = '{a}' AND place = 1 THEN o END) AS argmax_{a}" for a in AXES)} FROM r GROUP BY scan"""),
    "alignment_optimum": (alignment_optimum, None),
}
