"""Jobs on volumes that stay arrays: resampling through affines, distances, components, exact quantiles."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import components as graph
from panelforge.functions.affine import rigid, rotation
from panelforge.functions.distances import along, of_planes
from panelforge.functions.quantiles import exact_quantiles
from panelforge.functions.resampling import resampled, voxel_map
from panelforge.functions.shared import materialised
from panelforge.operators import aggregates
from panelforge.sources.adapters import GRID, LONG, DuckDialect, SparkDialect, run_sql

_DUCK = DuckDialect()


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan, label, values): each vector as a 4 x 4 x 4 volume."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("scan"), "label", F.col("embedding").cast("array<double>").alias("values"))


def _lit(xs) -> list[Column]:
    return [F.lit(float(x)) for x in xs]


# ---- resampling

#: The target grid, its affine, and a turn of the world about the first axis with a shift.
_TARGET, _ZOOM, _ORIGIN = (5, 4, 3), (0.8, 0.9, 1.1), (-0.45, 0.35, -0.15)
_TURN, _CENTRE, _SHIFT = 11.0, (1.2, 1.4, 1.6), (0.21, -0.13, 0.17)


def _mapped(scans: DataFrame) -> DataFrame:
    """With the map from the target's voxels to each scan's: a scan is turned about the third axis, and scaled, as its number and label say."""
    zoom = 1 + F.col("label") % 3 * 0.25
    linear = [[c * zoom for c in row] for row in rotation(F.lit(0.0), F.lit(0.0), (F.col("scan") % 24 * 15 + 7).cast("double"))]
    shift = [F.lit(0.3), F.lit(-0.2), 0.1 * (F.col("scan") % 5)]
    source = [[*linear[i], shift[i]] for i in range(3)]
    target = [[F.lit(float(_ZOOM[i]) if i == j else 0.0) for j in range(3)] + [F.lit(_ORIGIN[i])] for i in range(3)]
    world = rigid(rotation(F.lit(_TURN), F.lit(0.0), F.lit(0.0)), _lit(_SHIFT), _lit(_CENTRE))
    return scans.withColumn("map", voxel_map(source, target, world))


def _on_target(spark: SparkSession, sf_dir: str, values: Column, order: int, name: str) -> DataFrame:
    scans = _mapped(_scans(spark, sf_dir))
    found = scans.select("scan", F.posexplode(resampled(values, F.array(F.lit(4), F.lit(4), F.lit(4)), F.col("map"), _TARGET, order)).alias("p", name))
    _, b, c = _TARGET
    return found.select("scan", F.expr(f"p div {b * c}").cast("int").alias("i"), F.expr(f"p div {c} % {b}").cast("int").alias("j"), (F.col("p") % c).alias("k"), name)


def nn_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every scan on the target grid: 1000 and a tenth's number where a value is positive, else 0; 0 outside."""
    labels = F.transform("values", lambda x: F.when(x > 0, 1000.0 + F.floor(x * 10)).otherwise(0.0))
    return _on_target(spark, sf_dir, labels, 0, "label").withColumn("label", F.col("label").cast("int"))


def trilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every scan between its voxels, on the target grid."""
    return _on_target(spark, sf_dir, F.col("values"), 1, "sample").withColumn("sample", F.round("sample", 6) + 0.0)


_WHERE = f"""v AS (SELECT vec_id AS scan, label AS lab, embedding AS e, radians(vec_id % 24 * 15e0 + 7) AS a, 1 + label % 3 * 25e-2 AS zoom FROM embeddings),
t AS (SELECT i, j, k, {_ZOOM[0]} * i + {_ORIGIN[0]} AS x, {_ZOOM[1]} * j + {_ORIGIN[1]} - {_CENTRE[1]} AS y, {_ZOOM[2]} * k + {_ORIGIN[2]} - {_CENTRE[2]} AS z FROM range({_TARGET[0]}) a(i), range({_TARGET[1]}) b(j), range({_TARGET[2]}) c(k)),
w AS (SELECT i, j, k, x + {_SHIFT[0]} - 3e-1 AS x, cos(radians({_TURN})) * y - sin(radians({_TURN})) * z + {_CENTRE[1]} + {_SHIFT[1]} + 2e-1 AS y, sin(radians({_TURN})) * y + cos(radians({_TURN})) * z + {_CENTRE[2]} + {_SHIFT[2]} AS z FROM t),
s AS (SELECT scan, e, i, j, k, (cos(a) * x + sin(a) * y) / zoom AS x, (cos(a) * y - sin(a) * x) / zoom AS y, (z - 1e-1 * (scan % 5)) / zoom AS z FROM v, w),
f AS (SELECT *, x BETWEEN 0 AND 3 AND y BETWEEN 0 AND 3 AND z BETWEEN 0 AND 3 AS inside FROM s)"""
_NEAREST = f"""WITH {_WHERE}, p AS (SELECT *, e[CAST(16 * floor(x + 5e-1) + 4 * floor(y + 5e-1) + floor(z + 5e-1) AS INTEGER) + 1] AS value FROM f)
SELECT scan, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, CAST(CASE WHEN inside AND value > 0 THEN 1000 + floor(CAST(value AS DOUBLE) * 10) ELSE 0 END AS INTEGER) AS label FROM p"""
_BETWEEN = f"""WITH {_WHERE}, q AS (SELECT *, CAST(least(floor(x), 2) AS INTEGER) AS a, CAST(least(floor(y), 2) AS INTEGER) AS b, CAST(least(floor(z), 2) AS INTEGER) AS c FROM f WHERE inside),
r AS (SELECT scan, i, j, k, sum(CAST(e[16 * (a + da) + 4 * (b + db) + c + dc + 1] AS DOUBLE) * CASE da WHEN 1 THEN x - a ELSE 1 - (x - a) END * CASE db WHEN 1 THEN y - b ELSE 1 - (y - b) END * CASE dc WHEN 1 THEN z - c ELSE 1 - (z - c) END) AS sample
  FROM q, range(2) d(da), range(2) g(db), range(2) h(dc) GROUP BY scan, i, j, k)
SELECT scan, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, round(coalesce(sample, 0), 6) + 0e0 AS sample FROM f LEFT JOIN r USING (scan, i, j, k)"""


# ---- distances


def distances(volumes: DataFrame) -> DataFrame:
    """(scan, i, k, line): distance of each voxel to the nearest background voxel, a line over j, of volumes (scan, values, shape, spacing).

    Background: values of 0 or less, or null. Two axes are passed within a plane; planes are cut along the second axis once, as rows of
    voxels, for the third pass. What a task holds is planes. Volumes without background have infinite distances.
    """
    a, b, c = (F.col("shape")[i] for i in range(3))
    planes = volumes.select("scan", "shape", "spacing", F.posexplode(F.transform(F.sequence(F.lit(0), a - 1), lambda i: F.slice("values", i * b * c + 1, b * c))).alias("i", "plane"))
    kind = volumes.schema["scan"].dataType.simpleString()

    def within(parts):
        for part in parts:
            out = []
            for (rows, columns, h, w), some in part.groupby([part["shape"].map(lambda s: s[1]), part["shape"].map(lambda s: s[2]), part["spacing"].map(lambda s: s[1]), part["spacing"].map(lambda s: s[2])]):
                values = np.array(some["plane"].tolist(), float).reshape(-1, rows, columns)
                d = of_planes(np.where(values > 0, np.inf, 0.0), (h, w))
                for (scan, shape, spacing, i), plane in zip(some[["scan", "shape", "spacing", "i"]].itertuples(index=False), d, strict=True):
                    out += [(scan, shape[0], spacing[0], k, i, plane[:, k]) for k in range(columns)]
            yield pd.DataFrame(out, columns=["scan", "n", "step", "k", "i", "line"])

    lines = planes.mapInPandas(within, f"scan {kind}, n int, step double, k int, i int, line array<double>")
    cut = lines.groupBy("scan", "n", "step", "k").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("lines"))  # a plane

    def across(parts):
        for part in parts:
            out = []
            for scan, step, k, rows in part[["scan", "step", "k", "lines"]].itertuples(index=False):
                d = np.sqrt(along(np.array([r["line"] for r in rows]).T, step)).T
                out += [(scan, i, k, line) for i, line in enumerate(d)]
            yield pd.DataFrame(out, columns=["scan", "i", "k", "line"])

    return cut.mapInPandas(across, f"scan {kind}, i int, k int, line array<double>")


def edt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each positive voxel to the nearest background voxel of its scan, in voxels of 1 x 1.5 x 2."""
    scans = _scans(spark, sf_dir).select("scan", "values", F.array(*[F.lit(4)] * 3).alias("shape"), F.array(*_lit((1, 1.5, 2))).alias("spacing"))
    found = distances(scans).select("scan", "i", "k", F.posexplode("line").alias("j", "distance"))
    return found.where("distance > 0 AND distance < double('infinity')").select("scan", "i", "j", "k", F.round("distance", 6).alias("distance"))


# ---- components


def runs(volumes: DataFrame) -> DataFrame:
    """(scan, i, j, first, last): stretches of voxels in the mask along the third axis, from volumes (scan, mask array, shape)."""
    kind = volumes.schema["scan"].dataType.simpleString()

    def cut(parts):
        for part in parts:
            found = []
            for scan, mask, shape in part[["scan", "mask", "shape"]].itertuples(index=False):
                lines = np.asarray(mask, bool).reshape(-1, shape[2]).astype(np.int8)
                edges = np.diff(np.pad(lines, ((0, 0), (1, 1))), axis=1)
                (line, first), (_, after) = np.nonzero(edges == 1), np.nonzero(edges == -1)
                found.append(pd.DataFrame({"scan": scan, "i": line // shape[1], "j": line % shape[1], "first": first, "last": after - 1}))
            yield pd.concat(found) if found else pd.DataFrame(columns=["scan", "i", "j", "first", "last"])

    return volumes.select("scan", "mask", "shape").mapInPandas(cut, f"scan {kind}, i int, j int, first int, last int")


def clusters(volumes: DataFrame) -> DataFrame:
    """(scan, component, size) of the masks' components over faces, from volumes (scan, mask, shape): component is the least voxel number, row by row.

    Nodes are runs along the third axis; runs of neighbouring lines that overlap are linked, and the links contracted.
    """
    shapes = volumes.select("scan", F.col("shape")[1].alias("b"), F.col("shape")[2].alias("c"))
    own = runs(volumes).join(shapes, "scan").withColumn("node", F.struct("scan", ((F.col("i").cast("long") * F.col("b") + F.col("j")) * F.col("c") + F.col("first")).alias("p")))
    own = materialised(own.select("scan", "i", "j", "first", "last", "node"))
    near = own.select("scan", F.explode(F.array(F.struct((F.col("i") + 1).alias("i"), "j"), F.struct("i", (F.col("j") + 1).alias("j")))).alias("at"), F.col("first").alias("f"), F.col("last").alias("l"), F.col("node").alias("v"))
    near = near.select("scan", "at.i", "at.j", "f", "l", "v")
    edges = own.join(near, ["scan", "i", "j"]).where("first <= l AND f <= last").select(F.col("node").alias("u"), "v")
    roots = graph.components(edges)
    sized = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return sized.groupBy("scan", F.col("root.p").alias("component")).agg(F.sum(F.col("last") - F.col("first") + 1).alias("size"))


def components(spark: SparkSession, sf_dir: str, threshold: float = 0.25) -> DataFrame:
    """Connected components of each scan's mask."""
    scans = _scans(spark, sf_dir).select("scan", F.transform("values", lambda x: x > threshold).alias("mask"), F.array(*[F.lit(4)] * 3).alias("shape"))
    return clusters(scans).withColumn("component", F.col("component").cast("int"))


def component_shares(spark: SparkSession, sf_dir: str, large: int = 100) -> DataFrame:
    """Of four scans at a time, stacked along the first axis: components, the largest, and the share of the mask in those of `large` voxels or more."""
    stacks = _scans(spark, sf_dir).groupBy(F.floor(F.col("scan") / 4).alias("scan")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("scan").alias("n"), "values"))), lambda s: s["values"])).alias("values"), F.count("*").cast("int").alias("n"))
    masks = stacks.select("scan", F.transform("values", lambda x: x > -0.02).alias("mask"), F.array(4 * F.col("n"), F.lit(4), F.lit(4)).alias("shape"))
    sizes = clusters(masks)
    return sizes.groupBy(F.col("scan").alias("stack")).agg(F.count("*").alias("components"), F.max("size").alias("largest"), F.round(F.sum(F.when(F.col("size") >= large, F.col("size")).otherwise(0)) / F.sum("size"), 6).alias("share_large"))


_CLOSURE = """edge AS (SELECT a.scan, a.p, b.p AS q FROM mask a JOIN mask b ON a.scan = b.scan AND abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1),
reach AS (SELECT scan, p, p AS q FROM mask UNION SELECT reach.scan, reach.p, edge.q FROM reach JOIN edge ON edge.scan = reach.scan AND edge.p = reach.q),
least_ AS (SELECT scan, p, CAST(min(q) AS INTEGER) AS component FROM reach GROUP BY scan, p)"""


# ---- exact quantiles

_SHARES = {"p005": 0.005, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p995": 0.995}


def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the voxels of each label's scans, by linear interpolation."""
    values = _scans(spark, sf_dir).select(F.col("label").alias("grp"), F.explode("values").alias("value"))
    found = exact_quantiles(values, ["grp"], "value", list(_SHARES.values()))
    return found.groupBy("grp").agg(*[F.round(F.max(F.when(F.col("share") == s, F.col("value"))), 6).alias(n) for n, s in _SHARES.items()])


class _Selected(SparkDialect):
    """Spark's spellings, with quantiles that were selected beforehand: deciles in a view, the median as a number."""

    def __init__(self, view: str = "", middle: float | None = None):
        self.view, self.middle = view, middle

    def deciles(self, x: str) -> str:
        return f"SELECT * FROM {self.view}"

    def median(self, x: str) -> str:
        return f"CAST({self.middle!r} AS DOUBLE)" if self.middle is not None else "CAST(NULL AS DOUBLE)"


def _by_deciles(name: str, value: str):
    """The query of that name with each scan's deciles of value found by selection."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        values = _scans(spark, sf_dir).select("scan", F.explode("values").alias("value")).select("scan", F.expr(value).alias("value"))
        found = exact_quantiles(values, ["scan"], "value", [0.1, 0.9])
        share = lambda s: F.max(F.when(F.col("share") == s, F.col("value")))
        view = f"deciles_{uuid.uuid4().hex}"
        found.groupBy("scan").agg(share(0.1).alias("q10"), share(0.9).alias("q90")).createOrReplaceTempView(view)
        out = run_sql(spark, sf_dir, aggregates.BOOK[name](_Selected(view)))
        spark.catalog.dropTempView(view)
        return out

    return run


def validity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of the long table, with the median over all its rows found by selection."""
    long = materialised(run_sql(spark, sf_dir, f"WITH {LONG} SELECT cond_mean FROM long_table"))
    middle = exact_quantiles(long, [], "cond_mean", [0.5]).first()
    return run_sql(spark, sf_dir, aggregates.BOOK["validity_summary"](_Selected(middle=middle.value if middle else None)))


def _plain(name: str) -> str:
    return str(aggregates.BOOK[name](_DUCK))


#: name -> (job, SQL)
QUERIES = {
    "zero_scan": (_by_deciles("zero_scan", "greatest(value, 0D)"), _plain("zero_scan")),
    "decile_rates": (_by_deciles("decile_rates", "value"), _plain("decile_rates")),
    "validity_summary": (validity_summary, _plain("validity_summary")),
    "nn_resample": (nn_resample, _NEAREST),
    "trilinear_sample": (trilinear_sample, _BETWEEN),
    "exact_percentiles": (exact_percentiles, f"WITH {_DUCK.voxels}{GRID} SELECT grp, " + ", ".join(f"round({_DUCK.pct('value', p)}, 6) AS {n}" for n, p in _SHARES.items()) + " FROM grid GROUP BY grp"),
    "components": (components, f"""WITH RECURSIVE {_DUCK.voxels}{GRID}, mask AS (SELECT scan, i, j, k, p FROM grid WHERE value > 0.25),
{_CLOSURE} SELECT scan, component, count(*) AS size FROM least_ GROUP BY scan, component"""),
    "component_shares": (component_shares, f"""WITH RECURSIVE {_DUCK.voxels}{GRID}, n AS (SELECT scan // 4 AS stack, dense_rank() OVER (PARTITION BY scan // 4 ORDER BY scan) - 1 AS place, i, j, k, value FROM grid),
mask AS (SELECT stack AS scan, 4 * place + i AS i, j, k, 64 * place + 16 * i + 4 * j + k AS p FROM n WHERE value > -0.02),
{_CLOSURE}, sizes AS (SELECT scan, component, count(*) AS size FROM least_ GROUP BY scan, component)
SELECT scan AS stack, count(*) AS components, max(size) AS largest, round(sum(CASE WHEN size >= 100 THEN size ELSE 0 END) / CAST(sum(size) AS DOUBLE), 6) AS share_large FROM sizes GROUP BY scan"""),
    "edt": (edt, f"""WITH {_DUCK.voxels}{GRID}, b AS (SELECT scan, i, j, k FROM grid WHERE value <= 0)
SELECT g.scan, g.i, g.j, g.k, round(sqrt(CAST(min((g.i - b.i) * (g.i - b.i) + 225e-2 * (g.j - b.j) * (g.j - b.j) + 4 * (g.k - b.k) * (g.k - b.k)) AS DOUBLE)), 6) AS distance FROM grid g JOIN b ON b.scan = g.scan WHERE g.value > 0 GROUP BY g.scan, g.i, g.j, g.k"""),
}
