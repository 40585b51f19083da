"""How the given tables play the roles of the analysis: panels, grids, manifests, rosters (as SQL relations).

Every relation is a fragment for a WITH list. A dialect object supplies the few spellings in which Spark SQL and
the oracle's SQL differ, so one definition serves both engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


class SparkDialect:
    name = "spark"

    def pct(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    def deciles(self, x: str) -> str:
        """Relation (scan, q10, q90) of the grid's values."""
        return f"SELECT scan, {self.pct(x, 0.1)} AS q10, {self.pct(x, 0.9)} AS q90 FROM grid GROUP BY scan"

    def median(self, x: str) -> str:
        """Median over all rows of the query."""
        return self.pct(x, 0.5)

    def joined(self, x: str, order: str | None = None, sep: str = ";") -> str:
        return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order or x})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def sha1(self, x: str) -> str:
        return f"sha1({x})"

    def first_by(self, x: str, order: str) -> str:
        return f"min_by({x}, {order})"

    def last_by(self, x: str, order: str) -> str:
        return f"max_by({x}, {order})"

    def json_long(self, x: str, key: str) -> str:
        return f"CAST(get_json_object({x}, '$.{key}') AS BIGINT)"

    def series(self, low: int, high: int, name: str = "n") -> str:
        return f"SELECT explode(sequence({low}, {high})) AS {name}"

    def bround(self, x: str) -> str:
        return f"bround({x})"

    voxels = "voxels AS (SELECT vec_id AS scan, label AS grp, e.p AS p, CAST(e.v AS DOUBLE) AS value FROM embeddings LATERAL VIEW posexplode(embedding) e AS p, v)"


class DuckDialect(SparkDialect):
    name = "duck"

    def pct(self, x: str, p: float) -> str:
        return f"quantile_cont(CAST({x} AS DOUBLE), {p})"

    def joined(self, x: str, order: str | None = None, sep: str = ";") -> str:
        return f"string_agg({x}, '{sep}' ORDER BY {order or x})"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def first_by(self, x: str, order: str) -> str:
        return f"arg_min({x}, {order})"

    def last_by(self, x: str, order: str) -> str:
        return f"arg_max({x}, {order})"

    def json_long(self, x: str, key: str) -> str:
        return f"CAST(json_extract({x}, '$.{key}') AS BIGINT)"

    def series(self, low: int, high: int, name: str = "n") -> str:
        return f"SELECT CAST(range AS INTEGER) AS {name} FROM range({low}, {high + 1})"

    def bround(self, x: str) -> str:
        return f"round_even({x}, 0)"

    voxels = "voxels AS (SELECT vec_id AS scan, label AS grp, CAST(i - 1 AS INTEGER) AS p, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) t(i))"


class Chain(tuple):
    """Relations (name, body), each of which may name those before it; as text, the inside of a WITH list."""

    def __add__(self, more) -> Chain:
        return Chain((*self, *more))

    def changed(self, *swaps: tuple[str, str]) -> Chain:
        """The chain with pieces of text replaced."""
        out = []
        for name, body in self:
            for old, new in swaps:
                name, body = name.replace(old, new) if old == name else name, body.replace(old, new)
            out.append((name, body))
        return Chain(out)

    def __str__(self) -> str:
        return ",\n".join(f"{name} AS ({body})" for name, body in self)


# Order panel: subject = nation, stratum = region, roi = brand, condition = return flag, voxel = order line.
LINES = Chain([
    ("lines", """  SELECT c_nationkey AS subject, n_regionkey AS stratum, p_brand AS roi, l_returnflag AS condition,
         l_extendedprice * l_discount / 1000 AS value, l_quantity AS quantity, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN part ON l_partkey = p_partkey JOIN nation ON c_nationkey = n_nationkey"""),
])

CELLS = LINES + [
    ("cells", """  SELECT subject, stratum, condition, roi, avg(value) AS roi_mean, count(*) AS n_voxels,
         count(CASE WHEN value = 0 THEN 1 END) AS n_zero,
         count(CASE WHEN value = 0 THEN 1 END) / CAST(count(*) AS DOUBLE) AS zero_fraction
  FROM lines GROUP BY subject, stratum, condition, roi"""),
    ("mri", """SELECT subject, stratum, roi, avg(quantity) AS thickness, sum(price) AS area FROM lines GROUP BY subject, stratum, roi"""),
]

LONG = CELLS + [
    ("wide", """  SELECT subject, roi, max(CASE WHEN condition = 'A' THEN roi_mean END) AS cond_a,
         max(CASE WHEN condition = 'N' THEN roi_mean END) AS cond_n, max(CASE WHEN condition = 'R' THEN roi_mean END) AS cond_r
  FROM cells GROUP BY subject, roi"""),
    ("long_table", """  SELECT m.subject, m.stratum, m.roi, m.thickness, m.area, ln(m.area) AS ln_area, w.cond_a, w.cond_n, w.cond_r,
         (w.cond_a + w.cond_n + w.cond_r) / 3 AS cond_mean
  FROM mri m JOIN wide w ON m.subject = w.subject AND m.roi = w.roi"""),
]

PANEL = LONG + [
    ("panel", """SELECT subject AS s, stratum, roi AS r, thickness AS x1, ln_area AS x2, cond_mean AS y FROM long_table"""),
]

# 4 x 4 x 4 grid of each vector: p = 16 i + 4 j + k; label = octant; mask = positive values.
GRID = """,
grid AS (
  SELECT scan, grp, p, CAST(floor(p / 16.0) AS INTEGER) AS i, CAST(floor(p / 4.0) AS INTEGER) % 4 AS j, p % 4 AS k, value,
         greatest(value, CAST(0 AS DOUBLE)) AS level,
         1001 + CAST(floor(p / 32.0) AS INTEGER) * 4 + CAST(floor((p % 16) / 8.0) AS INTEGER) * 2 + CAST(floor((p % 4) / 2.0) AS INTEGER) AS label
  FROM voxels)"""

# Local files: every document. Expected ones: what a release published, texts with single exclamation marks, and the
# benchmark's items, which are not among the documents.
MANIFEST_OF = """local AS (
  SELECT concat(source, '/', CAST(doc_id AS {text})) AS relpath, CAST(length(text) AS BIGINT) AS bytes, {sha} AS sha256, doc_id, source, lang FROM documents),
expected AS (
  SELECT concat(source, '/', CAST(doc_id AS {text})) AS relpath, CAST(length(replace(text, '!!', '!')) AS BIGINT) AS bytes, {release} AS sha256, source, lang, doc_id FROM documents
  UNION ALL SELECT concat('benchmark/', CAST(item_id AS {text})) AS relpath, CAST(length(text) AS BIGINT) AS bytes, {sha} AS sha256, 'benchmark' AS source, 'en' AS lang, NULL AS doc_id FROM benchmark)"""


def manifest(d: SparkDialect) -> str:
    kind = "STRING" if d.name == "spark" else "VARCHAR"
    return MANIFEST_OF.format(text=kind, sha=d.sha256("text"), release=d.sha256("replace(text, '!!', '!')"))


def register(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views of the tables that the text names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    register(spark, sf_dir, sql)
    return spark.sql(sql)
