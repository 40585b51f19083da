"""Digests, geometry rows, transform comparisons and further generic operations."""

from __future__ import annotations

from panelforge.operators.aggregates import _hist
from panelforge.sources.adapters import CELLS, GRID

BOOK = {
    # one digest a subject over its rows as text, in key order
    "table_digest": lambda d: f"""WITH {CELLS}, rows_ AS (SELECT subject, roi, condition, concat(roi, chr(9), condition, chr(9), CAST(n_voxels AS VARCHAR(20)), chr(9), CAST(n_zero AS VARCHAR(20))) AS line FROM cells)
SELECT subject, count(*) AS n, {d.sha256(d.joined('line', 'line', '/'))} AS sha256 FROM rows_ GROUP BY subject""",
    "panel_manifest": lambda d: f"""WITH {CELLS}, k AS (SELECT DISTINCT stratum, CAST(subject AS VARCHAR(10)) AS subject FROM cells)
SELECT c.stratum, c.cells, c.voxels, m.roster, m.roster_sha256 FROM (SELECT stratum, count(*) AS cells, CAST(sum(n_voxels) AS BIGINT) AS voxels FROM cells GROUP BY stratum) c
JOIN (SELECT stratum, {d.joined('subject', 'subject', ',')} AS roster, {d.sha256(d.joined('subject', 'subject', ','))} AS roster_sha256 FROM k GROUP BY stratum) m ON m.stratum = c.stratum""",
    "image_geometry": lambda d: f"""WITH {d.voxels}{GRID}
SELECT scan, max(i) + 1 AS nx, max(j) + 1 AS ny, max(k) + 1 AS nz, count(*) = (max(i) + 1) * (max(j) + 1) * (max(k) + 1) AS whole, round(2e0 * (max(i) + min(i)) / 2 - 3, 6) AS centre_x, min(value) < 0 AS has_negative FROM grid GROUP BY scan""",
    "transform_compare": lambda d: f"""WITH {d.voxels}{GRID}, t AS (SELECT * FROM (VALUES ('header', 0e0), ('transform', 10e0), ('inverse', -10e0)) AS v(name, degrees_)),
m AS (SELECT scan, name, sqrt((cos(radians(degrees_)) * (i - 1.5e0) - sin(radians(degrees_)) * (j - 1.5e0) + 1.5e0 - i) * (cos(radians(degrees_)) * (i - 1.5e0) - sin(radians(degrees_)) * (j - 1.5e0) + 1.5e0 - i)
  + (sin(radians(degrees_)) * (i - 1.5e0) + cos(radians(degrees_)) * (j - 1.5e0) + 1.5e0 - j) * (sin(radians(degrees_)) * (i - 1.5e0) + cos(radians(degrees_)) * (j - 1.5e0) + 1.5e0 - j)) AS moved FROM grid CROSS JOIN t WHERE value > 0)
SELECT scan, name, round(avg(moved), 6) AS mean, round(max(moved), 6) AS greatest_, max(moved) < 1e-3 AS grid_matches FROM m GROUP BY scan, name""",
    "nmi_metrics": lambda d: _nmi_by_mask(d),
    "generic_hof": lambda d: (
        """SELECT doc_id, CAST(size(filter(split(text, ' '), w -> length(w) > 6)) AS BIGINT) AS long_words FROM documents"""
        if d.name == "spark"
        else """SELECT doc_id, CAST(len(list_filter(string_split(text, ' '), lambda w: length(w) > 6)) AS BIGINT) AS long_words FROM documents"""
    ),
    "generic_session": lambda d: """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '1' DAY THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_ FROM g)
SELECT user_id, CAST(session_ AS BIGINT) AS session_, count(*) AS n FROM s GROUP BY user_id, session_""",
}


def _nmi_by_mask(d) -> str:
    hist = _hist(d).replace("SELECT a.grp, a.value AS va", "SELECT concat(CAST(a.grp AS VARCHAR(5)), CASE WHEN a.value > 0 THEN ':in' ELSE ':out' END) AS grp, a.value AS va")
    return f"""WITH {hist},
pj AS (SELECT grp, ba, bb, n / CAST(sum(n) OVER (PARTITION BY grp) AS DOUBLE) AS p FROM hist),
hj AS (SELECT grp, -sum(p * ln(p)) AS h FROM pj GROUP BY grp),
ha AS (SELECT grp, -sum(p * ln(p)) AS h FROM (SELECT grp, ba, sum(p) AS p FROM pj GROUP BY grp, ba) a GROUP BY grp),
hb AS (SELECT grp, -sum(p * ln(p)) AS h FROM (SELECT grp, bb, sum(p) AS p FROM pj GROUP BY grp, bb) b GROUP BY grp)
SELECT hj.grp AS metric, round(CASE WHEN hj.h = 0 THEN NULL ELSE (ha.h + hb.h) / hj.h END, 6) AS nmi FROM hj JOIN ha ON hj.grp = ha.grp JOIN hb ON hj.grp = hb.grp"""
