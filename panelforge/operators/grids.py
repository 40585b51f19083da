"""Voxel grids: enumeration, packing, morphology, transforms."""

from __future__ import annotations

from panelforge.sources.adapters import GRID, LINES

_NEXT = "SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) AS t(di, dj, dk)"
#: Rotation by 10 degrees about the third axis and a shift, about the grid's centre 1.5.
_T = "cos(radians(10.0)) AS c, sin(radians(10.0)) AS s, 0.25 AS tx, -0.5 AS ty, 0.1 AS tz"

_MASK = GRID + """,
mask AS (SELECT scan, i, j, k FROM grid WHERE value > 0.15),
steps AS (""" + _NEXT + ")"

BOOK = {
    "grid_enumerate": lambda d: f"""WITH {d.voxels}{GRID} SELECT scan, p, i, j, k, 16 * i + 4 * j + k = p AS row_major FROM grid""",
    "tensor_unpack": lambda d: f"""WITH {d.voxels} SELECT scan, p, round(value, 6) AS value FROM voxels""",
    "tensor_pack": lambda d: f"""WITH {d.voxels} SELECT scan, count(*) AS n, round({d.first_by('value', 'p')}, 6) AS first_value, round({d.last_by('value', 'p')}, 6) AS last_value FROM voxels GROUP BY scan""",
    "panel_pack": lambda d: f"""WITH {LINES}, c AS (SELECT subject, roi, avg(value) AS v FROM lines GROUP BY subject, roi) SELECT subject, count(*) AS cells, {d.joined("CAST(CAST(round(v * 1000) AS BIGINT) AS VARCHAR(20))", 'roi', ',')} AS packed FROM c GROUP BY subject""",
    "dilate": lambda d: f"""WITH {d.voxels}{_MASK}
SELECT scan, i, j, k FROM mask UNION SELECT scan, i + di AS i, j + dj AS j, k + dk AS k FROM mask CROSS JOIN steps WHERE i + di BETWEEN 0 AND 3 AND j + dj BETWEEN 0 AND 3 AND k + dk BETWEEN 0 AND 3""",
    "erode": lambda d: f"""WITH {d.voxels}{GRID}, mask AS (SELECT scan, i, j, k FROM grid WHERE value > -0.15), steps AS ({_NEXT})
SELECT m.scan, m.i, m.j, m.k FROM mask m CROSS JOIN steps JOIN mask n ON n.scan = m.scan AND n.i = m.i + di AND n.j = m.j + dj AND n.k = m.k + dk GROUP BY m.scan, m.i, m.j, m.k HAVING count(*) = 6""",
    "displacement": lambda d: f"""WITH {d.voxels}{GRID}, t AS (SELECT {_T}),
m AS (SELECT scan, sqrt((c * (i - 1.5) - s * (j - 1.5) + 1.5 + tx - i) * (c * (i - 1.5) - s * (j - 1.5) + 1.5 + tx - i) + (s * (i - 1.5) + c * (j - 1.5) + 1.5 + ty - j) * (s * (i - 1.5) + c * (j - 1.5) + 1.5 + ty - j) + tz * tz) AS d FROM grid CROSS JOIN t WHERE value > 0)
SELECT scan, round(avg(d), 6) AS mean, round(max(d), 6) AS greatest_ FROM m GROUP BY scan""",
    "reorient": lambda d: f"""WITH {d.voxels}{GRID} SELECT scan, 3 - i AS x, k AS y, j AS z, round(value, 6) AS value FROM grid""",
    "plane_slice": lambda d: f"""WITH {d.voxels}{GRID} SELECT scan, i, j, round(value, 6) AS value FROM grid WHERE k = 2""",
    "boundary_colour": lambda d: f"""WITH {d.voxels}{GRID}, n AS (SELECT scan, i, j, label, lead(label) OVER (PARTITION BY scan, j, k ORDER BY i) AS nxt FROM grid WHERE k = 1)
SELECT scan, i, j, CASE label WHEN 1001 THEN 'red' WHEN 1003 THEN 'green' WHEN 1005 THEN 'blue' ELSE 'grey' END AS colour FROM n WHERE nxt <> label""",
    "centroid_box": lambda d: f"""WITH {d.voxels}{GRID}, c AS (SELECT scan, CAST({d.bround('avg(CAST(i AS DOUBLE))')} AS INTEGER) AS ci, CAST({d.bround('avg(CAST(j AS DOUBLE))')} AS INTEGER) AS cj FROM grid WHERE value > 0.1 GROUP BY scan)
SELECT g.scan, g.i, g.j, g.k FROM grid g JOIN c ON c.scan = g.scan WHERE g.i BETWEEN greatest(ci - 1, 0) AND ci AND g.j BETWEEN greatest(cj - 1, 0) AND cj""",
}
