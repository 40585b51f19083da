"""Keyed relations: products, completeness, duplicates, reindexing, reconciliation, membership, gathers."""

from __future__ import annotations

from panelforge.sources.adapters import CELLS, GRID, LINES, LONG, PANEL, manifest

# Users by event type and third of the month: complete at ten subjects, incomplete at raw users.
EVENTS = """ev AS (SELECT user_id, event_type AS roi, CAST(floor((day(ts) - 1) / 10.0) AS INTEGER) AS part, value FROM events)"""

BOOK = {
    "key_product": lambda d: f"""WITH {LINES} SELECT a.subject, b.roi, c.condition FROM (SELECT DISTINCT subject FROM lines) a CROSS JOIN (SELECT DISTINCT roi FROM lines) b CROSS JOIN (SELECT DISTINCT condition FROM lines) c""",
    "keyed_reindex": lambda d: f"""WITH {CELLS},
subjects AS (SELECT subject, row_number() OVER (ORDER BY subject) - 1 AS si FROM (SELECT DISTINCT subject FROM cells) a),
rois AS (SELECT roi, row_number() OVER (ORDER BY roi) - 1 AS ri FROM (SELECT DISTINCT roi FROM cells) b)
SELECT CAST(si AS BIGINT) AS subject_index, CAST(ri AS BIGINT) AS roi_index, m.subject, m.roi, round(m.thickness, 6) AS thickness
FROM subjects CROSS JOIN rois LEFT JOIN mri m ON m.subject = subjects.subject AND m.roi = rois.roi""",
    "missing_keys": lambda d: f"""WITH {EVENTS.replace("floor((day(ts) - 1) / 10.0)", "day(ts)")},
want AS (SELECT u.user_id, r.roi, p.part FROM (SELECT DISTINCT user_id FROM ev) u CROSS JOIN (SELECT DISTINCT roi FROM ev) r CROSS JOIN (SELECT DISTINCT part FROM ev) p)
SELECT w.user_id, w.roi, w.part FROM want w WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.user_id = w.user_id AND ev.roi = w.roi AND ev.part = w.part)""",
    "extra_keys": lambda d: """SELECT d.doc_id FROM documents d LEFT ANTI JOIN labels l ON d.doc_id = l.doc_id""" if d.name == "spark" else """SELECT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id""",
    "duplicate_keys": lambda d: """SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) AS first_part FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "long_table": lambda d: f"""WITH {LONG}
SELECT subject, roi, round(thickness, 6) AS thickness, round(area, 4) AS area, round(ln_area, 6) AS ln_area, round(cond_a + 3.7e-12, 9) AS cond_a,
       round(cond_n + 3.7e-12, 9) AS cond_n, round(cond_r + 3.7e-12, 9) AS cond_r, round(cond_mean + 3.7e-12, 9) AS cond_mean FROM long_table""",
    "build_panel": lambda d: f"""WITH {PANEL} SELECT s, stratum, r, round(x1, 6) AS x1, round(x2, 6) AS x2, round(y, 6) AS y FROM panel""",
    "extract_condition": lambda d: f"""WITH {CELLS} SELECT n_name AS subject_id, condition, roi, round(roi_mean + 3.7e-12, 9) AS cell_mean, n_voxels, n_zero FROM cells JOIN nation ON n_nationkey = subject""",
    "code_lookup_join": lambda d: f"""WITH {d.voxels}{GRID},
codes AS (SELECT label AS code, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS position FROM (SELECT DISTINCT label FROM grid WHERE label <> 1004) c)
SELECT scan, CAST(position AS BIGINT) AS position, count(*) AS n, round(avg(value), 6) AS mean FROM grid JOIN codes ON label = code GROUP BY scan, position""",
    "cortical_semi": lambda d: f"""WITH {d.voxels}{GRID} SELECT scan, p, label FROM grid WHERE label IN (SELECT 1001 + r_regionkey FROM region)""",
    "manifest_check": lambda d: f"""WITH {manifest(d)}
SELECT e.relpath, e.bytes, CASE WHEN l.relpath IS NULL THEN 'MISSING' WHEN l.bytes <> e.bytes OR l.sha256 <> e.sha256 THEN 'MISMATCH' ELSE 'OK' END AS status
FROM expected e LEFT JOIN local l ON l.relpath = e.relpath""",
    "verify_summary": lambda d: f"""WITH {manifest(d)},
c AS (SELECT CASE WHEN l.relpath IS NULL THEN 'MISSING' WHEN l.bytes <> e.bytes OR l.sha256 <> e.sha256 THEN 'MISMATCH' ELSE 'OK' END AS status FROM expected e LEFT JOIN local l ON l.relpath = e.relpath)
SELECT count(*) AS files, count(CASE WHEN status = 'OK' THEN 1 END) AS ok, count(CASE WHEN status = 'MISSING' THEN 1 END) AS missing, count(CASE WHEN status = 'MISMATCH' THEN 1 END) AS mismatch,
       count(CASE WHEN status <> 'OK' THEN 1 END) = 0 AS passed FROM c""",
    "cross_release_same": lambda d: f"""WITH {manifest(d)}
SELECT e.relpath, CASE WHEN l.relpath IS NULL THEN NULL ELSE e.sha256 = l.sha256 END AS same_in_copy FROM expected e LEFT JOIN local l ON e.relpath = l.relpath""",
    "roster_reconcile": lambda d: """SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' ELSE 'both' END AS side, count(*) AS n, min(coalesce(d.doc_id, l.doc_id)) AS first_id
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
    "roster_equal": lambda d: """SELECT r_name, (SELECT count(*) FROM nation n WHERE n.n_regionkey = r_regionkey AND n.n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey IS NOT NULL)) = 0 AS all_present FROM region""" if d.name == "duck" else """SELECT r_name, count(CASE WHEN c.k IS NULL THEN 1 END) = 0 AS all_present FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT DISTINCT c_nationkey AS k FROM customer) c ON c.k = n_nationkey GROUP BY r_name""",
    "eligibility": lambda d: """WITH s AS (SELECT doc_id FROM documents)
SELECT s.doc_id, l.doc_id IS NOT NULL AS labelled, b.doc_id IS NOT NULL AS good, t.doc_id IS NOT NULL AS clean, l.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND t.doc_id IS NOT NULL AS eligible
FROM s LEFT JOIN labels l ON l.doc_id = s.doc_id LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) b ON b.doc_id = s.doc_id LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 0) t ON t.doc_id = s.doc_id""",
    "distance_band_join": lambda d: f"""WITH {d.voxels}{GRID},
bands AS (SELECT * FROM (VALUES (0, 0.05), (1, 0.1), (2, 0.2), (3, 9.9)) AS b(band, hi)),
edges AS (SELECT band, CAST(coalesce(lag(hi) OVER (ORDER BY band), 0) AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM bands)
SELECT grp, band, count(*) AS n FROM grid JOIN edges ON level > lo AND level <= hi GROUP BY grp, band""",
    "homologous_pairs": lambda d: f"""WITH {d.voxels}{GRID},
c AS (SELECT scan, label, avg(CAST(i AS DOUBLE)) AS x, count(*) AS n FROM grid WHERE value > 0 GROUP BY scan, label)
SELECT l.scan, l.label, l.n AS n_left, r.n AS n_right, l.x < r.x AS ordered FROM c l JOIN c r ON r.scan = l.scan AND r.label = l.label + 4""",
    "equal_neighbour": lambda d: f"""WITH {d.voxels}{GRID},
n AS (SELECT scan, level, lead(level) OVER (PARTITION BY scan, j, k ORDER BY i) AS ni, lead(level) OVER (PARTITION BY scan, i, k ORDER BY j) AS nj, lead(level) OVER (PARTITION BY scan, i, j ORDER BY k) AS nk FROM grid)
SELECT scan, count(CASE WHEN level = ni THEN 1 END) AS eq_i, count(CASE WHEN level = nj THEN 1 END) AS eq_j, count(CASE WHEN level = nk THEN 1 END) AS eq_k FROM n GROUP BY scan""",
    "cross_condition_jaccard": lambda d: f"""WITH {d.voxels}{GRID},
z AS (SELECT CAST(floor(scan / 3.0) AS BIGINT) AS subject, p, max(CASE WHEN scan % 3 = 0 AND level = 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN scan % 3 = 1 AND level = 0 THEN 1 ELSE 0 END) AS b,
             max(CASE WHEN scan % 3 = 2 AND level = 0 THEN 1 ELSE 0 END) AS c FROM grid GROUP BY 1, p)
SELECT subject, round(sum(a * b) / nullif(CAST(sum(greatest(a, b)) AS DOUBLE), 0), 6) AS j_ab, round(sum(a * c) / nullif(CAST(sum(greatest(a, c)) AS DOUBLE), 0), 6) AS j_ac,
       round(sum(a * b * c) / nullif(CAST(sum(greatest(a, b, c)) AS DOUBLE), 0), 6) AS all_over_any FROM z GROUP BY subject""",
    "subject_union": lambda d: """SELECT doc_id AS id FROM documents UNION SELECT doc_id AS id FROM labels UNION SELECT conv_id AS id FROM conversations""",
    "union_literal": lambda d: """SELECT DISTINCT source FROM documents UNION SELECT 'src-extra' AS source""",
    "except_both": lambda d: """SELECT 'missing' AS side, doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels) a
UNION ALL SELECT 'extra' AS side, doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang = 'en') b""",
    "bag_union": lambda d: """SELECT 'document' AS kind, lang AS what, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'turn' AS kind, role AS what, count(*) AS n FROM conversations GROUP BY role""",
    "strata_partition": lambda d: """WITH strata AS (SELECT DISTINCT c_nationkey AS subject, n_regionkey AS stratum FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT stratum, count(*) AS members, (SELECT count(*) FROM (SELECT subject FROM strata GROUP BY subject HAVING count(*) > 1) x) = 0 AS is_partition FROM strata GROUP BY stratum""",
    "roster_resolve": lambda d: """SELECT n.n_nationkey, n_name, CAST(row_number() OVER (ORDER BY n_name) - 1 AS BIGINT) AS subject_index, c.k IS NOT NULL AS has_data FROM nation n LEFT JOIN (SELECT DISTINCT c_nationkey AS k FROM customer) c ON c.k = n.n_nationkey""",
    "roi_roster": lambda d: """SELECT CAST(row_number() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS roi_index, p_brand AS roi, count(*) AS parts FROM part WHERE p_brand NOT LIKE '%55' GROUP BY p_brand""",
    "config_contract": lambda d: """SELECT t.path, t.value, count(p.p_partkey) AS rows_that_meet FROM (VALUES ('size.min', 1), ('size.max', 50)) AS t(path, value) LEFT JOIN part p ON p.p_size = t.value GROUP BY t.path, t.value""",
}
