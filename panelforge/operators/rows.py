"""Scans, row predicates, windows and ordering."""

from __future__ import annotations

from panelforge.sources.adapters import CELLS, GRID, LINES, LONG, PANEL, manifest

BOOK = {
    "source_lookup": lambda d: f"""WITH {manifest(d)} SELECT n.doc_id, e.relpath, e.sha256 FROM documents n JOIN expected e ON e.relpath = concat(n.source, '/', CAST(n.doc_id AS VARCHAR(20)))""",
    "unique_match": lambda d: """SELECT conv_id, count(CASE WHEN role = 'system' THEN 1 END) AS matches, count(CASE WHEN role = 'system' THEN 1 END) = 1 AS is_unique FROM conversations GROUP BY conv_id""",
    "json_units": lambda d: f"""SELECT event_id, {d.json_long('props', 'k')} AS k, {d.json_long('props', 'k')} >= 0 AS ok FROM events""",
    "regex_extract_first": lambda d: """SELECT page_id, nullif(regexp_extract(html, 'href="([^"]*)"', 1), '') AS first_link FROM pages""",
    "manifest_scope": lambda d: """SELECT 0 AS ord, source, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 1 AS ord, source, doc_id FROM documents WHERE lang = 'de' AND source LIKE 'src1%'""",
    "ln_feature": lambda d: """SELECT o_orderkey, round(CASE WHEN o_totalprice > 0 AND NOT isnan(o_totalprice) THEN ln(o_totalprice) END, 6) AS ln_price FROM orders""",
    "finite_guard": lambda d: f"""WITH {LINES} SELECT count(*) AS n, count(CASE WHEN isnan(value) OR abs(value) > 1e308 OR value IS NULL THEN 1 END) AS not_finite FROM lines""",
    "panel_shape": lambda d: f"""WITH {PANEL} SELECT s, count(*) AS cells, count(DISTINCT r) AS rois, count(*) = 25 AS whole FROM panel GROUP BY s""",
    "map_validity": lambda d: f"""WITH {d.voxels}{GRID} SELECT scan, count(CASE WHEN isnan(value) THEN 1 END) AS n_nonfinite, count(CASE WHEN value < 0 THEN 1 END) AS n_negative, count(CASE WHEN value < 0 OR isnan(value) THEN 1 END) = 0 AS valid FROM grid GROUP BY scan""",
    "tissue_case": lambda d: f"""WITH {d.voxels}{GRID} SELECT scan, p, CASE WHEN label = 1006 THEN 4 WHEN label = 1005 THEN 3 WHEN label IN (1003, 1004) THEN 2 WHEN label IN (1001, 1002) THEN 1 ELSE 0 END AS tissue FROM grid""",
    "lobe_map": lambda d: f"""WITH {d.voxels}{GRID}, lobes AS (SELECT * FROM (VALUES (1001, 'frontal'), (1002, 'frontal'), (1003, 'parietal'), (1004, 'temporal'), (1005, 'occipital')) AS t(code, lobe))
SELECT scan, coalesce(lobe, 'other') AS lobe, count(*) AS n, round(avg(value), 6) AS mean FROM grid LEFT JOIN lobes ON label = code GROUP BY scan, coalesce(lobe, 'other')""",
    "stride_sample": lambda d: f"""WITH {d.voxels}{GRID} SELECT scan, i, j, k, round(value, 6) AS value FROM grid WHERE i % 2 = 0 AND j % 2 = 0 AND k % 2 = 0 AND value > 0""",
    "every_nth": lambda d: f"""WITH {d.voxels}{GRID}, n AS (SELECT scan, i, j, k, row_number() OVER (PARTITION BY scan ORDER BY i, j, k) AS rn FROM grid WHERE value > 0) SELECT scan, i, j, k FROM n WHERE (rn - 1) % 7 = 0""",
    "value_bands": lambda d: f"""WITH {d.voxels}{GRID} SELECT scan, count(CASE WHEN level < 0.02 THEN 1 END) AS b1, count(CASE WHEN level >= 0.02 AND level < 0.04 THEN 1 END) AS b2, count(CASE WHEN level >= 0.2 AND level < 0.22 THEN 1 END) AS b3 FROM grid GROUP BY scan""",
    "check_rows": lambda d: f"""WITH {CELLS}, m AS (SELECT subject, max(zero_fraction) AS worst, min(n_voxels) AS least FROM cells GROUP BY subject)
SELECT subject, 'zero_fraction' AS check_, round(worst, 6) AS value, worst < 0.2 AS pass FROM m UNION ALL SELECT subject, 'n_voxels' AS check_, CAST(least AS DOUBLE) AS value, least >= 10 AS pass FROM m""",
    "null_reject": lambda d: """SELECT 'documents' AS what, count(CASE WHEN text IS NULL OR doc_id IS NULL THEN 1 END) AS nulls FROM documents UNION ALL SELECT 'labels', count(CASE WHEN quality IS NULL OR toxic IS NULL THEN 1 END) FROM labels""",
    "stratum_rank": lambda d: """SELECT n_regionkey AS stratum, n_name AS subject, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS BIGINT) AS position FROM nation""",
    "argmax_first": lambda d: f"""WITH {d.voxels}{GRID}, r AS (SELECT scan, i, j, k, value, row_number() OVER (PARTITION BY scan, i ORDER BY round(value, 1) DESC, p) AS rn FROM grid) SELECT scan, i, j, k, round(value, 6) AS value FROM r WHERE rn = 1""",
    "dedup_first_occurrence": lambda d: f"""WITH {manifest(d)} SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256) AS first_occurrence, count(*) OVER (PARTITION BY sha256) AS multiplicity FROM local""",
    "label_boundary": lambda d: f"""WITH {d.voxels}{GRID}, fg AS (SELECT scan, i, j, k, CASE WHEN value > 0 THEN label ELSE 0 END AS lab FROM grid WHERE k = 1),
n AS (SELECT scan, i, j, lab, lag(lab) OVER (PARTITION BY scan, j ORDER BY i) AS a, lead(lab) OVER (PARTITION BY scan, j ORDER BY i) AS b, lag(lab) OVER (PARTITION BY scan, i ORDER BY j) AS c, lead(lab) OVER (PARTITION BY scan, i ORDER BY j) AS e FROM fg)
SELECT scan, i, j, lab FROM n WHERE lab > 0 AND (coalesce(a <> lab, false) OR coalesce(b <> lab, false) OR coalesce(c <> lab, false) OR coalesce(e <> lab, false))""",
    "canonical_order": lambda d: f"""WITH {CELLS} SELECT CAST(row_number() OVER (ORDER BY subject, roi, condition) - 1 AS BIGINT) AS ord, subject, roi, condition FROM cells""",
    "error_examples": lambda d: f"""WITH {manifest(d)}, bad AS (SELECT e.source, e.relpath, row_number() OVER (PARTITION BY e.source ORDER BY e.relpath) AS rn FROM expected e LEFT JOIN local l ON l.relpath = e.relpath WHERE l.relpath IS NULL)
SELECT source, count(*) AS n, {d.joined("CASE WHEN rn <= 5 THEN relpath END", 'relpath', ', ')} AS examples FROM bad GROUP BY source""",
    "top_types": lambda d: """SELECT event_type, count(*) AS n, min(event_id) AS first_seen, CAST(row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS BIGINT) AS place FROM events GROUP BY event_type""",
    "tie_chain": lambda d: f"""WITH {CELLS}, c AS (SELECT subject, roi, condition, row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN zero_fraction <= 0.02 THEN 0 ELSE 1 END, n_zero, n_voxels, roi, condition) AS rn FROM cells) SELECT subject, roi, condition FROM c WHERE rn = 1""",
}
