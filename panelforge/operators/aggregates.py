"""Statistics of labelled values: cell means and counts, ranges, percentiles, histograms, centroids, summaries."""

from __future__ import annotations

from panelforge.sources.adapters import CELLS, GRID, LINES, LONG

# Cell means get 3.7e-12 added before rounding: exact halves then round alike whatever the order of summation.

BOOK = {
    # cell mean over all voxels (zeros included), voxel count, exact-zero count
    "roi_stats": lambda d: f"""WITH {CELLS}
SELECT subject, condition, roi, round(roi_mean + 3.7e-12, 9) AS roi_mean, n_voxels, n_zero, round(zero_fraction, 6) AS zero_fraction FROM cells""",
    "roi_stats_nonzero": lambda d: f"""WITH {LINES}
SELECT subject, condition, roi, round(avg(CASE WHEN value <> 0 THEN value END) + 3.7e-12, 9) AS mean_nonzero,
       count(CASE WHEN value <> 0 THEN 1 END) AS n_kept, count(CASE WHEN value <> 0 THEN 1 END) = 0 AS not_estimable
FROM lines GROUP BY subject, condition, roi""",
    "condition_mean": lambda d: f"""WITH {LONG}
SELECT subject, roi, round(cond_mean + 3.7e-12, 9) AS cond_mean FROM long_table""",
    "count_consistency": lambda d: f"""WITH {CELLS}
SELECT count(*) AS cells, count(CASE WHEN n_zero < 0 OR n_zero > n_voxels THEN 1 END) AS zeros_out_of_range,
       count(CASE WHEN n_voxels <= 0 THEN 1 END) AS empty_cells,
       count(CASE WHEN zero_fraction <> n_zero / CAST(n_voxels AS DOUBLE) THEN 1 END) AS bad_fraction FROM cells""",
    "validity_summary": lambda d: f"""WITH {LONG}
SELECT count(*) AS n_rows, count(DISTINCT subject) AS subjects, count(DISTINCT roi) AS rois,
       count(*) - count(DISTINCT concat(CAST(subject AS VARCHAR(20)), '|', roi)) AS duplicate_keys,
       count(CASE WHEN thickness IS NULL OR isnan(thickness) THEN 1 END) AS bad_thickness,
       round(min(cond_mean) + 3.7e-12, 9) AS low, round({d.median('cond_mean')}, 6) AS median, round(max(cond_mean) + 3.7e-12, 9) AS high,
       count(CASE WHEN cond_a = cond_n AND cond_n = cond_r THEN 1 END) AS identical_across_conditions FROM long_table""",
    "range_by_condition": lambda d: f"""WITH {CELLS}
SELECT condition, round(min(roi_mean) + 3.7e-12, 9) AS low, round({d.pct('roi_mean', 0.5)}, 6) AS median, round(max(roi_mean) + 3.7e-12, 9) AS high,
       CAST(sum(n_voxels) AS BIGINT) AS voxels, CAST(sum(n_zero) AS BIGINT) AS zeros,
       count(CASE WHEN zero_fraction > 0.1 THEN 1 END) AS cells_over_threshold FROM cells GROUP BY condition""",
    "pivot_conditions": lambda d: f"""WITH {LONG}
SELECT subject, roi, round(cond_a + 3.7e-12, 9) AS cond_a, round(cond_n + 3.7e-12, 9) AS cond_n, round(cond_r + 3.7e-12, 9) AS cond_r FROM long_table""",
    "label_counts": lambda d: f"""WITH {d.voxels}{GRID}
SELECT scan, label, count(*) AS n FROM grid GROUP BY scan, label""",
    "roi_qc_counts": lambda d: f"""WITH {d.voxels}{GRID},
native AS (SELECT label, count(*) AS n_native FROM grid WHERE value > 0 GROUP BY label)
SELECT g.scan, g.label, count(*) AS n, max(n_native) AS n_native, round(count(*) / CAST(max(n_native) AS DOUBLE), 6) AS ratio,
       count(CASE WHEN isnan(value) THEN 1 END) AS n_nonfinite, count(CASE WHEN level = 0 THEN 1 END) AS n_zero,
       count(CASE WHEN value < 0 THEN 1 END) AS n_negative, round(count(CASE WHEN level = 0 THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS frac_zero,
       round(avg(CAST(i AS DOUBLE)), 6) AS ci, round(avg(CAST(j AS DOUBLE)), 6) AS cj, round(avg(CAST(k AS DOUBLE)), 6) AS ck
FROM grid g LEFT JOIN native ON g.label = native.label GROUP BY g.scan, g.label""",
    "label_integrity": lambda d: f"""WITH {d.voxels}{GRID},
present AS (SELECT scan, label, count(*) AS n FROM grid WHERE value > 0.05 GROUP BY scan, label),
labels_ AS (SELECT DISTINCT label FROM grid), scans AS (SELECT DISTINCT scan FROM grid),
full_ AS (SELECT scans.scan, labels_.label, coalesce(n, 0) AS n FROM scans CROSS JOIN labels_ LEFT JOIN present ON present.scan = scans.scan AND present.label = labels_.label)
SELECT scan, count(*) AS expected, count(CASE WHEN n > 0 THEN 1 END) AS present,
       coalesce({d.joined("CASE WHEN n = 0 THEN CAST(label AS VARCHAR(10)) END", 'label')}, '') AS missing,
       min(n) AS smallest, round({d.pct('n', 0.5)}, 6) AS median_size FROM full_ GROUP BY scan""",
    "zeros_by_tissue": lambda d: f"""WITH {d.voxels}{GRID},
t AS (SELECT scan, CASE WHEN label IN (1001, 1002) THEN 1 WHEN label IN (1003, 1004) THEN 2 WHEN label = 1005 THEN 3 WHEN label = 1006 THEN 4 ELSE 0 END AS tissue, level, value FROM grid)
SELECT scan, tissue, count(*) AS n_voxels, round(avg(CASE WHEN level = 0 THEN 1e0 ELSE 0e0 END), 6) AS frac_zero
FROM t WHERE tissue <> 0 OR value > -0.2 GROUP BY scan, tissue""",
    "map_fractions": lambda d: f"""WITH {d.voxels}{GRID}
SELECT scan, count(*) AS n, round(avg(CASE WHEN isnan(value) THEN 0e0 ELSE 1e0 END), 6) AS frac_finite,
       round(avg(CASE WHEN level <> 0 THEN 1e0 ELSE 0e0 END), 6) AS frac_nonzero, count(CASE WHEN value < 0 THEN 1 END) AS n_negative
FROM grid GROUP BY scan""",
    "zero_scan": lambda d: f"""WITH {d.voxels}{GRID},
q AS ({d.deciles('level')})
SELECT grid.scan, count(CASE WHEN level = 0 THEN 1 END) AS zeros, round(max(q10), 6) AS q10, round(max(q90), 6) AS q90,
       count(CASE WHEN level < 0.02 THEN 1 END) AS below_02, count(CASE WHEN level < 0.1 THEN 1 END) AS below_1,
       round(avg(CASE WHEN level >= q90 THEN level END), 6) AS top_mean FROM grid JOIN q ON grid.scan = q.scan GROUP BY grid.scan""",
    "decile_rates": lambda d: f"""WITH {d.voxels}{GRID},
q AS ({d.deciles('value')})
SELECT grid.scan, round(avg(CASE WHEN value <= q10 THEN CASE WHEN level = 0 THEN 1e0 ELSE 0e0 END END), 6) AS bottom,
       round(avg(CASE WHEN value > q10 AND value < q90 THEN CASE WHEN level = 0 THEN 1e0 ELSE 0e0 END END), 6) AS middle,
       round(avg(CASE WHEN value >= q90 THEN CASE WHEN level = 0 THEN 1e0 ELSE 0e0 END END), 6) AS top
FROM grid JOIN q ON grid.scan = q.scan GROUP BY grid.scan""",
    # joint histogram of a voxel with its mirror voxel: 8 bins over [-0.6, 0.6], last bin closed, outside dropped
    "hist2d": lambda d: f"""WITH {_hist(d)}
SELECT grp, ba, bb, n FROM hist""",
    "nmi": lambda d: f"""WITH {_hist(d)},
pj AS (SELECT grp, ba, bb, n / CAST(sum(n) OVER (PARTITION BY grp) AS DOUBLE) AS p FROM hist),
hj AS (SELECT grp, -sum(p * ln(p)) AS h FROM pj GROUP BY grp),
ha AS (SELECT grp, -sum(p * ln(p)) AS h FROM (SELECT grp, ba, sum(p) AS p FROM pj GROUP BY grp, ba) a GROUP BY grp),
hb AS (SELECT grp, -sum(p * ln(p)) AS h FROM (SELECT grp, bb, sum(p) AS p FROM pj GROUP BY grp, bb) b GROUP BY grp)
SELECT hj.grp, round(CASE WHEN hj.h = 0 THEN NULL ELSE (ha.h + hb.h) / hj.h END, 6) AS nmi
FROM hj JOIN ha ON hj.grp = ha.grp JOIN hb ON hj.grp = hb.grp""",
    "duplicates": lambda d: """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "label_centroids": lambda d: f"""WITH {d.voxels}{GRID}
SELECT scan, label, round(2 * avg(CAST(i AS DOUBLE)) - 3, 6) AS x, round(2 * avg(CAST(j AS DOUBLE)) - 3, 6) AS y, round(2 * avg(CAST(k AS DOUBLE)) - 3, 6) AS z
FROM grid WHERE value > 0 GROUP BY scan, label""",
    "mask_centroid": lambda d: f"""WITH {d.voxels}{GRID}
SELECT scan, round(2 * avg(CAST(i AS DOUBLE)) - 3, 6) AS x, round(2 * avg(CAST(j AS DOUBLE)) - 3, 6) AS y, round(2 * avg(CAST(k AS DOUBLE)) - 3, 6) AS z
FROM grid WHERE value > 0 GROUP BY scan""",
    "exceedance": lambda d: f"""WITH {CELLS}, t AS (SELECT roi, condition, avg(roi_mean) AS t FROM cells GROUP BY roi, condition)
SELECT a.roi, count(CASE WHEN b.t >= a.t THEN 1 END) AS k, count(*) AS b FROM t a JOIN t b ON a.roi = b.roi WHERE a.condition = 'A' GROUP BY a.roi""",
    "affine_maxdiff": lambda d: f"""WITH {d.voxels}{GRID}
SELECT a.scan, round(max(abs(a.value - b.value)), 6) AS max_difference FROM grid a JOIN grid b ON a.scan = b.scan + 1 AND a.p = b.p WHERE a.p < 16 GROUP BY a.scan""",
    "slice_indices": lambda d: f"""WITH {d.voxels}{GRID}
SELECT scan, min(i) AS lo_i, max(i) AS hi_i, CAST({d.bround('min(i) + 0.3 * (max(i) - min(i))')} AS INTEGER) AS at_30,
       CAST({d.bround('min(i) + 0.5 * (max(i) - min(i))')} AS INTEGER) AS at_50, CAST({d.bround('min(i) + 0.7 * (max(i) - min(i))')} AS INTEGER) AS at_70
FROM grid WHERE value > 0.1 GROUP BY scan""",
    "calibration_overall": lambda d: f"""WITH {CELLS}, checks AS (SELECT condition, avg(zero_fraction) <= 0.075 AS passed FROM cells GROUP BY condition)
SELECT count(*) AS scenarios, coalesce(bool_and(passed), false) AS overall, round(1 - 5e-2 / count(*), 6) AS coverage FROM checks""",
    "range_triplet": lambda d: f"""WITH {LONG}
SELECT roi, round(min(thickness), 6) AS low, round({d.pct('thickness', 0.5)}, 6) AS median, round(max(thickness), 6) AS high FROM long_table GROUP BY roi""",
}


def _hist(d) -> str:
    return f"""{d.voxels}{GRID},
pairs AS (SELECT a.grp, a.value AS va, b.value AS vb FROM grid a JOIN grid b ON a.scan = b.scan AND b.p = 63 - a.p),
bins AS (
  SELECT grp, CASE WHEN va = 0.6 THEN 7 ELSE CAST(floor((va + 0.6) / 0.15) AS INTEGER) END AS ba,
         CASE WHEN vb = 0.6 THEN 7 ELSE CAST(floor((vb + 0.6) / 0.15) AS INTEGER) END AS bb
  FROM pairs WHERE va BETWEEN -0.6 AND 0.6 AND vb BETWEEN -0.6 AND 0.6),
hist AS (SELECT grp, ba, bb, count(*) AS n FROM bins GROUP BY grp, ba, bb)"""
