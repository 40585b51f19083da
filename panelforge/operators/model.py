"""Group-centred ridge under nested leave-one-subject-out, as one relational plan.

A split (o, v) trains on all subjects but o and v and is judged on v; v = o is the outer refit. Splits, not
rows, are multiplied: a cell takes part in every split that trains on it, and everything fitted (means, scales,
omissions, slopes) is an aggregate by split. The penalty grid uses -1 for infinity, which returns the baseline.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from panelforge.functions.shared import materialised
from panelforge.sources.adapters import PANEL, Chain, run_sql

#: The penalty grid (-1 is infinity).
GRID = (0, 0.01, 0.1, 1, 10, 100, -1)
LAMBDAS = Chain([("lambdas", "SELECT CAST(l AS DOUBLE) AS lam FROM (VALUES " + ", ".join(f"({x})" for x in GRID) + ") AS g(l)")])

SPLITS = Chain([
    ("subjects", """SELECT DISTINCT s FROM panel"""),
    ("splits", """SELECT a.s AS o, b.s AS v FROM subjects a CROSS JOIN subjects b"""),
])

STATE = SPLITS + [
    ("means", """  SELECT o, v, r, CASE WHEN min(x1) = max(x1) THEN min(x1) ELSE avg(x1) END AS m1, CASE WHEN min(x2) = max(x2) THEN min(x2) ELSE avg(x2) END AS m2, avg(y) AS my
  FROM splits JOIN panel ON panel.s <> o AND panel.s <> v GROUP BY o, v, r"""),
    ("centred", """  SELECT m.o, m.v, m.r, p.s, p.x1 - m1 AS d1, p.x2 - m2 AS d2, p.y - my AS u
  FROM means m JOIN panel p ON p.r = m.r AND p.s <> m.o AND p.s <> m.v"""),
    ("gram", """  SELECT o, v, sqrt(avg(d1 * d1)) AS s1, sqrt(avg(d2 * d2)) AS s2, avg(d1 * d2) AS c12, avg(d1 * u) AS g1, avg(d2 * u) AS g2, count(*) AS n
  FROM centred GROUP BY o, v"""),
    ("scaled", """  SELECT o, v, s1, s2, n, s1 = 0 AS omit1, s2 = 0 AS omit2, CASE WHEN s1 = 0 OR s2 = 0 THEN 0 ELSE c12 / (s1 * s2) END AS rho,
         CASE WHEN s1 = 0 THEN 0 ELSE g1 / s1 END AS b1, CASE WHEN s2 = 0 THEN 0 ELSE g2 / s2 END AS b2 FROM gram"""),
]

FITS = LAMBDAS + [
    ("solved", """  SELECT o, v, lam, s1, s2, omit1, omit2, rho, b1, b2, (1 + lam) * (1 + lam) - rho * rho AS det FROM scaled CROSS JOIN lambdas"""),
    ("fits", """  SELECT o, v, lam, s1, s2, omit1, omit2,
         CASE WHEN lam = -1 OR omit1 THEN 0 WHEN omit2 THEN b1 / (1 + lam) WHEN det <= 1e-14 THEN b1 / 2
              ELSE ((1 + lam) * b1 - rho * b2) / det END AS beta1,
         CASE WHEN lam = -1 OR omit2 THEN 0 WHEN omit1 THEN b2 / (1 + lam) WHEN det <= 1e-14 THEN b2 / 2
              ELSE ((1 + lam) * b2 - rho * b1) / det END AS beta2
  FROM solved"""),
]

LOSS = Chain([
    ("held", """  SELECT m.o, m.v, m.r, CASE WHEN omit1 THEN 0 ELSE (p.x1 - m1) / s1 END AS z1, CASE WHEN omit2 THEN 0 ELSE (p.x2 - m2) / s2 END AS z2, my, p.y
  FROM means m JOIN scaled k ON k.o = m.o AND k.v = m.v JOIN panel p ON p.r = m.r AND p.s = m.v"""),
    ("losses", """  SELECT h.o, h.v, f.lam, avg((h.y - CASE WHEN f.lam = -1 THEN my ELSE my + h.z1 * f.beta1 + h.z2 * f.beta2 END)
                              * (h.y - CASE WHEN f.lam = -1 THEN my ELSE my + h.z1 * f.beta1 + h.z2 * f.beta2 END)) AS loss
  FROM held h JOIN fits f ON f.o = h.o AND f.v = h.v GROUP BY h.o, h.v, f.lam"""),
])

SELECTED = Chain([
    ("scores", """SELECT o, lam, avg(loss) AS score FROM losses WHERE o <> v GROUP BY o, lam"""),
    ("best", """SELECT o, min(score) AS low, max(CASE WHEN lam = -1 THEN score END) AS base FROM scores GROUP BY o"""),
    ("chosen", """  SELECT scores.o, max(CASE WHEN lam = -1 THEN CAST(1e300 AS DOUBLE) ELSE lam END) AS lam
  FROM scores JOIN best ON best.o = scores.o WHERE score - low <= 1e-12 * base GROUP BY scores.o"""),
    ("folds", """  SELECT c.o AS subject, CASE WHEN c.lam = CAST(1e300 AS DOUBLE) THEN -1 ELSE c.lam END AS selected_lambda,
         b.loss AS baseline_mse, k.loss AS ridge_mse, b.loss - k.loss AS d
  FROM chosen c JOIN losses b ON b.o = c.o AND b.v = c.o AND b.lam = -1
       JOIN losses k ON k.o = c.o AND k.v = c.o AND k.lam = CASE WHEN c.lam = CAST(1e300 AS DOUBLE) THEN -1 ELSE c.lam END"""),
])

LOSO = PANEL + STATE + FITS + LOSS + SELECTED

#: The same panel with an outcome that nothing explains: every subject ends at infinity.
NULL_PANEL = PANEL.changed(("l_extendedprice * l_discount / 1000 AS value", "l_discount AS value"))
NULL_LOSO = NULL_PANEL + STATE + FITS + LOSS + SELECTED

#: Sensitivity runs: one condition as the outcome; without the first subject.
ONE_CONDITION = LOSO.changed(("cond_mean AS y FROM long_table", "cond_a AS y FROM long_table"))
COHORT = LOSO.changed(("cond_mean AS y FROM long_table", "cond_mean AS y FROM long_table WHERE subject <> 0"))


@dataclass(frozen=True)
class Staged:
    """Relations, and the text that goes on behind them (further relations, or the SELECT)."""

    relations: Chain
    rest: str

    def __str__(self) -> str:
        return f"WITH {self.relations}{self.rest}"


#: Relations that several others read: cells by split, small against the lines that they come from.
KEPT = {"panel", "base", "means", "scaled", "losses", "folds", "stats"}


def staged(spark: SparkSession, sf_dir: str, query: Staged | str) -> DataFrame:
    """Run a query with those of its relations that several others read checkpointed, so that each is computed once."""
    if isinstance(query, str):
        return run_sql(spark, sf_dir, query)
    tag, views, head = uuid.uuid4().hex, [], Chain()
    for name, body in query.relations:
        head = head + [(name, body)]
        if name in KEPT:
            view = f"{name}_{tag}"
            run_sql(spark, sf_dir, f"WITH {head} SELECT * FROM {name}").transform(materialised).createOrReplaceTempView(view)
            views.append(view)
            # what led to it is not needed again where all that follows reads the kept relations; unread ones cost nothing
            head = Chain((n, b) for n, b in head if n != name) + [(name, f"SELECT * FROM {view}")]
    found = run_sql(spark, sf_dir, f"WITH {head}{query.rest}")
    for view in views:  # the plan has been resolved: the names are free again
        spark.catalog.dropTempView(view)
    return found


BOOK = {
    "lambda_grid": lambda d: Staged(LAMBDAS, f""" SELECT n.n_name AS fold, lam, lam = -1 AS infinite FROM nation n CROSS JOIN lambdas"""),
    "grid_complete": lambda d: Staged(LOSO, f"""
SELECT o, count(DISTINCT lam) AS candidates, count(*) AS rows_, count(*) = 7 AND count(DISTINCT lam) = 7 AS complete FROM scores GROUP BY o"""),
    "loso_splits": lambda d: Staged(PANEL + SPLITS, f""" SELECT a.s AS held_out, b.s AS training FROM subjects a JOIN subjects b ON a.s <> b.s"""),
    "nested_loso_splits": lambda d: Staged(PANEL + SPLITS, f""" SELECT o, v, count(*) AS n_training FROM splits JOIN subjects ON s <> o AND s <> v WHERE o <> v GROUP BY o, v"""),
    "split_grid": lambda d: Staged(PANEL + SPLITS + LAMBDAS, f""" SELECT o, v, lam FROM splits CROSS JOIN lambdas WHERE o <> v"""),
    "fold_completeness": lambda d: Staged(PANEL + SPLITS, f""",
training AS (SELECT a.s AS o, b.s AS t FROM subjects a JOIN subjects b ON a.s <> b.s)
SELECT o, count(DISTINCT t) AS n_training, count(DISTINCT t) = (SELECT count(*) - 1 FROM subjects) AND count(CASE WHEN t = o THEN 1 END) = 0 AS complete FROM training GROUP BY o"""),
    "feature_scales": lambda d: Staged(PANEL + STATE, f""" SELECT o, v, round(s1, 6) AS scale1, round(s2, 6) AS scale2, omit1, omit2, n FROM scaled"""),
    "standardise": lambda d: Staged(PANEL + STATE, f"""
SELECT c.o, c.r, c.s, round(CASE WHEN omit1 THEN 0 ELSE d1 / s1 END, 6) AS z1, round(CASE WHEN omit2 THEN 0 ELSE d2 / s2 END, 6) AS z2
FROM centred c JOIN scaled k ON k.o = c.o AND k.v = c.v WHERE c.o = c.v"""),
    "roi_baseline": lambda d: Staged(PANEL + STATE, f""" SELECT o, r, round(my, 6) AS baseline FROM means WHERE o = v"""),
    "ridge_fit_f2": lambda d: Staged(PANEL + STATE + FITS, f""" SELECT o, v, lam, round(beta1, 9) AS beta1, round(beta2, 9) AS beta2 FROM fits"""),
    "ridge_predict": lambda d: Staged(PANEL + STATE + FITS + LOSS, f"""
SELECT h.o, h.r, f.lam, round(CASE WHEN f.lam = -1 THEN my ELSE my + z1 * beta1 + z2 * beta2 END, 6) AS predicted
FROM held h JOIN fits f ON f.o = h.o AND f.v = h.v WHERE h.o = h.v"""),
    "subject_mse": lambda d: Staged(PANEL + STATE + FITS + LOSS, f""" SELECT o AS subject, lam, round(loss, 9) AS mse FROM losses WHERE o = v"""),
    "candidate_score": lambda d: Staged(LOSO, f""" SELECT o, lam, round(score, 9) AS score FROM scores"""),
    "select_lambda": lambda d: Staged(LOSO, f""" SELECT subject, selected_lambda FROM folds"""),
    "inner_losses": lambda d: Staged(LOSO, f""" SELECT o AS outer_subject, v AS validation, lam, round(loss, 9) AS loss FROM losses WHERE o <> v"""),
    "nested_loso": lambda d: Staged(LOSO, f""" SELECT subject, selected_lambda, round(baseline_mse, 9) AS baseline_mse, round(ridge_mse, 9) AS ridge_mse, round(d, 9) AS d FROM folds"""),
    "nested_loso_null": lambda d: Staged(NULL_LOSO, f""" SELECT subject, selected_lambda, round(baseline_mse, 12) AS baseline_mse, round(ridge_mse, 12) AS ridge_mse, d = 0 AS exactly_baseline FROM folds"""),
    "outer_folds": lambda d: Staged(LOSO, f""" SELECT n_name AS subject_id, selected_lambda, round(baseline_mse, 9) AS baseline_mse, round(ridge_mse, 9) AS ridge_mse, round(d, 9) AS d_s FROM folds JOIN nation ON n_nationkey = subject"""),
    "loso_summary": lambda d: Staged(LOSO, f""" SELECT count(*) AS folds, round(avg(d), 9) AS t, round(avg(baseline_mse), 9) AS baseline_mse, round(avg(ridge_mse), 9) AS ridge_mse FROM folds"""),
    "descriptives_d1": lambda d: Staged(LOSO, f""",
spread AS (SELECT s, var_pop(y) AS var_y FROM panel GROUP BY s),
e AS (SELECT h.o, h.y - (my + CASE WHEN f.selected_lambda = -1 THEN 0 ELSE z1 * beta1 + z2 * beta2 END) AS e
      FROM held h JOIN folds f ON f.subject = h.o JOIN fits k ON k.o = h.o AND k.v = h.v AND k.lam = f.selected_lambda WHERE h.o = h.v)
SELECT f.subject, round(CASE WHEN var_y = 0 THEN NULL ELSE 1 - f.ridge_mse / var_y END, 6) AS r2, round(CASE WHEN var_y = 0 THEN NULL ELSE f.d / var_y END, 6) AS delta_r2,
       round(avg(abs(e.e)), 6) AS mae, round(sqrt(avg(e.e * e.e)), 6) AS rmse
FROM folds f JOIN spread ON spread.s = f.subject JOIN e ON e.o = f.subject GROUP BY f.subject, var_y, f.ridge_mse, f.d"""),
    "level_pattern": lambda d: Staged(LOSO, f""",
e AS (SELECT h.o, h.y - my AS e FROM held h WHERE h.o = h.v)
SELECT o AS subject, round(avg(e) * avg(e), 9) AS level, round(var_pop(e), 9) AS pattern, round(avg(e * e), 9) AS mse FROM e GROUP BY o"""),
    "roi_correlations": lambda d: Staged(PANEL, f""" SELECT r, round(corr(x1, y), 6) AS r_thickness, round(corr(x2, y), 6) AS r_area FROM panel GROUP BY r"""),
    "slope_distribution": lambda d: Staged(LOSO, f""",
b AS (SELECT f.beta1, f.beta2 FROM folds c JOIN fits f ON f.o = c.subject AND f.v = c.subject AND f.lam = c.selected_lambda)
SELECT round({d.pct('beta1', 0.25)}, 6) AS b1_p25, round({d.pct('beta1', 0.5)}, 6) AS b1_p50, round({d.pct('beta1', 0.75)}, 6) AS b1_p75,
       round({d.pct('beta2', 0.25)}, 6) AS b2_p25, round({d.pct('beta2', 0.5)}, 6) AS b2_p50, round({d.pct('beta2', 0.75)}, 6) AS b2_p75 FROM b"""),
    "sens_cohort": lambda d: Staged(COHORT, f"""
SELECT subject, selected_lambda, round(baseline_mse, 9) AS baseline_mse, round(ridge_mse, 9) AS ridge_mse FROM folds"""),
    "sens_condition": lambda d: Staged(ONE_CONDITION, f"""
SELECT subject, selected_lambda, round(baseline_mse, 9) AS baseline_mse, round(ridge_mse, 9) AS ridge_mse FROM folds"""),
    "panel_validate": lambda d: Staged(PANEL, f"""
SELECT count(DISTINCT s) AS subjects, count(DISTINCT r) AS rois, count(*) AS cells, count(*) = count(DISTINCT s) * count(DISTINCT r) AS aligned,
       count(CASE WHEN x1 IS NULL OR x2 IS NULL OR y IS NULL OR isnan(x1) OR isnan(x2) OR isnan(y) THEN 1 END) AS bad, count(DISTINCT s) >= 3 AS enough FROM panel"""),
    "loo_mean": lambda d: Staged(PANEL, f"""
SELECT s, r, round((sum(y) OVER (PARTITION BY r) - y) / (count(*) OVER (PARTITION BY r) - 1), 6) AS others_mean FROM panel"""),
    "roi_centre": lambda d: Staged(PANEL, f""" SELECT s, r, round(x1 - avg(x1) OVER (PARTITION BY r), 6) AS centred FROM panel"""),
}
