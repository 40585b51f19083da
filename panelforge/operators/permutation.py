"""Stratified whole-block permutations: gathers, integrity, duplicates, the null distribution and its p value.

The SQL-expressible assignments are rotations inside each stratum: replicate b gives the subject at position q
the block of the one at (q + b) mod n. Replicate 0 is the identity. Each replicate runs the whole nested
leave-one-out again on the gathered panel; the statistic of exact repeats is computed once and joined back.
"""

from __future__ import annotations

from panelforge.operators.model import FITS, LOSS, SELECTED, STATE, Staged
from panelforge.sources.adapters import PANEL, Chain

SCHEME = Chain([
    ("scheme", """  SELECT subject, stratum, row_number() OVER (PARTITION BY stratum ORDER BY subject) - 1 AS pos, count(*) OVER (PARTITION BY stratum) AS n
  FROM (SELECT n_nationkey AS subject, n_regionkey AS stratum FROM nation) t"""),
])


def assigned(replicates: int) -> Chain:
    reps = ", ".join(f"({b})" for b in range(replicates))
    return SCHEME + [
        ("reps", f"SELECT * FROM (VALUES {reps}) AS t(b)"),
        ("assigned", """SELECT b, o.subject AS outcome, d.subject AS donor, o.stratum AS so, d.stratum AS sd
  FROM reps CROSS JOIN scheme o JOIN scheme d ON d.stratum = o.stratum AND d.pos = (o.pos + b) % o.n"""),
    ]


NULL = Chain([
    ("gathered", """SELECT a.b, a.outcome AS s, y.r, x.x1, x.x2, y.y FROM assigned a JOIN base x ON x.s = a.donor JOIN base y ON y.s = a.outcome AND y.r = x.r"""),
])

BASE = PANEL.changed(("panel", "base"))

# One panel a replicate: subjects become (replicate, subject) pairs, so that the model's relations run unchanged.
KEYED = Chain([
    ("panel", """SELECT b * 1000 + s AS s, r, x1, x2, y FROM gathered"""),
])
_REPLICATE = "floor({} / 1000e0) = floor({} / 1000e0)"
_STATE = STATE.changed(
    ("FROM subjects a CROSS JOIN subjects b", f"FROM subjects a JOIN subjects b ON {_REPLICATE.format('a.s', 'b.s')}"),
    ("FROM splits JOIN panel ON panel.s <> o AND panel.s <> v", f"FROM splits JOIN panel ON panel.s <> o AND panel.s <> v AND {_REPLICATE.format('panel.s', 'o')}"),
    ("JOIN panel p ON p.r = m.r AND p.s <> m.o AND p.s <> m.v", f"JOIN panel p ON p.r = m.r AND p.s <> m.o AND p.s <> m.v AND {_REPLICATE.format('p.s', 'm.o')}"),
)


def replicated(replicates: int) -> Chain:
    stats = ("stats", "SELECT CAST(floor(subject / 1000e0) AS INTEGER) AS b, avg(d) AS t, count(CASE WHEN selected_lambda = -1 THEN 1 END) AS at_infinity FROM folds GROUP BY 1")
    return BASE + assigned(replicates) + NULL + KEYED + _STATE + FITS + LOSS + SELECTED + [stats]


BOOK = {
    "group_size": lambda d: f"""WITH {SCHEME}, k AS (SELECT stratum, count(*) AS n FROM scheme GROUP BY stratum), f AS (SELECT * FROM (VALUES (1, 1), (2, 2), (3, 6), (4, 24), (5, 120), (6, 720), (7, 5040), (8, 40320)) AS t(n, f))
SELECT k.stratum, k.n, f.f AS permutations FROM k JOIN f ON f.n = k.n""",
    "assignment_valid": lambda d: f"""WITH {assigned(5)} SELECT b, count(*) AS n, count(DISTINCT donor) = count(*) AS bijective, count(CASE WHEN so <> sd THEN 1 END) AS crossings FROM assigned GROUP BY b""",
    "identity_assignment": lambda d: f"""WITH {assigned(6)} SELECT b, count(CASE WHEN outcome <> donor THEN 1 END) = 0 AS identity_ FROM assigned GROUP BY b""",
    "assignment_translate": lambda d: f"""WITH {assigned(3)} SELECT b, o.n_name AS outcome, x.n_name AS donor FROM assigned JOIN nation o ON o.n_nationkey = outcome JOIN nation x ON x.n_nationkey = donor""",
    "block_gather": lambda d: Staged(BASE + assigned(3) + NULL, """ SELECT b, s, r, round(x1, 6) AS x1, round(x2, 6) AS x2, round(y, 6) AS y FROM gathered"""),
    "block_integrity": lambda d: Staged(BASE + assigned(3) + NULL, """ SELECT g.b, count(*) AS cells, count(CASE WHEN g.x1 <> x.x1 OR g.x2 <> x.x2 THEN 1 END) AS broken FROM gathered g JOIN assigned a ON a.b = g.b AND a.outcome = g.s JOIN base x ON x.s = a.donor AND x.r = g.r GROUP BY g.b"""),
    "replicate_statistic": lambda d: Staged(replicated(3), """ SELECT b, round(t, 9) AS t, at_infinity FROM stats"""),
    # replicates 5.. repeat 0.. in strata of five: evaluated once, joined back
    "null_distribution": lambda d: Staged(replicated(4), """, all_ AS (SELECT * FROM (VALUES (1, 1), (2, 2), (3, 3), (4, 0), (5, 1), (6, 2)) AS t(replicate, b))
SELECT replicate, all_.b, round(t, 9) AS t FROM all_ JOIN stats ON stats.b = all_.b"""),
    "permutation_test": lambda d: Staged(replicated(4), """, o AS (SELECT t FROM stats WHERE b = 0)
SELECT round(max(o.t), 9) AS t_obs, count(CASE WHEN s.t >= o.t THEN 1 END) AS k, count(*) AS b, round((1 + count(CASE WHEN s.t >= o.t THEN 1 END)) / (count(*) + 1e0), 6) AS p_value FROM stats s CROSS JOIN o WHERE s.b > 0"""),
    "p_value": lambda d: """SELECT conv_id, count(CASE WHEN length(text) >= 100 THEN 1 END) AS k, count(*) AS b, round((1 + count(CASE WHEN length(text) >= 100 THEN 1 END)) / (count(*) + 1e0), 6) AS p FROM conversations GROUP BY conv_id""",
    "study_tasks": lambda d: """SELECT n_nationkey AS scenario, o.simulation, n_nationkey * 100 + o.simulation AS task FROM nation CROSS JOIN (SELECT DISTINCT CAST(p_size AS INTEGER) AS simulation FROM part) o""",
    "attainable_level": lambda d: """SELECT l_orderkey, l_linenumber, l_partkey, round(floor(5e-2 * (CAST(l_quantity AS INTEGER) + 1) + 1e-9) / (l_quantity + 1), 6) AS attainable FROM lineitem""",
}
