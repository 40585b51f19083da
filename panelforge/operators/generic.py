"""Engine-generic operations on the event and order tables (extensions: not part of the panel analysis)."""

from __future__ import annotations

BOOK = {
    "generic_cube": lambda d: """SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "generic_rollup": lambda d: """SELECT coalesce(o_orderpriority, 'all') AS priority, coalesce(o_orderstatus, 'all') AS status, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""",
    "generic_window_rank": lambda d: """SELECT o_orderkey, o_custkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS quarter FROM orders""",
    "generic_running_sum": lambda d: """SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running FROM events""",
    "generic_set_ops": lambda d: """SELECT 'both' AS kind, k, count(*) AS n FROM (SELECT l_suppkey AS k FROM lineitem INTERSECT ALL SELECT l_partkey AS k FROM lineitem) a GROUP BY k UNION ALL SELECT 'less' AS kind, k, count(*) AS n FROM (SELECT l_suppkey AS k FROM lineitem EXCEPT ALL SELECT l_partkey AS k FROM lineitem) b GROUP BY k""",
    "generic_semi_anti": lambda d: """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS ordered FROM customer""" if d.name == "duck" else """SELECT c_custkey, o.k IS NOT NULL AS ordered FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey""",
    "generic_tumbling": lambda d: """SELECT CAST(date_trunc('day', ts) AS DATE) AS day_, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, event_type""",
}
