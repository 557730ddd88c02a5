"""Independent DuckDB SQL for every ★ query, written against the raw driver views.

Each oracle inlines the shared CTEs below (stand-in log → incident summary →
proxy-scored incidents) and then states the operator's semantics directly in
SQL. Column names and types match the Spark results.
"""

from __future__ import annotations

LOG_CTE = """
log AS (
  SELECT
    printf('INC%07d', l.l_orderkey) AS number,
    CAST((l.l_shipdate::DATE - DATE '1970-01-01') AS BIGINT) * 17592186044416
      + CAST(l.l_linenumber AS BIGINT) * 1099511627776
      + (l.l_partkey * 1000003 + l.l_suppkey * 1009 + CAST(round(l.l_quantity * 100) AS BIGINT) * 31
         + CAST(round(l.l_extendedprice * 100) AS BIGINT)) % 1099511627776 AS event_seq,
    CAST(trunc(l.l_quantity) AS INTEGER) AS sys_mod_count,
    CAST(round(l.l_discount * 100) AS INTEGER) AS reassignment_count,
    CASE WHEN l.l_returnflag = 'R' THEN l.l_linenumber % 3 ELSE 0 END AS reopen_count,
    CASE WHEN l.l_linenumber = 1 THEN NULL ELSE p.p_type END AS category,
    p.p_brand AS subcategory,
    CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o.o_orderpriority END AS priority,
    CASE WHEN l.l_linenumber = 2 THEN NULL ELSE 'Group ' || l.l_suppkey END AS assignment_group,
    'Caller ' || o.o_custkey AS caller_id,
    'Opened by ' || (o.o_custkey % 50) AS opened_by,
    n.n_name AS location,
    o.o_orderdate + to_hours(l.l_linenumber - 1) AS opened_at,
    CASE WHEN l.l_linestatus = 'O' THEN NULL
         ELSE o.o_orderdate + to_hours(CAST(trunc(l.l_quantity) AS BIGINT) * l.l_linenumber) END AS resolved_at,
    l.l_shipdate AS sys_updated_at,
    CASE WHEN l.l_returnflag = 'N' AND l.l_linenumber % 2 = 0 THEN NULL
         WHEN l.l_linenumber = 7 AND l.l_returnflag = 'A' THEN 'unknown'
         WHEN l.l_quantity * l.l_linenumber > 110 THEN 'False'
         ELSE ' TRUE ' END AS made_sla
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

_FLAG = "lower(trim(last_flag, ' \t\n\r' || chr(11) || chr(12)))"

INC_CTE = f"""
inc_raw AS (
  SELECT number,
    CAST(count(*) AS BIGINT) AS total_events,
    max(sys_mod_count) AS sys_mod_count_max,
    avg(sys_mod_count) AS sys_mod_count_mean,
    max(reassignment_count) AS reassignment_count_max,
    max(reopen_count) AS reopen_count_max,
    arg_min(category, event_seq) FILTER (WHERE category IS NOT NULL) AS category,
    arg_min(subcategory, event_seq) FILTER (WHERE subcategory IS NOT NULL) AS subcategory,
    arg_min(priority, event_seq) FILTER (WHERE priority IS NOT NULL) AS priority,
    arg_min(assignment_group, event_seq) FILTER (WHERE assignment_group IS NOT NULL) AS assignment_group,
    arg_min(caller_id, event_seq) FILTER (WHERE caller_id IS NOT NULL) AS caller_id,
    arg_min(opened_by, event_seq) FILTER (WHERE opened_by IS NOT NULL) AS opened_by,
    arg_min(location, event_seq) FILTER (WHERE location IS NOT NULL) AS location,
    min(opened_at) AS opened_at_min,
    max(resolved_at) AS resolved_at_max,
    arg_max(made_sla, event_seq) FILTER (WHERE made_sla IS NOT NULL) AS last_flag
  FROM log GROUP BY number
),
inc AS (
  SELECT number, total_events, sys_mod_count_max, sys_mod_count_mean, reassignment_count_max,
    reopen_count_max, category, subcategory, priority, assignment_group, caller_id, opened_by, location,
    opened_at_min, resolved_at_max,
    date_diff('microsecond', opened_at_min, resolved_at_max) / 3600000000.0::DOUBLE AS resolution_hours,
    ({_FLAG} = 'true') AS made_sla,
    CAST(CASE WHEN {_FLAG} = 'true' THEN 0 ELSE 1 END AS INTEGER) AS sla_breached
  FROM inc_raw
  WHERE {_FLAG} IN ('true', 'false')
)"""

SCORED_CTE = """
bp AS (
  SELECT *, CAST(least(10000, greatest(0,
      300 + 250 * coalesce(reassignment_count_max, 0) + 700 * coalesce(reopen_count_max, 0)
      + 150 * coalesce(total_events, 0)
      + 15 * least(coalesce(CAST(trunc(resolution_hours) AS BIGINT), 0), 200))) AS BIGINT) AS score_bp
  FROM inc
),
scored AS (
  SELECT *,
    CAST(score_bp AS DOUBLE) / 10000.0 AS sla_breach_probability,
    CASE WHEN CAST(score_bp AS DOUBLE) / 10000.0 < 0.30 THEN 'Low'
         WHEN CAST(score_bp AS DOUBLE) / 10000.0 < 0.60 THEN 'Medium'
         ELSE 'High' END AS risk_band,
    CASE WHEN CAST(score_bp AS DOUBLE) / 10000.0 < 0.30
           THEN 'Normal queue. Keep updates clean and avoid unnecessary reassignment.'
         WHEN CAST(score_bp AS DOUBLE) / 10000.0 < 0.60
           THEN 'Monitor. Check missing details and confirm ownership early.'
         ELSE 'Escalate now. Assign correctly, reduce reassignment loops, senior review.' END
      AS recommended_action
  FROM bp
)"""


def with_ctes(select_sql: str, *ctes: str) -> str:
    """``WITH <ctes> <select>``; defaults to log + summary + scored."""
    chosen = ctes or (LOG_CTE, INC_CTE, SCORED_CTE)
    return "WITH " + ",".join(chosen) + "\n" + select_sql


def on_scored(select_sql: str, *extra_ctes: str) -> str:
    return with_ctes(select_sql, LOG_CTE, INC_CTE, SCORED_CTE, *extra_ctes)


__all__ = ["LOG_CTE", "INC_CTE", "SCORED_CTE", "with_ctes", "on_scored"]
