"""DuckDB oracle SQL per registered query (see ``oracles`` for the shared CTEs)."""

from __future__ import annotations

from breachlens.oracles import INC_CTE, LOG_CTE, on_scored, with_ctes

_SUMMARY_COLS = """number, total_events, sys_mod_count_max, sys_mod_count_mean, reassignment_count_max,
  reopen_count_max, category, subcategory, priority, assignment_group, caller_id, opened_by, location,
  opened_at_min, resolved_at_max, resolution_hours, made_sla, sla_breached"""

_FLAG = "lower(trim(last_flag, ' \t\n\r' || chr(11) || chr(12)))"

ORACLES: dict[str, str] = {
    "incident_summary": with_ctes(f"SELECT {_SUMMARY_COLS} FROM inc", LOG_CTE, INC_CTE),
    "ranked_incidents": on_scored("SELECT * FROM scored ORDER BY sla_breach_probability DESC, number"),
    "total_events": with_ctes("SELECT number, CAST(count(*) AS BIGINT) AS total_events FROM log GROUP BY number",
                              LOG_CTE),
    "sys_mod_stats": with_ctes("""
SELECT number, max(sys_mod_count) AS sys_mod_count_max, avg(sys_mod_count) AS sys_mod_count_mean
FROM log GROUP BY number""", LOG_CTE),
    "first_non_null_attrs": with_ctes("""
SELECT number,
  arg_min(category, event_seq) FILTER (WHERE category IS NOT NULL) AS category,
  arg_min(subcategory, event_seq) FILTER (WHERE subcategory IS NOT NULL) AS subcategory,
  arg_min(priority, event_seq) FILTER (WHERE priority IS NOT NULL) AS priority,
  arg_min(assignment_group, event_seq) FILTER (WHERE assignment_group IS NOT NULL) AS assignment_group,
  arg_min(caller_id, event_seq) FILTER (WHERE caller_id IS NOT NULL) AS caller_id,
  arg_min(opened_by, event_seq) FILTER (WHERE opened_by IS NOT NULL) AS opened_by,
  arg_min(location, event_seq) FILTER (WHERE location IS NOT NULL) AS location
FROM log GROUP BY number""", LOG_CTE),
    "last_sla_flag": with_ctes(f"""
SELECT number, last_flag,
  CASE WHEN {_FLAG} = 'true' THEN true WHEN {_FLAG} = 'false' THEN false END AS made_sla,
  CAST(CASE WHEN {_FLAG} = 'true' THEN 0 WHEN {_FLAG} = 'false' THEN 1 END AS INTEGER) AS sla_breached
FROM (SELECT number, arg_max(made_sla, event_seq) FILTER (WHERE made_sla IS NOT NULL) AS last_flag
      FROM log GROUP BY number)""", LOG_CTE),
    "resolution_hours": with_ctes("""
SELECT number, opened_at_min, resolved_at_max,
  date_diff('microsecond', opened_at_min, resolved_at_max) / 3600000000.0::DOUBLE AS resolution_hours
FROM (SELECT number, min(opened_at) AS opened_at_min, max(resolved_at) AS resolved_at_max
      FROM log GROUP BY number)""", LOG_CTE),
    "band_counts": on_scored("""
SELECT d.risk_band, d.band_order, CAST(coalesce(c.n, 0) AS BIGINT) AS incidents,
  coalesce(c.n, 0) * 100.0::DOUBLE / sum(coalesce(c.n, 0)) OVER () AS share_pct
FROM (VALUES ('High', 0), ('Medium', 1), ('Low', 2)) d(risk_band, band_order)
LEFT JOIN (SELECT risk_band, count(*) AS n FROM scored GROUP BY risk_band) c USING (risk_band)"""),
    "score_quantiles": on_scored("""
SELECT quantile_cont(sla_breach_probability, 0.10) AS p10,
       quantile_cont(sla_breach_probability, 0.50) AS p50,
       quantile_cont(sla_breach_probability, 0.90) AS p90
FROM scored"""),
}

__all__ = ["ORACLES"]


def _edge_sum(op: str, n: int, p: str = "p") -> str:
    return " + ".join(f"CASE WHEN {p} {op} {i}.0::DOUBLE * step + lo THEN 1 ELSE 0 END" for i in range(1, n))


_HIST = f"""
, mm AS (SELECT CAST(min(sla_breach_probability) AS DOUBLE) AS lo0, CAST(max(sla_breach_probability) AS DOUBLE) AS hi0
         FROM scored)
, rng AS (SELECT lo, hi, (hi - lo) / 20.0::DOUBLE AS step FROM (
    SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
           CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM mm))
, cnt AS (SELECT {_edge_sum('>=', 20)} AS bin, count(*) AS n
          FROM (SELECT sla_breach_probability AS p FROM scored WHERE sla_breach_probability IS NOT NULL), rng
          GROUP BY 1)
SELECT CAST(g.i AS INTEGER) AS bin,
  CASE WHEN g.i = 20 THEN hi ELSE CAST(g.i AS DOUBLE) * step + lo END AS lower,
  CASE WHEN g.i + 1 = 20 THEN hi ELSE CAST(g.i + 1 AS DOUBLE) * step + lo END AS upper,
  CAST(coalesce(cnt.n, 0) AS BIGINT) AS incidents
FROM range(0, 20) g(i) CROSS JOIN rng LEFT JOIN cnt ON cnt.bin = g.i"""

_CALIB = f"""
, mm AS (SELECT CAST(min(sla_breach_probability) AS DOUBLE) AS lo0, CAST(max(sla_breach_probability) AS DOUBLE) AS hi0
         FROM scored)
, rng AS (SELECT lo, (hi - lo) / 10.0::DOUBLE AS step FROM (
    SELECT CASE WHEN lo0 = hi0 THEN lo0 - CASE WHEN lo0 <> 0 THEN abs(lo0) * 0.001 ELSE 0.001 END ELSE lo0 END AS lo,
           CASE WHEN lo0 = hi0 THEN hi0 + CASE WHEN hi0 <> 0 THEN abs(hi0) * 0.001 ELSE 0.001 END ELSE hi0 END AS hi
    FROM mm))
SELECT CAST(1 + {_edge_sum('>', 10)} AS INTEGER) AS bin,
  round_even(avg(p), 3) AS avg_pred,
  round_even(avg(CAST(y AS DOUBLE)), 3) AS actual_rate,
  CAST(count(y) AS BIGINT) AS n
FROM (SELECT sla_breach_probability AS p, sla_breached AS y FROM scored), rng
GROUP BY 1 HAVING count(y) > 0"""

_CM = """
, c AS (SELECT
    count(*) FILTER (WHERE sla_breached = 0 AND NOT sla_breach_probability >= 0.5) AS tn,
    count(*) FILTER (WHERE sla_breached = 0 AND sla_breach_probability >= 0.5) AS fp,
    count(*) FILTER (WHERE sla_breached = 1 AND NOT sla_breach_probability >= 0.5) AS fn,
    count(*) FILTER (WHERE sla_breached = 1 AND sla_breach_probability >= 0.5) AS tp
  FROM scored)"""

_R0 = "coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


def _r0(a: str, b: str) -> str:
    return _R0.format(a=a, b=b)


_METRICS = (f"{_r0('tp', 'tp + fp')} AS precision, {_r0('tp', 'tp + fn')} AS recall, "
            f"{_r0('2 * tp', '2 * tp + fp + fn')} AS f1, CAST(tp + fp AS BIGINT) AS flagged, "
            "CAST(tp + fp + fn + tn AS BIGINT) AS total")

_P1, _R1, _F1 = _r0("tp", "tp + fp"), _r0("tp", "tp + fn"), _r0("2 * tp", "2 * tp + fp + fn")
_P0, _R0c, _F0 = _r0("tn", "tn + fn"), _r0("tn", "tn + fp"), _r0("2 * tn", "2 * tn + fn + fp")
_W = lambda a, b: _r0(f"{a} * (tn + fp) + {b} * (tp + fn)", "tn + fp + tp + fn")

ORACLES.update({
    "score_quantiles_sketched": on_scored("""
SELECT name, CAST(count(sla_breach_probability) AS BIGINT) AS n, TRUE AS within
FROM scored, (VALUES ('p10'), ('p50'), ('p90')) AS q(name) GROUP BY name"""),
    "summary_by_batches": with_ctes(f"SELECT {_SUMMARY_COLS} FROM inc", LOG_CTE, INC_CTE),
    "score_histogram": on_scored(_HIST),
    "calibration_table": on_scored(_CALIB),
    "priority_band_crosstab": on_scored("""
SELECT priority,
  CAST(count(*) FILTER (WHERE risk_band = 'High') AS BIGINT) AS "High",
  CAST(count(*) FILTER (WHERE risk_band = 'Medium') AS BIGINT) AS "Medium",
  CAST(count(*) FILTER (WHERE risk_band = 'Low') AS BIGINT) AS "Low"
FROM scored WHERE priority IS NOT NULL AND risk_band IS NOT NULL GROUP BY priority"""),
    "top_groups": on_scored("""
SELECT assignment_group, round_even(avg(sla_breach_probability), 12) AS avg_risk_score,
  CAST(count(*) AS BIGINT) AS incidents
FROM scored WHERE assignment_group IS NOT NULL GROUP BY assignment_group
ORDER BY CAST(sum(score_bp) AS DOUBLE) / count(*) DESC, assignment_group LIMIT 10"""),
    "top_categories": on_scored("""
SELECT category, round_even(avg(sla_breach_probability), 12) AS avg_risk_score,
  CAST(count(*) AS BIGINT) AS incidents
FROM scored WHERE category IS NOT NULL GROUP BY category
ORDER BY CAST(sum(score_bp) AS DOUBLE) / count(*) DESC, category LIMIT 10"""),
    "confusion_matrix": on_scored(_CM + """
SELECT * FROM (
  SELECT 0 AS actual, 0 AS predicted, CAST(tn AS BIGINT) AS n FROM c UNION ALL
  SELECT 0, 1, CAST(fp AS BIGINT) FROM c UNION ALL
  SELECT 1, 0, CAST(fn AS BIGINT) FROM c UNION ALL
  SELECT 1, 1, CAST(tp AS BIGINT) FROM c)"""),
    "threshold_metrics": on_scored(_CM + f"""
SELECT 0.5::DOUBLE AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
  CAST(tn AS BIGINT) AS tn, {_METRICS} FROM c"""),
    "threshold_sweep": on_scored(f"""
, c AS (SELECT t.threshold,
    count(*) FILTER (WHERE s.sla_breached = 1 AND s.sla_breach_probability >= t.threshold) AS tp,
    count(*) FILTER (WHERE s.sla_breached = 0 AND s.sla_breach_probability >= t.threshold) AS fp,
    count(*) FILTER (WHERE s.sla_breached = 1 AND NOT s.sla_breach_probability >= t.threshold) AS fn,
    count(*) FILTER (WHERE s.sla_breached = 0 AND NOT s.sla_breach_probability >= t.threshold) AS tn
  FROM (SELECT CAST(k AS DOUBLE) / 20.0::DOUBLE AS threshold FROM range(1, 20) r(k)) t CROSS JOIN scored s
  GROUP BY t.threshold)
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
  CAST(tn AS BIGINT) AS tn, {_METRICS} FROM c"""),
    "roc_auc": on_scored("""
, d AS (SELECT sla_breach_probability AS p, count(*) FILTER (WHERE sla_breached = 1) AS pos,
          count(*) FILTER (WHERE sla_breached = 0) AS neg
        FROM scored WHERE sla_breached IS NOT NULL GROUP BY 1)
, r AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          AS neg_before FROM d)
SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
    CAST(sum(pos * (2 * neg_before + neg)) AS DOUBLE)
    / (2.0::DOUBLE * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS roc_auc,
  CAST(coalesce(sum(pos), 0) AS BIGINT) AS n_pos, CAST(coalesce(sum(neg), 0) AS BIGINT) AS n_neg
FROM r"""),
    "classification_report": on_scored(_CM + f"""
SELECT class, round_even(precision, 3) AS precision, round_even(recall, 3) AS recall, round_even(f1, 3) AS f1,
  CAST(support AS BIGINT) AS support FROM (
  SELECT '0' AS class, {_P0} AS precision, {_R0c} AS recall, {_F0} AS f1, tn + fp AS support FROM c
  UNION ALL SELECT '1', {_P1}, {_R1}, {_F1}, tp + fn FROM c
  UNION ALL SELECT 'accuracy', NULL, NULL, {_r0('tp + tn', 'tp + tn + fp + fn')}, tp + tn + fp + fn FROM c
  UNION ALL SELECT 'macro avg', ({_P0} + {_P1}) / 2, ({_R0c} + {_R1}) / 2, ({_F0} + {_F1}) / 2, tp + tn + fp + fn FROM c
  UNION ALL SELECT 'weighted avg', {_W(_P0, _P1)}, {_W(_R0c, _R1)}, {_W(_F0, _F1)}, tp + tn + fp + fn FROM c)"""),
})

ORACLES["kpi_overview"] = on_scored("""
SELECT CAST(count(*) AS BIGINT) AS total_incidents,
  round_even(avg(sla_breach_probability), 12) AS avg_risk_score,
  round_even(avg(CAST(sla_breached AS DOUBLE)), 12) AS breach_rate,
  CAST(count(*) FILTER (WHERE risk_band = 'High') AS BIGINT) AS high_count,
  CAST(count(*) FILTER (WHERE risk_band = 'Medium') AS BIGINT) AS medium_count,
  CAST(count(*) FILTER (WHERE risk_band = 'Low') AS BIGINT) AS low_count,
  CAST(count(*) FILTER (WHERE risk_band = 'High') AS DOUBLE) / count(*) AS high_share,
  CAST(count(*) FILTER (WHERE risk_band = 'Medium') AS DOUBLE) / count(*) AS medium_share,
  CAST(count(*) FILTER (WHERE risk_band = 'Low') AS DOUBLE) / count(*) AS low_share
FROM scored""")

# ── sources, projections, filters, lists, explanations, ML preparation ───────

_LOG_COLS = ("number, event_seq, sys_mod_count, reassignment_count, reopen_count, category, subcategory, priority, "
             "assignment_group, caller_id, opened_by, location, opened_at, resolved_at, sys_updated_at, made_sla")
_RAW_FLAG = "lower(trim(made_sla, ' \t\n\r' || chr(11) || chr(12)))"
_SCORED_COLS = ("number, total_events, sys_mod_count_max, sys_mod_count_mean, reassignment_count_max, "
                "reopen_count_max, category, subcategory, priority, assignment_group, caller_id, opened_by, location, "
                "opened_at_min, resolved_at_max, resolution_hours, made_sla, sla_breached, score_bp, "
                "sla_breach_probability, risk_band, recommended_action")
_LIST_COLS = ("number, sla_breach_probability, risk_band, recommended_action, priority, assignment_group, category, "
              "subcategory, total_events, reassignment_count_max, reopen_count_max, resolution_hours")
_LIST_WHERE = "risk_band IN ('High', 'Medium') AND sla_breach_probability >= 0.35"

_SIG = (("reassignment_count_max", "Reassignment count", "ticket changed hands too many times"),
        ("reopen_count_max", "Reopen count", "fix did not stick the first time"),
        ("resolution_hours", "Resolution time", "slow closure pattern"),
        ("total_events", "Total events", "lots of activity with no clear closure"))


def _driver_case(col: str, label: str, note: str) -> str:
    v, m, q = f"CAST({col} AS DOUBLE)", f"{col}_median", f"{col}_q75"
    return (f"CASE WHEN {v} IS NOT NULL AND {m} IS NOT NULL AND {m} <> 0 AND {q} IS NOT NULL AND {q} <> 0 "
            f"AND {v} >= {q} AND {v} > {m} THEN '**{label}** is ' || printf('%g', {v}) || ' ({note})' END")


_STATS = ", st AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS {c}_median, quantile_cont({c}, 0.75) AS {c}_q75" for c, _, _ in _SIG) + " FROM scored)"

_PRIO = ("CASE WHEN contains(priority, '1') OR contains(priority, 'Critical') "
         "THEN '**Priority is Critical.** Needs immediate escalation.' "
         "WHEN contains(priority, '2') OR contains(priority, 'High') "
         "THEN '**Priority is High.** Worth escalating early.' END")

_FACTS = """number, sla_breach_probability, risk_band AS risk_level, recommended_action,
  CAST(trunc(CAST(total_events AS DOUBLE)) AS BIGINT) AS total_events,
  CAST(trunc(CAST(reassignment_count_max AS DOUBLE)) AS BIGINT) AS reassignment_count_max,
  CAST(trunc(CAST(reopen_count_max AS DOUBLE)) AS BIGINT) AS reopen_count_max,
  resolution_hours, priority, assignment_group, category"""

_SPLIT = """
, cls AS (SELECT sla_breached, count(*) AS n_c FROM inc GROUP BY 1)
, q1 AS (SELECT sla_breached, n_c, n, n - CAST(ceil(0.2::DOUBLE * CAST(n AS DOUBLE)) AS BIGINT) AS n_train
         FROM (SELECT *, sum(n_c) OVER () AS n FROM cls))
, q2 AS (SELECT *, floor(CAST(n_c AS DOUBLE) / CAST(n AS DOUBLE) * CAST(n_train AS DOUBLE)) AS fl,
           CAST(n_c AS DOUBLE) / CAST(n AS DOUBLE) * CAST(n_train AS DOUBLE)
           - floor(CAST(n_c AS DOUBLE) / CAST(n AS DOUBLE) * CAST(n_train AS DOUBLE)) AS rem FROM q1)
, q3 AS (SELECT *, n_train - sum(fl) OVER () AS need, row_number() OVER (ORDER BY rem DESC, sla_breached) AS rr FROM q2)
, quota AS (SELECT sla_breached, n_c - (CAST(fl AS BIGINT) + CASE WHEN rr <= need THEN 1 ELSE 0 END) AS test_quota
            FROM q3)
, rk AS (SELECT *, row_number() OVER (PARTITION BY sla_breached ORDER BY md5(coalesce(number, '') || '#42')) AS r
         FROM inc)
, parts AS (SELECT rk.*, CASE WHEN r <= test_quota THEN 'test' ELSE 'train' END AS split
            FROM rk JOIN quota USING (sla_breached))
, train AS (SELECT * FROM parts WHERE split = 'train')"""

_NUM = ("total_events", "sys_mod_count_max", "sys_mod_count_mean", "reassignment_count_max", "reopen_count_max",
        "resolution_hours")
_CAT = ("category", "subcategory", "priority", "assignment_group", "caller_id", "opened_by", "location")


def _mode_sql(c: str) -> str:
    return (f"SELECT '{c}' AS feature, (SELECT CAST({c} AS VARCHAR) FROM train WHERE {c} IS NOT NULL "
            f"GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1) AS mode")


_INC_ONLY = (LOG_CTE, INC_CTE)

ORACLES.update({
    "scan_event_log": with_ctes(f"SELECT {_LOG_COLS} FROM log", LOG_CTE),
    "scan_iso_log": with_ctes(f"SELECT {_LOG_COLS} FROM log", LOG_CTE),
    "scan_quoted_log": with_ctes(f"""
SELECT {_LOG_COLS} FROM (SELECT * REPLACE (CASE WHEN event_seq % 2 = 0 THEN category
  ELSE 'a "quoted"' || chr(10) || 'second, line: ' || category END AS category) FROM log)""", LOG_CTE),
    "parse_event_dates": with_ctes("SELECT number, event_seq, opened_at, resolved_at, sys_updated_at FROM log",
                                   LOG_CTE),
    "normalise_made_sla": with_ctes(f"""
SELECT number, event_seq, made_sla,
  CASE WHEN {_RAW_FLAG} = 'true' THEN true WHEN {_RAW_FLAG} = 'false' THEN false END AS made_sla_flag,
  (made_sla IS NOT NULL AND coalesce({_RAW_FLAG} NOT IN ('true', 'false'), true)) AS made_sla_unrecognised
FROM log""", LOG_CTE),
    "export_scored": on_scored(f"SELECT {_SCORED_COLS} FROM scored"),
    "log_profile": with_ctes("""
SELECT CAST(count(*) AS BIGINT) AS event_rows, 16 AS n_columns,
  CAST(count(DISTINCT number) + max(CASE WHEN number IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS tickets
FROM log""", LOG_CTE),
    "summary_minimal_schema": with_ctes("""
SELECT number, CAST(count(*) AS BIGINT) AS total_events, max(reopen_count) AS reopen_count_max,
  arg_min(priority, event_seq) FILTER (WHERE priority IS NOT NULL) AS priority, min(opened_at) AS opened_at_min
FROM log GROUP BY number""", LOG_CTE),
    "feature_projection": with_ctes("""
SELECT total_events, sys_mod_count_max, sys_mod_count_mean, reassignment_count_max, reopen_count_max, category,
  subcategory, priority, assignment_group, caller_id, opened_by, location, resolution_hours FROM inc""", *_INC_ONLY),
    "sla_label": with_ctes("SELECT number, made_sla, sla_breached FROM inc", *_INC_ONLY),
    "risk_band": on_scored("SELECT number, sla_breach_probability, risk_band FROM scored"),
    "recommended_action": on_scored("SELECT number, risk_band, recommended_action FROM scored"),
    "threshold_predict": on_scored("""
SELECT number, sla_breach_probability, CAST(sla_breach_probability >= 0.5 AS INTEGER) AS predicted FROM scored"""),
    "filter_bands": on_scored(
        "SELECT number, sla_breach_probability, risk_band FROM scored WHERE risk_band IN ('High', 'Medium')"),
    "filter_min_prob": on_scored(
        "SELECT number, sla_breach_probability FROM scored WHERE sla_breach_probability >= 0.35"),
    "search_incidents": on_scored(
        "SELECT number, sla_breach_probability FROM scored WHERE regexp_matches(number, 'c0+1[0-9]3', 'i')"),
    "incident_detail": on_scored(f"SELECT {_SCORED_COLS} FROM scored WHERE number = 'INC0000001' LIMIT 1"),
    "driver_stats": on_scored(_STATS + " SELECT * FROM st"),
    "sort_incidents": on_scored("SELECT number, total_events, sla_breach_probability FROM scored"),
    "incident_list": on_scored(f"""
SELECT {_LIST_COLS} FROM scored
WHERE {_LIST_WHERE} AND regexp_matches(number, '1', 'i')
ORDER BY reassignment_count_max DESC NULLS LAST, number LIMIT 500"""),
    "incident_list_count": on_scored(
        f"SELECT CAST(least(count(*), 500) AS BIGINT) AS results FROM scored WHERE {_LIST_WHERE}"),
    "risk_drivers": on_scored(_STATS + f"""
SELECT number, coalesce(nullif(concat_ws(' | ', {', '.join(_driver_case(*s) for s in _SIG)}, {_PRIO}), ''),
  'No major red flags in the usual signals. Looks like a fairly normal ticket.') AS risk_drivers
FROM scored CROSS JOIN st"""),
    "explain_offline": on_scored(f"""
, f AS (SELECT {_FACTS} FROM scored)
SELECT number, concat_ws(chr(10),
  '- Risk: **' || coalesce(risk_level, 'Unknown') || '**'
    || coalesce(' (prob ' || printf('%.2f', sla_breach_probability) || ')', ''),
  '- Why: ' || coalesce(nullif(concat_ws(', ',
      CASE WHEN reassignment_count_max >= 3 THEN 'high reassignment count (' || reassignment_count_max || ')' END,
      CASE WHEN reopen_count_max >= 1 THEN 'reopened ' || reopen_count_max || ' time(s)' END,
      CASE WHEN total_events >= 12 THEN 'many events (' || total_events || ')' END,
      CASE WHEN resolution_hours >= 48 THEN 'long resolution time (~' || CAST(trunc(resolution_hours) AS BIGINT)
        || ' hrs)' END), ''), 'no extreme signals, but pattern suggests monitoring.'),
  CASE WHEN recommended_action IS NOT NULL AND recommended_action <> '' THEN '- Next: ' || recommended_action END
) AS explanation FROM f"""),
    "explanation_facts": on_scored(f"SELECT {_FACTS} FROM scored"),
    "stratified_split": with_ctes("SELECT 1", LOG_CTE, INC_CTE).replace(
        "\nSELECT 1", _SPLIT + "\nSELECT number, sla_breached, split FROM parts"),
    "impute_numeric": with_ctes("SELECT 1", LOG_CTE, INC_CTE).replace(
        "\nSELECT 1", _SPLIT + "\nSELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in _NUM)
        + " FROM train"),
    "impute_categorical": with_ctes("SELECT 1", LOG_CTE, INC_CTE).replace(
        "\nSELECT 1", _SPLIT + "\n" + "\nUNION ALL ".join(_mode_sql(c) for c in _CAT)),
    "onehot_category_sizes": with_ctes("SELECT 1", LOG_CTE, INC_CTE).replace(
        "\nSELECT 1", _SPLIT + "\n" + "\nUNION ALL ".join(
            f"SELECT '{c}' AS feature, CAST(count(DISTINCT {c}) AS BIGINT) AS n_categories FROM train" for c in _CAT)),
    "class_weights": with_ctes("SELECT 1", LOG_CTE, INC_CTE).replace("\nSELECT 1", _SPLIT + """
SELECT sla_breached, CAST(n_c AS BIGINT) AS n_c,
  CAST(sum(n_c) OVER () AS DOUBLE) / CAST(count(*) OVER () * n_c AS DOUBLE) AS weight
FROM (SELECT sla_breached, count(*) AS n_c FROM train GROUP BY 1)"""),
})

# ── prompts and model queries ────────────────────────────────────────────────

# The explainer's texts, repeated so that the oracle is independent.
_SYSTEM = (
    "You are an ITSM incident analyst.\n"
    "Explain SLA breach risk using ONLY the provided JSON facts.\n"
    "Do NOT invent numbers or fields. If a value is missing, say it is not available.\n"
    "Return:\n"
    "- 2 to 4 bullet points explaining why this ticket is risky\n"
    "- 1 to 2 bullet points on recommended next actions\n"
)


def _json(value: str) -> str:
    short = " ".join(f"WHEN c = {char} THEN '{escape}'" for char, escape in (
        ("'\"'", '\\"'), ("'\\'", "\\\\"), ("chr(8)", "\\b"), ("chr(12)", "\\f"), ("chr(10)", "\\n"), ("chr(13)", "\\r"), ("chr(9)", "\\t")))
    return f"""coalesce('"' || array_to_string(list_transform(regexp_extract_all({value}, '(?s).'), lambda c: CASE {short}
  WHEN unicode(c) BETWEEN 32 AND 126 THEN c
  WHEN unicode(c) > 65535 THEN printf('\\u%04x\\u%04x', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023))
  ELSE printf('\\u%04x', unicode(c)) END), '') || '"', 'null')"""


def _fields(pad: str, fields: list[tuple[str, str]]) -> str:
    return " || ',\n' || ".join(f"'{pad}\"{name}\": ' || {value}" for name, value in fields)


_NUMBER = "coalesce(CAST({0} AS VARCHAR), 'null')"
_INNER = _fields("    ", [(n, _NUMBER.format(n)) for n in (
    "total_events", "reassignment_count_max", "reopen_count_max", "resolution_hours")]
    + [(n, _json(n)) for n in ("priority", "assignment_group", "category")])
_OUTER = _fields("  ", [("sla_breach_probability", _NUMBER.format("sla_breach_probability")),
                        ("risk_level", _json("risk_level")), ("recommended_action", _json("recommended_action")),
                        ("key_factors", "'{\n' || " + _INNER + " || '\n  }'")])
ORACLES["explanation_prompts"] = on_scored(f"""
, f AS (SELECT {_FACTS} FROM scored)
SELECT number, '{_SYSTEM}' AS system_prompt,
  'Incident risk summary (JSON):\n' || '{{\n' || {_OUTER} || '\n}}' AS user_message FROM f""")


def _on_split(select_sql: str) -> str:
    return with_ctes("SELECT 1", LOG_CTE, INC_CTE).replace("\nSELECT 1", _SPLIT + "\n" + select_sql)


# What a model query's rows are for every good model: counts that the split fixes, and checks that hold.
_NAMES = "(VALUES ('logreg'), ('random_forest')) AS c(name)"
_MET = ("CAST(count(*) FILTER (WHERE sla_breached = 0) AS BIGINT) AS met, "
        "CAST(count(*) FILTER (WHERE sla_breached = 1) AS BIGINT) AS breached")
ORACLES["evaluate_candidates"] = _on_split(f"""
SELECT name, {_MET}, TRUE AS better_than_chance FROM parts, {_NAMES} WHERE split = 'test' GROUP BY name""")
ORACLES["pick_best"] = _on_split(f"""
SELECT CAST(2 AS BIGINT) AS candidates, {_MET}, TRUE AS is_greatest, TRUE AS better_than_chance
FROM parts WHERE split = 'test'""")
ORACLES["train_candidates"] = _on_split(f"""
SELECT name, sla_breached, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_valid, TRUE AS better_than_prior
FROM parts, {_NAMES} WHERE split = 'test' GROUP BY name, sla_breached""")
_INPUTS = " UNION ALL ".join([f"SELECT '{c}__imp' AS feature" for c in _NUM] + [
    f"SELECT DISTINCT '{c}__ohe_' || CAST({c} AS VARCHAR) AS feature FROM train WHERE {c} IS NOT NULL" for c in _CAT])
ORACLES["train_logreg"] = _on_split(f"""
SELECT feature, TRUE AS optimal FROM ({_INPUTS} UNION ALL SELECT '(intercept)' AS feature)""")
ORACLES["train_random_forest"] = _on_split(f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM ({_INPUTS})) AS inputs, CAST(300 AS BIGINT) AS trees, 1.0::DOUBLE AS importance,
  (SELECT CAST(count(*) AS BIGINT) FROM parts WHERE split = 'test') AS test_rows, TRUE AS better_than_prior""")
ORACLES["model_roundtrip"] = with_ctes("SELECT number, TRUE AS same FROM inc", LOG_CTE, INC_CTE)
ORACLES["score_incidents"] = with_ctes("""
SELECT number, sla_breached, category, total_events, TRUE AS consistent, TRUE AS informed FROM inc""", LOG_CTE, INC_CTE)
# another log: other tickets, and a category that no training row has in every third event
_OTHER_CTE = LOG_CTE.replace("\nlog AS (", "\nfirst_log AS (", 1) + """,
log AS (SELECT * REPLACE ('N' || number AS number,
    CASE WHEN event_seq % 3 = 0 THEN 'Unseen, "new"' ELSE category END AS category) FROM first_log)"""
ORACLES["score_new_log"] = with_ctes("""
SELECT number, sla_breached, category, total_events, TRUE AS consistent, TRUE AS informed FROM inc""", _OTHER_CTE, INC_CTE)
ORACLES["training_job"] = with_ctes("SELECT 1", _OTHER_CTE, INC_CTE).replace("\nSELECT 1", _SPLIT + f"""
SELECT name, {_MET}, TRUE AS better_than_chance, CAST(1 AS BIGINT) AS picked, TRUE AS pick_is_greatest
FROM parts, {_NAMES} WHERE split = 'test' GROUP BY name""")
