"""Per-incident explanations for the whole table at once.

Population statistics (median and 75th percentile of four signals) are one
1-row DataFrame, joined to every incident with ``broadcast``; driver lists,
offline explanation text, fact records and prompt rows are then plain column
expressions — no per-row Python, no per-click recomputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachlens.functions.text import format_fixed, format_g, json_string, python_float
from breachlens.operators.ranks import RANK_ERROR, approximate_quantiles, multi_column_quantiles
from breachlens.schema import ACTION, BAND, KEY, PROB

# Fixed values that must equal the reference's texts: signals in evaluation
# order as (column, label, note), then the priority sentences and fallbacks, and
# the system prompt and user prefix of the explainer.
SIGNALS = (
    ("reassignment_count_max", "Reassignment count", "ticket changed hands too many times"),
    ("reopen_count_max", "Reopen count", "fix did not stick the first time"),
    ("resolution_hours", "Resolution time", "slow closure pattern"),
    ("total_events", "Total events", "lots of activity with no clear closure"),
)
PRIORITY_CRITICAL = "**Priority is Critical.** Needs immediate escalation."
PRIORITY_HIGH = "**Priority is High.** Worth escalating early."
NO_DRIVER = "No major red flags in the usual signals. Looks like a fairly normal ticket."
MAX_DRIVERS = 6
OFFLINE_FALLBACK = "no extreme signals, but pattern suggests monitoring."
SYSTEM_PROMPT = (
    "You are an ITSM incident analyst.\n"
    "Explain SLA breach risk using ONLY the provided JSON facts.\n"
    "Do NOT invent numbers or fields. If a value is missing, say it is not available.\n"
    "Return:\n"
    "- 2 to 4 bullet points explaining why this ticket is risky\n"
    "- 1 to 2 bullet points on recommended next actions\n"
)
USER_PREFIX = "Incident risk summary (JSON):\n"


def driver_stats(scored: DataFrame, exact: bool = True, rank_error: float = RANK_ERROR) -> DataFrame:
    """One row: ``<signal>_median`` and ``<signal>_q75`` for each signal present."""
    spec = {col: {f"{col}_median": 0.5, f"{col}_q75": 0.75} for col, _, _ in SIGNALS if col in scored.columns}
    return multi_column_quantiles(scored, spec) if exact else approximate_quantiles(scored, spec, rank_error)


def _signal_driver(col: str, label: str, note: str) -> Column:
    v = F.col(col).cast("double")
    med, q75 = F.col(f"{col}_median"), F.col(f"{col}_q75")
    fires = (v.isNotNull() & med.isNotNull() & (med != 0) & q75.isNotNull() & (q75 != 0)
             & (v >= q75) & (v > med))
    text = F.concat(F.lit(f"**{label}** is "), format_g(v), F.lit(f" ({note})"))
    return F.when(fires, text)


def _priority_driver(scored: DataFrame) -> Column:
    if "priority" not in scored.columns:
        return F.lit(None).cast("string")
    pr = F.col("priority").cast("string")
    return (F.when(F.contains(pr, F.lit("1")) | F.contains(pr, F.lit("Critical")), F.lit(PRIORITY_CRITICAL))
             .when(F.contains(pr, F.lit("2")) | F.contains(pr, F.lit("High")), F.lit(PRIORITY_HIGH)))


def risk_drivers(scored: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Adds ``risk_drivers`` (array<string>, at most 6) to every incident."""
    stats = stats if stats is not None else driver_stats(scored)
    joined = scored.crossJoin(F.broadcast(stats))  # stats is exactly one row
    candidates = [_signal_driver(c, lab, note) for c, lab, note in SIGNALS if c in scored.columns]
    candidates.append(_priority_driver(scored))
    found = F.filter(F.array(*candidates), lambda x: x.isNotNull())
    drivers = F.when(F.size(found) == 0, F.array(F.lit(NO_DRIVER))).otherwise(F.slice(found, 1, MAX_DRIVERS))
    return joined.select(*scored.columns, drivers.alias("risk_drivers"))


def _int_fact(df: DataFrame, col: str) -> Column:
    return F.col(col).cast("double").cast("bigint") if col in df.columns else F.lit(None).cast("bigint")


def _fact(df: DataFrame, col: str, typ: str) -> Column:
    return F.col(col).cast(typ) if col in df.columns else F.lit(None).cast(typ)


def explanation_facts(scored: DataFrame, key: str = KEY) -> DataFrame:
    """The fact record per incident as a struct ``facts`` and JSON ``facts_json`` (nulls kept)."""
    factors = F.struct(
        _int_fact(scored, "total_events").alias("total_events"),
        _int_fact(scored, "reassignment_count_max").alias("reassignment_count_max"),
        _int_fact(scored, "reopen_count_max").alias("reopen_count_max"),
        _fact(scored, "resolution_hours", "double").alias("resolution_hours"),
        _fact(scored, "priority", "string").alias("priority"),
        _fact(scored, "assignment_group", "string").alias("assignment_group"),
        _fact(scored, "category", "string").alias("category"),
    )
    facts = F.struct(F.col(PROB).cast("double").alias("sla_breach_probability"),
                     F.col(BAND).alias("risk_level"), F.col(ACTION).alias("recommended_action"),
                     factors.alias("key_factors"))
    out = scored.select(F.col(key), facts.alias("facts"))
    return out.withColumn("facts_json", F.to_json("facts", {"ignoreNullFields": "false"}))


def explain_offline_text(facts: Column) -> Column:
    """The three-line offline explanation from a fact struct."""
    kf = facts["key_factors"]
    p = facts["sla_breach_probability"]
    risk = F.coalesce(facts["risk_level"], F.lit("Unknown"))
    head = F.concat(F.lit("- Risk: **"), risk, F.lit("**"),
                    F.coalesce(F.concat(F.lit(" (prob "), format_fixed(p, 2), F.lit(")")), F.lit("")))
    reasons = F.concat_ws(
        ", ",
        F.when(kf["reassignment_count_max"] >= 3,
               F.concat(F.lit("high reassignment count ("), kf["reassignment_count_max"].cast("string"), F.lit(")"))),
        F.when(kf["reopen_count_max"] >= 1,
               F.concat(F.lit("reopened "), kf["reopen_count_max"].cast("string"), F.lit(" time(s)"))),
        F.when(kf["total_events"] >= 12,
               F.concat(F.lit("many events ("), kf["total_events"].cast("string"), F.lit(")"))),
        F.when(kf["resolution_hours"] >= 48,
               F.concat(F.lit("long resolution time (~"), kf["resolution_hours"].cast("bigint").cast("string"),
                        F.lit(" hrs)"))),
    )
    why = F.concat(F.lit("- Why: "), F.when(reasons == "", F.lit(OFFLINE_FALLBACK)).otherwise(reasons))
    action = facts["recommended_action"]
    nxt = F.when(action.isNotNull() & (action != ""), F.concat(F.lit("- Next: "), action))
    return F.concat_ws("\n", head, why, nxt)


def explain_offline(scored: DataFrame, key: str = KEY) -> DataFrame:
    facts = explanation_facts(scored, key)
    return facts.select(key, explain_offline_text(F.col("facts")).alias("explanation"))


def facts_text(facts: Column) -> Column:
    """The fact record as indented JSON (two spaces, one field a line), as it goes into the prompt."""
    quoted = lambda s: F.coalesce(json_string(s), F.lit("null"))
    whole = lambda n: F.coalesce(n.cast("string"), F.lit("null"))
    real = lambda x: F.coalesce(python_float(x), F.lit("null"))
    kf = facts["key_factors"]
    lines = lambda fields, pad: F.concat_ws(",\n", *[
        F.concat(F.lit(f'{pad}"{name}": '), value) for name, value in fields])
    inner = lines([(n, whole(kf[n])) for n in ("total_events", "reassignment_count_max", "reopen_count_max")]
                  + [("resolution_hours", real(kf["resolution_hours"]))]
                  + [(n, quoted(kf[n])) for n in ("priority", "assignment_group", "category")], "    ")
    outer = lines([("sla_breach_probability", real(facts["sla_breach_probability"])),
                   ("risk_level", quoted(facts["risk_level"])),
                   ("recommended_action", quoted(facts["recommended_action"])),
                   ("key_factors", F.concat(F.lit("{\n"), inner, F.lit("\n  }")))], "  ")
    return F.concat(F.lit("{\n"), outer, F.lit("\n}"))


def explanation_prompts(scored: DataFrame, bands: tuple[str, ...] | None = None, key: str = KEY) -> DataFrame:
    """System prompt + user message for every incident (or those in ``bands``), for an external explainer. No network
    call."""
    src = scored if not bands else scored.where(F.col(BAND).isin(list(bands)))
    facts = explanation_facts(src, key)
    return facts.select(key, F.lit(SYSTEM_PROMPT).alias("system_prompt"),
                        F.concat(F.lit(USER_PREFIX), facts_text(F.col("facts"))).alias("user_message"))


__all__ = ["driver_stats", "risk_drivers", "explanation_facts", "explain_offline", "explain_offline_text",
           "explanation_prompts", "facts_text", "SIGNALS", "SYSTEM_PROMPT", "NO_DRIVER", "MAX_DRIVERS"]
