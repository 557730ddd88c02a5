"""Scalar decision expressions: risk band, recommended action, threshold prediction.

All are native Column expressions (whole-stage codegen, no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour: band cut points and
# the three action texts, in band order High, Medium, Low.
LOW_BELOW = 0.30
MEDIUM_BELOW = 0.60
NO_PROBABILITY = "A probability is missing, so the incident has no risk band."
BANDS = ("High", "Medium", "Low")
ACTION_HIGH = "Escalate now. Assign correctly, reduce reassignment loops, senior review."
ACTION_MEDIUM = "Monitor. Check missing details and confirm ownership early."
ACTION_LOW = "Normal queue. Keep updates clean and avoid unnecessary reassignment."


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def risk_band(p) -> Column:
    """p < 0.30 → Low, p < 0.60 → Medium, otherwise High (NaN → High). A NULL probability fails the job."""
    p = _c(p)
    return (F.when(p.isNull(), F.raise_error(F.lit(NO_PROBABILITY)).cast("string"))
             .when(p < LOW_BELOW, F.lit("Low"))
             .when(p < MEDIUM_BELOW, F.lit("Medium"))
             .otherwise(F.lit("High")))


def recommended_action(band) -> Column:
    """Case-insensitive band → action text; anything unrecognised gets the Low text. No band, no action."""
    b = F.lower(_c(band))
    return (F.when(b.isNull(), F.lit(None).cast("string"))
             .when(b == "high", F.lit(ACTION_HIGH))
             .when(b == "medium", F.lit(ACTION_MEDIUM))
             .otherwise(F.lit(ACTION_LOW)))


def threshold_predict(p, threshold: float) -> Column:
    """Inclusive threshold: p >= t → 1."""
    return (_c(p) >= F.lit(float(threshold))).cast("int")


def proxy_score_bp(total_events="total_events", reassign="reassignment_count_max",
                   reopen="reopen_count_max", hours="resolution_hours") -> Column:
    """Deterministic integer test score in basis points (a fixture input, not a model)."""
    whole_hours = F.least(F.coalesce(_c(hours).cast("bigint"), F.lit(0)), F.lit(200))
    raw = (F.lit(300) + F.lit(250) * F.coalesce(_c(reassign), F.lit(0))
           + F.lit(700) * F.coalesce(_c(reopen), F.lit(0))
           + F.lit(150) * F.coalesce(_c(total_events), F.lit(0)).cast("bigint")
           + F.lit(15) * whole_hours)
    return F.least(F.lit(10000), F.greatest(F.lit(0), raw)).cast("bigint")


__all__ = ["risk_band", "recommended_action", "threshold_predict", "proxy_score_bp",
           "NO_PROBABILITY", "BANDS", "ACTION_HIGH", "ACTION_MEDIUM", "ACTION_LOW", "LOW_BELOW", "MEDIUM_BELOW"]
