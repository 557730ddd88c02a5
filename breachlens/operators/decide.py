"""Attach decisions to scored incidents: band, action, ranked order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachlens.functions.decision import proxy_score_bp, recommended_action, risk_band
from breachlens.schema import ACTION, BAND, KEY, PROB


def add_decisions(scored: DataFrame, prob: str = PROB) -> DataFrame:
    return (scored.withColumn(BAND, risk_band(prob))
                  .withColumn(ACTION, recommended_action(F.col(BAND))))


def proxy_scored(summary: DataFrame) -> DataFrame:
    """Summary + deterministic integer proxy score (test fixture) + band + action."""
    out = (summary.withColumn("score_bp", proxy_score_bp())
                  .withColumn(PROB, F.col("score_bp") / F.lit(10000.0)))
    return add_decisions(out)


def ranked_incidents(scored: DataFrame, prob: str = PROB, key: str = KEY) -> DataFrame:
    """Scored incidents, highest probability first; ties by incident number."""
    return scored.orderBy(F.col(prob).desc_nulls_last(), F.col(key).asc_nulls_last())


__all__ = ["add_decisions", "proxy_scored", "ranked_incidents"]
