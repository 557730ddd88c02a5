"""Event log → one row per incident (counts, durations, first/last attributes, label).

The whole summary is ONE ``groupBy(key).agg(...)``: one shuffle, with map-side
partial aggregation, so a ticket holding a third of the log is pre-reduced in
every map task before it crosses the network. "First/last non-null in log order"
is the least or greatest (ordering column(s), value), restricted to non-null
values by nulling the pair of null rows (which ``min`` and ``max`` skip).
The ordering of a row with a value is never NULL: each ordering column comes
with a flag that places rows without an order after all others, and the value
itself breaks ties (the smallest is first, the largest last).

The derivation is schema-adaptive: a feature is emitted only if its input
column exists. Only the key is mandatory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachlens.schema import CATEGORICAL_ATTRS, KEY, LOG_ORDER

# Fixed value: the message users of the public job know.
MISSING_KEY_MESSAGE = "Expected a 'number' column for incident ID but it was not found."

# Characters removed by the flag normaliser (Python's str.strip whitespace set, ASCII part).
_WS = " \t\n\r\x0b\x0c"


NO_ORDER = "The log has no order: pass order_by, or read it with read_event_log, which adds '{column}'."


def order_key(columns: Sequence[str], order_by: str | Sequence[str] | None) -> list[Column]:
    """Ordering columns, never NULL as a whole: (is missing, value) for each column of ``order_by``.

    Without ``order_by`` the log order added at ingest is used, else the column ``event_seq``.
    """
    if order_by is None:
        order_by = next((c for c in (LOG_ORDER, "event_seq") if c in columns), None)
        if order_by is None:
            raise ValueError(NO_ORDER.format(column=LOG_ORDER))
    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    if not cols:
        raise ValueError("order_by needs at least one column")
    return [part for c in cols for part in (F.col(c).isNull(), F.col(c))]


def placed(col: str, order: list[Column]) -> Column:
    """(order …, value), NULL where the column is: its least or greatest holds the first or last value."""
    parts = [p.alias(f"o{i}") for i, p in enumerate(order)]
    return F.when(F.col(col).isNotNull(), F.struct(*parts, F.col(col).alias("value")))


def first_non_null(col: str, order: list[Column]) -> Column:
    return F.min(placed(col, order))["value"]          # the state holds the value once, where min_by has it beside its order too


def last_non_null(col: str, order: list[Column]) -> Column:
    return F.max(placed(col, order))["value"]


def normalised_flag(raw: Column) -> Column:
    """'true'/'false' (any case, surrounding whitespace) → boolean; anything else → NULL."""
    s = F.lower(F.trim(raw.cast("string"), F.lit(_WS)))
    return F.when(s == "true", F.lit(True)).when(s == "false", F.lit(False))


def sla_label(flag: Column) -> Column:
    """made_sla True → 0 (met), False → 1 (breached), anything else → NULL."""
    return F.when(flag, F.lit(0)).when(~flag, F.lit(1)).cast("int")


def hours_between(start: Column, end: Column) -> Column:
    """(end − start) in fractional hours, microsecond exact; NULL if either is NULL."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3600000000.0)


def incident_summary(log: DataFrame, order_by: str | Sequence[str] | None = None,
                     key: str = KEY, drop_unlabelled: bool = True) -> DataFrame:
    cols = set(log.columns)
    if key not in cols:
        raise ValueError(MISSING_KEY_MESSAGE)
    ordered = any(c in cols for c in (*CATEGORICAL_ATTRS, "made_sla"))
    order = order_key(log.columns, order_by) if ordered else []

    aggs: list[Column] = [F.count(F.lit(1)).alias("total_events")]
    if "sys_mod_count" in cols:
        aggs += [F.max("sys_mod_count").alias("sys_mod_count_max"),
                 F.avg("sys_mod_count").alias("sys_mod_count_mean")]
    if "reassignment_count" in cols:
        aggs.append(F.max("reassignment_count").alias("reassignment_count_max"))
    if "reopen_count" in cols:
        aggs.append(F.max("reopen_count").alias("reopen_count_max"))
    for c in CATEGORICAL_ATTRS:
        if c in cols:
            aggs.append(first_non_null(c, order).alias(c))
    if "opened_at" in cols:
        aggs.append(F.min("opened_at").alias("opened_at_min"))
    if "resolved_at" in cols:
        aggs.append(F.max("resolved_at").alias("resolved_at_max"))
    if "made_sla" in cols:
        # Keep the raw text of the last non-null flag; classify after choosing it,
        # so a junk last value drops the incident rather than falling back.
        aggs.append(last_non_null("made_sla", order).cast("string").alias("_last_flag"))

    out = log.groupBy(key).agg(*aggs)
    if "opened_at" in cols and "resolved_at" in cols:
        out = out.withColumn("resolution_hours", hours_between(F.col("opened_at_min"), F.col("resolved_at_max")))
    if "made_sla" in cols:
        flag = normalised_flag(F.col("_last_flag"))
        out = (out.withColumn("made_sla", flag)
                  .withColumn("sla_breached", sla_label(F.col("made_sla")))
                  .drop("_last_flag"))
        if drop_unlabelled:
            out = out.where(F.col("sla_breached").isNotNull())
    return out


def total_events(log: DataFrame, key: str = KEY) -> DataFrame:
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("total_events"))


def sys_mod_stats(log: DataFrame, key: str = KEY) -> DataFrame:
    return log.groupBy(key).agg(F.max("sys_mod_count").alias("sys_mod_count_max"),
                                F.avg("sys_mod_count").alias("sys_mod_count_mean"))


def first_non_null_attrs(log: DataFrame, order_by: str | Sequence[str] | None = None,
                         key: str = KEY, attrs: Sequence[str] = CATEGORICAL_ATTRS) -> DataFrame:
    order = order_key(log.columns, order_by)
    present = [c for c in attrs if c in log.columns]
    return log.groupBy(key).agg(*[first_non_null(c, order).alias(c) for c in present])


def last_sla_flag(log: DataFrame, order_by: str | Sequence[str] | None = None, key: str = KEY) -> DataFrame:
    """Last non-null raw flag per incident, its normalised boolean and the label (unfiltered)."""
    order = order_key(log.columns, order_by)
    out = log.groupBy(key).agg(last_non_null("made_sla", order).cast("string").alias("last_flag"))
    flag = normalised_flag(F.col("last_flag"))
    return out.select(key, "last_flag", flag.alias("made_sla"), sla_label(flag).alias("sla_breached"))


def resolution_hours(log: DataFrame, key: str = KEY) -> DataFrame:
    out = log.groupBy(key).agg(F.min("opened_at").alias("opened_at_min"),
                               F.max("resolved_at").alias("resolved_at_max"))
    return out.withColumn("resolution_hours", hours_between(F.col("opened_at_min"), F.col("resolved_at_max")))


__all__ = ["incident_summary", "total_events", "sys_mod_stats", "first_non_null_attrs",
           "last_sla_flag", "resolution_hours", "normalised_flag", "sla_label", "hours_between",
           "order_key", "placed", "MISSING_KEY_MESSAGE", "NO_ORDER"]
