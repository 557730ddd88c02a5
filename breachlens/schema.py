"""Column names and schemas of the event log and the incident summary."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "number"

# Column names of the public incident log.
DATE_COLS = ("opened_at", "resolved_at", "closed_at", "sys_updated_at", "sys_created_at")

# Categorical attributes summarised as "first non-null value in log order".
CATEGORICAL_ATTRS = ("category", "subcategory", "priority", "assignment_group",
                     "caller_id", "opened_by", "location")

COUNTER_COLS = ("sys_mod_count", "reassignment_count", "reopen_count")

# Position of a row in the log as ingested (file, block, row); the default log order.
LOG_ORDER = "log_order"

# Declared event-log schema (CSV ingest reads with it: no inference pass).
EVENT_LOG_SCHEMA = T.StructType([
    T.StructField("number", T.StringType()),
    T.StructField("event_seq", T.LongType()),
    T.StructField("sys_mod_count", T.IntegerType()),
    T.StructField("reassignment_count", T.IntegerType()),
    T.StructField("reopen_count", T.IntegerType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("assignment_group", T.StringType()),
    T.StructField("caller_id", T.StringType()),
    T.StructField("opened_by", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("opened_at", T.StringType()),
    T.StructField("resolved_at", T.StringType()),
    T.StructField("closed_at", T.StringType()),
    T.StructField("sys_updated_at", T.StringType()),
    T.StructField("sys_created_at", T.StringType()),
    T.StructField("made_sla", T.StringType()),
])

# Columns never used as model inputs.
NON_FEATURE_COLS = ("number", "sla_breached", "made_sla", "opened_at_min", "resolved_at_max")

PROB = "sla_breach_probability"
LABEL = "sla_breached"
BAND = "risk_band"
ACTION = "recommended_action"
