import datetime as dt

import pytest
from pyspark.sql import functions as F

from breachlens.operators.summary import MISSING_KEY_MESSAGE, incident_summary

SCHEMA = ("number string, event_seq bigint, category string, made_sla string, "
          "opened_at timestamp_ntz, resolved_at timestamp_ntz, reopen_count int")


def _log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _one(df, number):
    rows = [r.asDict() for r in df.collect() if r["number"] == number]
    return rows[0] if rows else None


T0 = dt.datetime(2016, 12, 3, 13, 5)


def test_null_key_is_one_group(spark):
    out = incident_summary(_log(spark, [(None, 1, "a", "true", T0, None, 0), (None, 2, "b", "true", T0, None, 0)]))
    rows = out.collect()
    assert len(rows) == 1 and rows[0]["number"] is None and rows[0]["total_events"] == 2


@pytest.mark.parametrize("flags,expected", [
    (["true", "yes"], None),        # junk last flag → dropped
    (["false", None], 1),           # null last flag is skipped → breached
    ([None, None], None),           # never set → dropped
    (["1"], None),                  # numeric flag is not a flag word
    ([" FALSE "], 1),               # trim + case
    ([" True"], 0),
])
def test_last_flag_rules(spark, flags, expected):
    rows = [("INC1", i, "x", f, T0, None, 0) for i, f in enumerate(flags)]
    got = _one(incident_summary(_log(spark, rows)), "INC1")
    assert (got["sla_breached"] if got else None) == expected


def test_first_non_null_in_log_order(spark):
    rows = [("INC1", 3, "y", "true", T0, None, 0), ("INC1", 1, None, "true", T0, None, 0),
            ("INC1", 2, "z", "true", T0, None, 0), ("INC2", 1, "?", "true", T0, None, 0),
            ("INC2", 2, "x", "true", T0, None, 0)]
    out = incident_summary(_log(spark, rows))
    assert _one(out, "INC1")["category"] == "z"
    assert _one(out, "INC2")["category"] == "?"


def test_negative_fractional_hours(spark):
    rows = [("INC1", 1, "a", "true", T0, T0 - dt.timedelta(minutes=90), 0)]
    assert _one(incident_summary(_log(spark, rows)), "INC1")["resolution_hours"] == -1.5


def test_schema_adaptive(spark):
    log = _log(spark, [("INC1", 1, "a", "true", T0, None, 0)])
    assert "resolution_hours" not in incident_summary(log.drop("resolved_at")).columns
    no_flag = incident_summary(log.drop("made_sla"))
    assert "sla_breached" not in no_flag.columns and no_flag.count() == 1
    minimal = incident_summary(log.select("number", "event_seq"))
    assert minimal.columns == ["number", "total_events"]
    with pytest.raises(ValueError, match="Expected a 'number' column"):
        incident_summary(log.drop("number"))
    assert MISSING_KEY_MESSAGE.startswith("Expected")


def test_multi_column_order(spark):
    rows = [("INC1", 1, "late", "true", T0, None, 0), ("INC1", 1, "early", "false", T0 - dt.timedelta(hours=1), None, 0)]
    out = incident_summary(_log(spark, rows), order_by=["opened_at", "event_seq"])
    got = _one(out, "INC1")
    assert got["category"] == "early" and got["sla_breached"] == 0


def test_anchor_counts_sf0001(spark):
    from breachlens.catalog import scored
    s = scored(spark, "/root/testdata/sf0.001")
    agg = s.agg(F.count("*").alias("n"), F.sum("sla_breached").alias("b"), F.sum("score_bp").alias("bp")).first()
    bands = {r["risk_band"]: r["count"] for r in s.groupBy("risk_band").count().collect()}
    assert agg["n"] == 1381 and agg["b"] == 495
    assert bands == {"Low": 159, "Medium": 703, "High": 519}
