from pyspark.sql import functions as F

from breachlens.operators import explain, listing

COLS = ("number string, sla_breach_probability double, risk_band string, recommended_action string, "
        "reassignment_count_max int, reopen_count_max int, total_events bigint, resolution_hours double, "
        "priority string, assignment_group string, category string")


def _df(spark, rows):
    return spark.createDataFrame(rows, COLS)


BASE = [("INC01", 0.9, "High", "a", 5, 1, 12, 48.9, "1 - Critical", "g", "c"),
        ("INC02", 0.4, "Medium", "b", None, 0, 3, 2.0, "3 - Moderate", None, None),
        (None, 0.2, "Low", "c", 1, 0, 1, None, None, "g", "c")]


def test_search_regex_blank_and_null(spark):
    df = _df(spark, BASE)
    assert [r[0] for r in listing.search_incidents(df, "C.1").collect()] == ["INC01"]
    assert listing.search_incidents(df, "   ").count() == 3
    assert listing.search_incidents(df, "inc", literal=True).count() == 2


def test_sort_missing_last_both_directions(spark):
    df = _df(spark, BASE)
    for desc in (True, False):
        got = [r["reassignment_count_max"] for r in listing.sort_incidents(df, "reassignment_count_max", desc).collect()]
        assert got[-1] is None
    assert listing.sort_incidents(df, "absent_col").count() == 3


def test_filters(spark):
    df = _df(spark, BASE)
    assert listing.filter_bands(df, []).count() == 0
    assert listing.filter_bands(df, ["High", "Low"]).count() == 2
    assert listing.filter_min_prob(df, 0.4).count() == 2
    assert listing.incident_list_count(df, max_rows=1).first()["results"] == 1
    assert listing.incident_detail(df, "INC02").first()["risk_band"] == "Medium"


def test_priority_driver_and_fallback(spark):
    rows = [(f"INC{i}", 0.5, "Medium", "x", 0, 0, 1, 1.0, p, "g", "c")
            for i, p in enumerate(["1 - Critical", "2 - High", "12", "3 - Moderate", None])]
    out = {r["number"]: r["risk_drivers"] for r in explain.risk_drivers(_df(spark, rows)).collect()}
    assert out["INC0"] == [explain.PRIORITY_CRITICAL] and out["INC1"] == [explain.PRIORITY_HIGH]
    assert out["INC2"] == [explain.PRIORITY_CRITICAL]
    assert out["INC3"] == [explain.NO_DRIVER] and out["INC4"] == [explain.NO_DRIVER]


def test_zero_median_guard(spark):
    rows = [(f"INC{i}", 0.5, "Low", "x", 1, v, 1, 1.0, None, "g", "c") for i, v in enumerate([0, 0, 0, 4])]
    out = {r["number"]: r["risk_drivers"] for r in explain.risk_drivers(_df(spark, rows)).collect()}
    assert out["INC3"] == [explain.NO_DRIVER]


def test_signal_driver_text(spark):
    rows = [(f"INC{i}", 0.5, "Low", "x", v, 0, 1, 1.0, None, "g", "c") for i, v in enumerate([1, 2, 3, 12])]
    out = {r["number"]: r["risk_drivers"] for r in explain.risk_drivers(_df(spark, rows)).collect()}
    assert out["INC3"] == ["**Reassignment count** is 12 (ticket changed hands too many times)"]


def test_offline_text(spark):
    df = _df(spark, [("INC9", 0.125, "High", "Do it.", 3, 1, 12, 48.9, None, None, None),
                     ("INC8", None, None, None, 0, 0, 1, 1.0, None, None, None)])
    out = {r["number"]: r["explanation"] for r in explain.explain_offline(df).collect()}
    assert out["INC9"] == ("- Risk: **High** (prob 0.12)\n- Why: high reassignment count (3), reopened 1 time(s), "
                           "many events (12), long resolution time (~48 hrs)\n- Next: Do it.")
    assert out["INC8"] == "- Risk: **Unknown**\n- Why: no extreme signals, but pattern suggests monitoring."


def test_facts_json_keeps_nulls(spark):
    df = _df(spark, [BASE[1]])
    js = explain.explanation_facts(df).first()["facts_json"]
    assert '"assignment_group":null' in js and '"total_events":3' in js
    prompts = explain.explanation_prompts(df, bands=None).first()
    assert prompts["user_message"].startswith("Incident risk summary (JSON):\n{")
    assert F is not None


def test_json_strings_are_those_of_python(spark):
    import json
    import random

    from breachlens.functions.text import json_string
    rng = random.Random(7)
    alphabet = [chr(c) for c in (*range(1, 0x180), 0x2028, 0x20AC, 0x4E2D, 0xFEFF, 0xFFFD, 0xFFFF, 0x10000, 0x1D6FC, 0x1F600, 0x10FFFF)]
    texts = ["", "\0", "Caf\u00e9", '"\\/', "plain text", *alphabet] + ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r["i"]: r["j"] for r in df.select("i", json_string(F.col("t")).alias("j")).collect()}
    assert got.pop(-1) is None
    assert got == {i: json.dumps(t) for i, t in enumerate(texts)}


def test_prompt_is_the_json_of_python(spark):
    import json
    row = ("I1", 0.5, "High", "Caf\u00e9 \U0001d6fc", 3, 1, 0, 12.5, "1 - \u9ad8", None, "a\"b\n")
    df = spark.createDataFrame([row], "number string, sla_breach_probability double, risk_band string, recommended_action string, "
                               "total_events long, reassignment_count_max int, reopen_count_max int, resolution_hours double, "
                               "priority string, assignment_group string, category string")
    facts = {"sla_breach_probability": 0.5, "risk_level": "High", "recommended_action": row[3], "key_factors": {
        "total_events": 3, "reassignment_count_max": 1, "reopen_count_max": 0, "resolution_hours": 12.5, "priority": row[8],
        "assignment_group": None, "category": row[10]}}
    want = "Incident risk summary (JSON):\n" + json.dumps(facts, indent=2)
    assert explain.explanation_prompts(df).first()["user_message"] == want


def test_oracle_escapes_as_python(spark):
    import json

    import duckdb

    from breachlens.oracle_sql import _json
    for t in ["Caf\u00e9", "\U0001d6fc", 'a"\\b\n\t', "\x01\x7f"]:
        assert duckdb.execute(f"SELECT {_json('x')} FROM (SELECT ? AS x)", [t]).fetchone()[0] == json.dumps(t)
