"""Row order of ranked results, exact quantiles over many buckets, NaN scores, checkpoint folder."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from breachlens import session
from breachlens.functions.decision import recommended_action
from breachlens.functions.text import python_float
from breachlens.operators import decide, explain, listing, metrics, ranks, reports
from breachlens.sources import sinks

SCORED = ("number string, sla_breach_probability double, sla_breached int, risk_band string, recommended_action string, "
          "total_events long, assignment_group string")


def scored(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(f"I{i:04d}", rng.choice([0.1, 0.25, 0.5, 0.5, 0.9, rng.random()]), rng.randrange(2), "Low", "a",
             rng.choice([None, 1, 2, 3, rng.randrange(50)]), f"g{rng.randrange(9)}") for i in range(n)]
    return spark.createDataFrame(rows, SCORED).repartition(5), rows


def test_ranked_order_and_export(spark, tmp_path):
    df, rows = scored(spark)
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert [r["number"] for r in decide.ranked_incidents(df).collect()] == want
    path = sinks.export_scored(df, str(tmp_path / "out"))
    lines = [line.split(",")[0] for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()[1:]]
    assert lines == want and sinks.read_exported(spark, path, df.schema).count() == len(rows)


@pytest.mark.parametrize("descending", [True, False])
def test_sorted_with_ties_and_missing_values(spark, descending):
    df, rows = scored(spark)
    got = [(r["total_events"], r["number"]) for r in listing.sort_incidents(df, "total_events", descending=descending).collect()]
    present = [v for v, _ in got if v is not None]
    assert present == sorted(present, reverse=descending)
    assert all(v is None for v, _ in got[len(present):]) and len(got) == len(rows)
    assert got == [(r["total_events"], r["number"]) for r in
                   listing.sort_incidents(df.repartition(3), "total_events", descending=descending).collect()]


def test_top_groups_by_the_exact_mean(spark):
    close = 1e-14
    rows = [("a", 0.5, 0, "Low", "x", 1, "zz"), ("b", 0.5 + close, 0, "Low", "x", 1, "aa"), ("c", 0.5 - close, 0, "Low", "x", 1, "a0"),
            ("d", 0.5, 0, "Low", "x", 1, "yy")]
    got = [r["assignment_group"] for r in reports.top_groups(spark.createDataFrame(rows, SCORED)).collect()]
    assert got == ["aa", "yy", "zz", "a0"]


def test_quantiles_over_many_buckets(spark):
    rng = np.random.default_rng(4)
    a = np.concatenate([rng.normal(0, 1e6, 700), rng.random(700), [0.0, -0.0, 1e300, -1e300]])
    b = rng.integers(-5, 5, 1404).astype(float)
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)], "a double, b double, c double")
    spec = {"a": {"a1": 0.1, "a5": 0.5, "a9": 0.93}, "b": {"b5": 0.5}, "c": {"c5": 0.5}}
    assert df.select(ranks.order_bucket(F.col("a"))).distinct().count() > 100
    for per_octave in (1, 1024):
        got = ranks.multi_column_quantiles(df, spec, per_octave).first()
        for col, values in (("a", a), ("b", b)):
            for name, q in spec[col].items():
                assert got[name] == pytest.approx(np.quantile(values, q), rel=1e-12)
        assert got["c5"] is None
    sums = {r["a"]: r["n_before"] for r in ranks.value_prefix_sums(df, "a", {"n": F.lit(1)}).collect()}
    assert all(sums[v] == (a < v).sum() for v in sums)


def test_building_a_plan_runs_no_job(spark):
    df, _ = scored(spark)
    spark.sparkContext.setJobGroup("plans", "plans")
    for build in (explain.driver_stats, metrics.roc_auc, reports.score_quantiles, reports.score_histogram, reports.calibration_table):
        build(df)
    ids = spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(ids) == []


@pytest.mark.parametrize("table", [metrics.roc_auc, metrics.confusion_matrix, metrics.threshold_sweep, reports.score_quantiles,
                                   reports.score_histogram, reports.calibration_table, reports.top_groups])
def test_nan_scores_are_refused(spark, table):
    df, _ = scored(spark, 5)
    bad = df.withColumn("sla_breach_probability", F.when(F.col("number") == "I0002", F.lit(float("nan"))).otherwise(F.lit(0.3)))
    with pytest.raises(Exception, match=ranks.NAN_SCORE):
        table(bad).collect()


def test_an_unscored_incident_has_no_action(spark):
    df = spark.createDataFrame([("High",), ("other",), (None,)], "band string")
    got = [r[0] for r in df.select(recommended_action("band")).collect()]
    assert got[0].startswith("Escalate") and got[1].startswith("Normal") and got[2] is None


def test_prompt_is_indented_json(spark):
    df = spark.createDataFrame([("I1", 0.1 + 0.2, "Low", "Do \"it\"\n", 3, None, 1, 1e-5, "1 - Critical", None, "é"),
                                ("I2", 1.0, "High", None, None, 2, None, 12345678.25, None, "g", "c")],
                               "number string, sla_breach_probability double, risk_band string, recommended_action string, total_events long,"
                               "reassignment_count_max int, reopen_count_max int, resolution_hours double, priority string, "
                               "assignment_group string, category string")
    for r in explain.explanation_prompts(df).collect():
        body = r["user_message"].removeprefix(explain.USER_PREFIX)
        assert body == json.dumps(json.loads(body), indent=2)
    assert explain.explanation_prompts(df, bands=("High",)).count() == 1


def test_python_float(spark):
    values = [0.0, 1.0, 0.5, 123.25, 1e-4, 0.00025, 1e-5, 2.5e-7, 1e7, 123456789.5, 1e15, 1e16, 1.5e22, -3e-9, -0.001]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(python_float(F.col("v"))).collect()] == [repr(v) for v in values]


class _Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    def __init__(self, master, setting=None, folder=None):
        self.sparkContext, self.settings = _Context(master, folder), {"spark.checkpoint.dir": setting}
        self.conf = self

    def get(self, key, default):
        return self.settings.get(key) or default

    def set(self, key, value):
        self.settings[key] = value


def test_checkpoint_folder_rules():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Session("spark://host:7077"))
    assert session.ensure_checkpoint_dir(_Session("spark://host:7077", setting="hdfs://x/y")) == "hdfs://x/y"
    assert session.ensure_checkpoint_dir(_Session("yarn", folder="hdfs://set/by/context")) == "hdfs://set/by/context"
    assert "breachlens" in session.ensure_checkpoint_dir(_Session("local[2]"))


def test_scratch_can_be_removed(spark):
    import os

    path = session.shared_dir(spark, "scratch-test")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert os.path.isdir(local)
    session.remove_scratch(spark)
    assert not os.path.isdir(local)
