from pyspark.sql import functions as F

from breachlens.functions.decision import ACTION_HIGH, ACTION_LOW, ACTION_MEDIUM, recommended_action, risk_band
from breachlens.functions.text import format_fixed, format_g


def test_band_edges(spark):
    df = spark.createDataFrame([(0.2999,), (0.30,), (0.5999,), (0.60,), (float("nan"),)], "p double")
    got = [r[0] for r in df.select(risk_band("p")).collect()]
    assert got == ["Low", "Medium", "Medium", "High", "High"]


def test_actions(spark):
    df = spark.createDataFrame([("HIGH",), ("medium",), ("Low",), ("weird",)], "b string")
    got = [r[0] for r in df.select(recommended_action(F.col("b"))).collect()]
    assert got == [ACTION_HIGH, ACTION_MEDIUM, ACTION_LOW, ACTION_LOW]


def test_python_g_format(spark):
    vals = [12.0, 12.3456789, 1234567.0, 0.0001, 0.00001, -1.5, 0.0, 48.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(format_g(F.col("v"))).collect()]
    assert got == [f"{v:g}" for v in vals]


def test_python_fixed_format(spark):
    vals = [0.145, 0.125, 0.4125, 0.995, 1.0, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(format_fixed(F.col("v"), 2)).collect()]
    assert got == [f"{v:.2f}" for v in vals]


def test_a_missing_probability_is_refused(spark):
    import pytest
    df = spark.createDataFrame([(0.5,), (None,)], "p double")
    with pytest.raises(Exception, match="no risk band"):
        df.select(risk_band("p")).collect()
