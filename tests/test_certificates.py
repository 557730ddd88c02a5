"""The checks of models go red for bad models: permuted labels, few iterations, constant scores."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from breachlens.catalog import incidents
from breachlens.plans import certificates as ce
from breachlens.plans import training
from breachlens.schema import LABEL, PROB

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def prepared(spark):
    return training.prepare(incidents(spark, SF))


def permuted(prep):
    """The same rows with labels that have nothing to do with them."""
    label = (F.pmod(F.xxhash64("number"), F.lit(100)) < 36).cast("int")
    return dataclasses.replace(prep, train=prep.train.withColumn(LABEL, label))


def fit(prep, **options):
    return training.train_candidates(prep, training.TrainConfig(rf_trees=40, **options))


def test_good_models_pass(prepared):
    models = fit(prepared)
    slopes = ce.optimality(models["logreg"], prepared)
    assert slopes.where("NOT optimal").count() == 0 and slopes.count() == models["logreg"].encoder.width + 1
    for name, model in models.items():
        assert ce.skill(training.test_scores({name: model}, prepared.test)).first()["better_than_prior"], name


def test_permuted_labels_fail(prepared):
    models = fit(permuted(prepared))
    assert ce.optimality(models["logreg"], prepared).where("optimal").count() < 20
    for name, model in models.items():
        assert not ce.skill(training.test_scores({name: model}, prepared.test)).first()["better_than_prior"], name


def test_few_iterations_fail(prepared):
    slopes = ce.optimality(fit(prepared, candidates=("logreg",), lr_max_iter=2)["logreg"], prepared)
    assert slopes.where("NOT optimal").count() > 20


def test_constant_scores_fail(prepared):
    assert not ce.skill(prepared.test.withColumn(PROB, F.lit(0.5))).first()["better_than_prior"]
    assert not ce.skill(prepared.test.withColumn(PROB, F.lit(0.9))).first()["better_than_prior"]


def test_slopes_by_hand(spark):
    """One input, no regularisation: the slope at zero is the weighted mean of (p - y)·x over its deviation."""
    rows = [(f"I{i}", float(x), y) for i, (x, y) in enumerate([(0, 0), (1, 0), (2, 1), (3, 1), (4, 0), (9, 1)] * 20)]
    prep = training.prepare(spark.createDataFrame(rows, "number string, hours double, sla_breached int"))
    model = training.train_candidates(prep, training.TrainConfig(candidates=("logreg",)))["logreg"]
    got = {r["idx"]: r["slope"] for r in ce.optimality(model, prep).collect()}
    train = prep.train.collect()
    w, total = [r["class_weight"] for r in train], sum(r["class_weight"] for r in train)
    b, a = model.classifier.coefficients[0], model.classifier.intercept
    p = [1 / (1 + 2.718281828459045 ** -(a + b * r["hours"])) for r in train]
    pull = [wi * (pi - r["sla_breached"]) / total for wi, pi, r in zip(w, p, train)]
    mean = sum(wi * r["hours"] for wi, r in zip(w, train)) / total
    sd = (sum(wi * r["hours"] ** 2 for wi, r in zip(w, train)) / total - mean ** 2) ** 0.5
    assert got[-1] == pytest.approx(sum(pull), abs=1e-9)
    assert got[0] == pytest.approx((sum(x * r["hours"] for x, r in zip(pull, train)) + b / total) / sd, abs=1e-9)
