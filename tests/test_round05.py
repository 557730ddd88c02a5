"""What picking and reporting candidates repeats: the split, the encoded test part, the weights of the forest's rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from breachlens import catalog, session
from breachlens.operators import split
from breachlens.plans import forest, training
from breachlens.plans.encoding import OneHotEncoder, same_vectors
from breachlens.plans.forest import BalancedForest, draws

SCHEMA = "number string, hours double, category string, note string, sla_breached int"
SMALL = training.TrainConfig(rf_trees=4, rf_groups=2, rf_max_depth=3, lr_max_iter=5)


def incidents(spark, n=400, seed=4):
    rng = random.Random(seed)
    late = [rng.random() < 0.3 for _ in range(n)]
    return spark.createDataFrame([(f"I{i}", rng.gauss(3 if b else 0, 2) if i % 7 else None, rng.choice("ab" if b else "bc"),
                                   rng.choice(["x", "y", None]), int(b)) for i, b in enumerate(late)], SCHEMA)


@pytest.fixture(scope="module")
def fitted(spark):
    prep = training.prepare(incidents(spark))
    return prep, training.train_candidates(prep, SMALL)


def scores(frame):
    return sorted((r["name"], r["sla_breached"], round(r[training.PROB], 12)) for r in frame.collect())


def test_candidates_share_the_encoded_test_part(spark, fitted, monkeypatch, tmp_path):
    prep, models = fitted
    loaded = {n: training.load_model(training.save_model(m, str(tmp_path / n))) for n, m in models.items()}
    calls, encode = [], OneHotEncoder.encode
    monkeypatch.setattr(OneHotEncoder, "encode", lambda self, df: calls.append(df.columns) or encode(self, df))
    got = scores(training.test_scores(loaded, prep.test))
    assert len(calls) == 1
    alone = [s for n, m in models.items() for s in scores(training.test_scores({n: m}, prep.test))]
    assert got == sorted(alone) and len(got) == 2 * prep.test.count()


def test_encoders_of_other_rows_are_not_shared(spark, fitted, monkeypatch, tmp_path):
    prep, models = fitted
    other = training.fit_encoder(training.prepare(incidents(spark, seed=9)))
    again = training.fit_encoder(prep)                    # the same figures from another fit
    own = models["logreg"].encoder
    assert same_vectors(own, own) and not same_vectors(own, other) and not same_vectors(own, again)
    both = {"logreg": models["logreg"], "random_forest": training.RiskModel(again, models["random_forest"].classifier)}
    calls, encode = [], OneHotEncoder.encode
    monkeypatch.setattr(OneHotEncoder, "encode", lambda self, df: calls.append(1) or encode(self, df))
    training.test_scores(both, prep.test)
    assert len(calls) == 2


def test_a_model_saved_without_an_origin_is_read(spark, fitted):
    _, models = fitted
    fields = {k: v for k, v in vars(models["logreg"].encoder).items() if k != "origin"}
    old = [OneHotEncoder.load("/m", {"kind": "onehot", **fields}) for _ in range(2)]
    assert old[0].origin == "" and old[0].sizes == models["logreg"].encoder.sizes and not same_vectors(*old)


def test_the_split_of_the_fit_serves_the_test_part(spark, monkeypatch, tmp_path):
    folder = str(tmp_path)
    monkeypatch.setattr(catalog, "incidents", lambda s, d: incidents(s))
    monkeypatch.setattr(catalog, "_fit", lambda s, d: (p := training.prepare(catalog._incidents(s, d)), training.train_candidates(p, SMALL)))
    want = sorted(r["number"] for r in catalog._test_part(spark, folder).collect())
    models = catalog._models(spark, folder)
    monkeypatch.setattr(split, "stratified_split", lambda *a, **k: pytest.fail("split again"))
    part = catalog._test_part(spark, folder)
    assert sorted(r["number"] for r in part.collect()) == want and len(want) == 80
    report = training.report_candidates(models, part).collect()
    assert len(report) == 10 and all(r["support"] == 80 for r in report if r["class"] == "accuracy")


def test_a_written_table_is_read_with_its_schema(spark):
    df = spark.range(3).select("id", F.array(F.lit(1.5)).alias("v"), F.lit(None).cast("string").alias("s"))
    back = session.written(df, "t")
    assert back.dtypes == df.dtypes
    assert sorted(map(tuple, back.collect())) == [(i, [1.5], None) for i in range(3)]
    assert session.at_once(spark, [lambda: spark.range(2).count(), lambda: "b"]) == [2, "b"] and session.at_once(spark, []) == []


def test_prepare_weighs_classes_as_their_rows_do(spark, fitted):
    prep, _ = fitted
    assert prep.sum_weights == pytest.approx(prep.train.agg(F.sum(training.WEIGHT)).first()[0], rel=1e-12)


def test_forest_rows_hold_draws(spark, fitted, monkeypatch):
    prep, _ = fitted
    kept, write = [], forest.written
    monkeypatch.setattr(forest, "written", lambda df, name: kept.append(write(df, name)) or kept[-1])
    model = training.train_candidates(prep, training.TrainConfig(rf_trees=4, rf_groups=2, rf_max_depth=3, candidates=("random_forest",)))
    assert isinstance(model["random_forest"].classifier, BalancedForest)
    (table,) = kept
    assert dict(table.dtypes)["weights"] == "array<tinyint>"
    want = prep.train.select(*[F.sum(draws(F.col("number"), g, SMALL.seed)) for g in range(2)]).first()
    assert table.select(*[F.sum(F.col("weights")[g]) for g in range(2)]).first() == want


def test_draws_and_class_weights_give_the_sums_of_weights():
    class Sent:
        value = ([([-1], [0.0], [-1])] * 2, [0, 1], {0: [0], 1: [0]}, {1: np.array([-1.0, 0.0, 1.5])})

    rng = np.random.default_rng(3)
    places = pa.array([[0, 1, 2][:n] for n in rng.integers(0, 4, 200)], pa.list_(pa.int32()))
    values = pa.array([rng.choice([-2.0, 0.0, 1.0, 2.0], n).tolist() for n in np.asarray(places.value_lengths())], pa.list_(pa.float64()))
    label, drawn = rng.integers(0, 2, 200), rng.integers(0, 3, (200, 2))
    of_class = np.array([[0.75, 0.5], [1.5, 2.0]])

    def sums(weights, kind, *more):
        columns = [places, values, pa.array(label, pa.int32()), pa.array(weights.tolist(), pa.list_(kind))]
        batch = pa.RecordBatch.from_arrays(columns, names=["places", "values", "label", "weights"])
        return pa.Table.from_batches(forest._grower(Sent, 5, 3, 3, *more)(iter([batch]))).to_pylist()

    found = sums(drawn, pa.int8(), of_class)
    assert found == sums(drawn * of_class[label], pa.float64()) and len(found) > 10


def test_quantiles_are_taken_of_inputs_with_other_values(spark):
    vectors = [([0, 1, 2], [float(i), 1.0, -1.0 if i % 5 == 0 else 1.0]) if i % 2 else ([1, 3], [0.0, 1.0]) for i in range(200)]
    rows = spark.createDataFrame(vectors, "places array<int>, values array<double>")
    cuts = forest._cut_points(rows)
    assert sorted(cuts) == [0, 2]                         # 1 and 3 hold 0 and 1 only
    assert cuts[2].tolist() == [-1.0, 0.0] and len(cuts[0]) == forest.MAX_BINS - 1
    assert cuts[0].tolist() == sorted(cuts[0]) and cuts[0][0] == 0.0 and cuts[0][-1] < 199.0
    assert forest._cut_points(rows.where("places[0] = 1")) == {}
