"""One-hot vectors from the vocabulary table against the library's indexer and encoder."""

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder as LibraryOneHot
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from breachlens.plans import encoding, training

SCHEMA = "number string, total_events long, hours double, category string, caller_id string, empty string, sla_breached int"


def rows(n=400, seed=3):
    rng = random.Random(seed)
    return [(f"I{i}", rng.randrange(9), rng.choice([None, 1.5, 2.25]), rng.choice([None, "a", "b", "hot", "hot", "hot", "e", "é"]),
             rng.choice(["busy"] * 3 + [f"caller {rng.randrange(60)}"]), None, i % 2) for i in range(n)]


def library(train, modes, medians, other):
    """The same vectors by StringIndexer (frequent first) and OneHotEncoder."""
    fill = lambda df: df.withColumn("hours", F.coalesce("hours", F.lit(medians["hours"]))).withColumn(
        "total_events", F.col("total_events").cast("double")).withColumn("category", F.coalesce("category", F.lit(modes["category"])))
    cats = ["category", "caller_id"]
    stages = [StringIndexer(inputCols=cats, outputCols=["i0", "i1"], handleInvalid="keep"),
              LibraryOneHot(inputCols=["i0", "i1"], outputCols=["o0", "o1"], dropLast=True),
              VectorAssembler(inputCols=["total_events", "hours", "o0", "o1"], outputCol="v")]
    made = Pipeline(stages=stages).fit(fill(train)).transform(fill(other))
    return {r["number"]: list(r["v"].toArray()) for r in made.collect()}


@pytest.mark.parametrize("small,hot", [(100_000, 1000), (0, 20), (0, 10 ** 9)])
def test_vectors_are_those_of_the_library(spark, monkeypatch, small, hot):
    monkeypatch.setattr(encoding, "SMALL", small)
    monkeypatch.setattr(encoding, "HOT", hot)
    train = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    other = spark.createDataFrame(rows(150, 9) + [("unseen", 1, 2.0, "new", "nobody", "x", 0), ("null", None, None, None, None, None, 1)], SCHEMA)
    other = other.where("total_events IS NOT NULL")
    medians, modes = {"total_events": 4.0, "hours": 1.5}, {"category": "hot", "caller_id": "busy"}
    own = encoding.OneHotEncoder.fit(train, ["total_events", "hours"], ["category", "caller_id", "empty"], medians, modes)
    made = own.encode(other)
    assert made.columns == [*other.columns, "features"]
    got = {r["number"]: r["features"] for r in made.collect()}
    assert {k: list(v.toArray()) for k, v in got.items()} == library(train, modes, medians, other)
    assert got["unseen"].size == own.width and got["unseen"].numNonzeros() == 2
    names = {r["idx"]: r["feature"] for r in own.names(spark).collect()}
    assert sorted(names) == list(range(own.width)) and names[2] == "category__ohe_hot"


def test_ranks_over_many_partitions(spark, tmp_path):
    values = [(f"v{i:04d}",) for i in range(3000) for _ in range(1 + (i % 7 == 0))]
    train = spark.createDataFrame(values, "c string").repartition(7)
    path = encoding.vocabulary(train, ["c"], {}, str(tmp_path / "v"))
    got = {r["value"]: r["idx"] for r in spark.read.parquet(path).collect()}
    want = sorted({v for v, in values}, key=lambda v: (int(v[1:]) % 7 != 0, v))
    assert got == {v: i for i, v in enumerate(want)}


def test_saved_models_score_alike(spark, tmp_path):
    train = spark.createDataFrame(rows(), SCHEMA)
    for encoder in ("onehot", "hashing"):
        cfg = training.TrainConfig(rf_trees=3, rf_max_depth=3, lr_max_iter=20, encoder=encoder, hash_features=32)
        prep = training.prepare(train, cfg)
        for name, model in training.train_candidates(prep, cfg).items():
            loaded = training.load_model(training.save_model(model, str(tmp_path / f"{encoder}-{name}")))
            assert loaded.columns == model.columns == ["total_events", "hours", "category", "caller_id", "empty"]
            a, b = ({r["number"]: r["probability"] for r in m.transform(prep.test).collect()} for m in (model, loaded))
            assert a == b
