"""Breach-risk classifiers on ``pyspark.ml``: preprocessing fitted on the
training rows, a weighted logistic regression and a weighted random forest,
held-out evaluation, best-by-AUC selection, save/load.

Preprocessing (``encoding``) fills numbers with the fitted medians, categories with
the modes, and one-hot encodes them through a vocabulary table. Unseen or missing
categories encode as the all-zero block. The split rows and the vectors are written
to the shared checkpoint folder, so statistics and the iterative fits read the columns
they need of a table rather than recomputing the summary lineage on every pass (and
survive executor loss).
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (ClassificationModel, LogisticRegression, LogisticRegressionModel,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breachlens.operators import features, metrics, split
from breachlens.plans.encoding import FEATURES, HashingEncoder, OneHotEncoder, load_encoder, same_vectors
from breachlens.plans.forest import BalancedForest
from breachlens.plans.logistic import MOST_ROWS, WideLogistic
from breachlens.schema import KEY, LABEL, PROB
from breachlens.session import at_once, materialise, path_exists, shared_dir, written

log = logging.getLogger(__name__)

WEIGHT = "class_weight"
MOST_DENSE = 1 << 18       # inputs up to which the library fits the regression, with some forty vectors of them on the driver
# Fixed value: the message users of the public job know.
MISSING_LABEL = "sla_breached not found. Is 'made_sla' present in the CSV?"


ONE_CLASS = "The {part} part has no incident with label {label}; both classes are needed."


@dataclass(frozen=True)
class TrainConfig:
    """``rf_max_depth``: the library grows trees level by level and holds one histogram for each node of a level, so
    the depth bounds the memory of a fit (its own limit is 30); 12 allows 4,096 leaves a tree. ``rf_groups``: bootstrap
    samples, each with its own class weights, that share out the trees (see ``forest``); 0 is one forest of the library's
    own bootstraps with the class weights of the whole training part.
    ``encoder``: ``onehot`` has an input for every category of the training part, whose vocabulary is a table; the
    classifiers hold a number for each input. ``hashing`` maps categories to ``hash_features`` counters."""

    seed: int = 42
    test_size: float = 0.2
    lr_max_iter: int = 250
    rf_trees: int = 300
    rf_max_depth: int = 12
    rf_groups: int = 10
    encoder: str = "onehot"
    hash_features: int = 1 << 16
    exact_medians: bool = True
    candidates: tuple[str, ...] = ("logreg", "random_forest")


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    num_cols: list[str]
    cat_cols: list[str]
    medians: dict[str, float]
    modes: dict[str, str]
    sum_weights: float
    n_inputs: int = field(default=0)
    parts: str = ""            # path of the split rows


def prepare(summary: DataFrame, cfg: TrainConfig = TrainConfig()) -> Prepared:
    """Split, fit imputation statistics on train, attach balanced class weights. The split reads ``summary`` several
    times, so it should be a written table."""
    if LABEL not in summary.columns:
        raise ValueError(MISSING_LABEL)
    parts = split.stratified_split(summary, LABEL, cfg.test_size, cfg.seed)
    schema, path = parts.schema, shared_dir(summary.sparkSession, "parts")
    parts.write.parquet(path)  # once; later stages read their columns of the table
    parts = summary.sparkSession.read.schema(schema).parquet(path)
    inputs = features.feature_projection(parts.drop("split"))
    num_cols, cat_cols = features.split_feature_types(inputs)
    train = parts.where(F.col("split") == "train")
    test = parts.where(F.col("split") == "test")
    # Fitted parameters: one value per input column (bounded by the schema width).
    med_row, mode_rows, weight_rows, tested = at_once(summary.sparkSession, [
        lambda: features.numeric_medians(train, num_cols, cfg.exact_medians).first() if num_cols else {},
        lambda: features.categorical_modes(train, cat_cols).collect() if cat_cols else [],
        lambda: features.class_weights(train).collect(),
        lambda: test.select(LABEL).distinct().collect()])
    empty = [c for c in num_cols if med_row[c] is None]
    if empty:
        log.warning("columns without any value in the training part are left out: %s", ", ".join(empty))
    num_cols = [c for c in num_cols if c not in empty]
    medians = {c: float(med_row[c]) for c in num_cols}
    modes = {r["feature"]: r["mode"] for r in mode_rows}
    weights = {int(r[LABEL]): float(r["weight"]) for r in weight_rows}
    tested = {int(r[LABEL]) for r in tested}
    for part, labels in (("training", weights), ("test", tested)):
        for label in (0, 1):
            if label not in labels:
                raise ValueError(ONE_CLASS.format(part=part, label=label))
    wexpr = F.lit(None).cast("double")
    for k, w in weights.items():
        wexpr = F.when(F.col(LABEL) == k, F.lit(w)).otherwise(wexpr)
    train = train.withColumn(WEIGHT, wexpr)
    sum_w = sum(r["n_c"] * float(r["weight"]) for r in weight_rows)
    return Prepared(train, test, num_cols, cat_cols, medians, modes, sum_w, len(num_cols) + len(cat_cols), path)


def fit_encoder(p: Prepared, cfg: TrainConfig = TrainConfig()) -> OneHotEncoder | HashingEncoder:
    fitted = (p.train, p.num_cols, p.cat_cols, p.medians, p.modes)
    return HashingEncoder.fit(*fitted, cfg.hash_features) if cfg.encoder == "hashing" else OneHotEncoder.fit(*fitted)


@dataclass
class RiskModel:
    """An encoder and a classifier fitted on its vectors."""

    encoder: OneHotEncoder | HashingEncoder
    classifier: ClassificationModel | BalancedForest | WideLogistic

    @property
    def columns(self) -> list[str]:
        """The summary columns that the model reads."""
        return self.encoder.columns

    def transform(self, df: DataFrame) -> DataFrame:
        return self.classifier.transform(self.encoder.encode(df))


def classifiers(p: Prepared, cfg: TrainConfig) -> dict:
    # sklearn's C=1 penalises ½‖β‖² against a *summed* weighted loss; Spark's
    # loss is the weighted *mean*, so the equivalent L2 strength is 1/Σw.
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxIter=cfg.lr_max_iter,
                            regParam=1.0 / p.sum_weights, elasticNetParam=0.0, standardization=False)
    rf = RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, numTrees=cfg.rf_trees,
                                maxDepth=cfg.rf_max_depth, featureSubsetStrategy="sqrt", seed=cfg.seed)
    return {"logreg": lr, "random_forest": rf}


def aggregation_depth(partitions: int) -> int:
    """The depth of a tree aggregate that leaves the fewest partial sums, each as wide as the model, to the driver."""
    def left(depth: int) -> int:
        n, scale = partitions, max(2, math.ceil(partitions ** (1 / depth)))
        while n > scale + math.ceil(n / scale):
            n //= scale
        return n

    return min(range(2, 9), key=left)


def train_candidates(p: Prepared, cfg: TrainConfig = TrainConfig()) -> dict[str, RiskModel]:
    """One model per candidate; the encoder is fitted once and shared. Candidates are fitted at the same time: a fit is a
    chain of short jobs, whose waiting leaves cores to the others."""
    encoder = fit_encoder(p, cfg)
    encoded = encoder.encode(p.train.select(*dict.fromkeys([KEY, *encoder.columns, LABEL, WEIGHT]))).select(KEY, FEATURES, LABEL, WEIGHT)
    encoded = materialise(encoded) if cfg.encoder == "hashing" else encoded      # the other one has written its vectors
    clfs, spark = classifiers(p, cfg), p.train.sparkSession

    def fit(name: str):
        if name == "random_forest" and cfg.rf_groups:
            return BalancedForest.fit(encoded, KEY, LABEL, FEATURES, cfg.rf_trees, cfg.rf_groups, cfg.rf_max_depth, cfg.seed)
        if name == "logreg" and isinstance(encoder, OneHotEncoder) and encoder.width > MOST_DENSE:
            return WideLogistic.fit(encoded, LABEL, WEIGHT, FEATURES, encoder.width, encoder.rare_inputs(spark, MOST_ROWS),
                                    1.0 / p.sum_weights, cfg.lr_max_iter)
        if name == "logreg":
            clfs[name].setAggregationDepth(aggregation_depth(encoded.rdd.getNumPartitions()))
        return clfs[name].fit(encoded)

    fits = at_once(spark, [partial(fit, name) for name in cfg.candidates])
    return {name: RiskModel(encoder, f) for name, f in zip(cfg.candidates, fits)}


def input_weights(model: RiskModel, spark: SparkSession) -> DataFrame:
    """Rows (idx, weight) of a fitted classifier's inputs: coefficients or importances."""
    clf = model.classifier
    if isinstance(clf, WideLogistic):
        return clf.weights(spark)
    if isinstance(clf, BalancedForest):                     # most inputs cut no node
        used, weights = clf.importances
        found = spark.createDataFrame(pa.table({"idx": pa.array(used, pa.int64()), "weight": pa.array(weights, pa.float64())}))
        return spark.range(clf.width).withColumnRenamed("id", "idx").join(found, "idx", "left").fillna(0.0)
    weights = (clf.coefficients if hasattr(clf, "coefficients") else clf.featureImportances).toArray()
    return spark.createDataFrame(pa.table({"idx": pa.array(np.arange(len(weights)), pa.int64()), "weight": pa.array(weights, pa.float64())}))


def model_inputs(model: RiskModel, spark: SparkSession) -> DataFrame:
    """Rows (feature, weight) of a fitted classifier: coefficients (with the intercept) or importances."""
    clf = model.classifier
    linear = hasattr(clf, "intercept")
    named = input_weights(model, spark).join(model.encoder.names(spark), "idx", "left").select(
        F.coalesce("feature", F.concat(F.lit(f"{FEATURES}_"), F.col("idx").cast("string"))).alias("feature"), "weight")
    if linear:
        named = named.union(spark.createDataFrame([("(intercept)", float(clf.intercept))], named.schema))
    return named


def positive_probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn(PROB, vector_to_array(F.col("probability"))[1])


def test_scores(models: dict[str, RiskModel], test: DataFrame) -> DataFrame:
    """(name, label, probability) of every test row under every candidate, written: each model runs once, and candidates
    whose vectors are the same share the encoded rows."""
    frames, encoded = [], []
    for n, m in models.items():
        rows = next((r for e, r in encoded if same_vectors(e, m.encoder)), None)
        if rows is None:
            wanted = {KEY, LABEL, *m.columns}
            rows = m.encoder.encode(test.select(*[c for c in test.columns if c in wanted]))
            encoded.append((m.encoder, rows))
        frames.append(positive_probability(m.classifier.transform(rows)).select(F.lit(n).alias("name"), LABEL, PROB))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return written(out, "test-scores")


def evaluate(scores: DataFrame, name: str, threshold: float = 0.5) -> DataFrame:
    """One row: name, ROC-AUC, confusion counts and metrics at the threshold on held-out scores."""
    auc = metrics.roc_auc(scores).select("roc_auc")
    tm = metrics.threshold_metrics(scores, threshold=threshold)
    acc = F.try_divide((F.col("tp") + F.col("tn")).cast("double"), F.col("total").cast("double"))
    return auc.crossJoin(tm).select(F.lit(name).alias("name"), "roc_auc", "tn", "fp", "fn", "tp",
                                    acc.alias("accuracy"), "precision", "recall", "f1")


def _per_candidate(models: dict[str, RiskModel], scores: DataFrame, table) -> DataFrame:
    frames = [table(scores.where(F.col("name") == n).drop("name"), n) for n in models]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def evaluate_candidates(models: dict[str, RiskModel], test: DataFrame) -> DataFrame:
    """One row of held-out metrics per candidate."""
    return _per_candidate(models, test_scores(models, test), evaluate)


def report_candidates(models: dict[str, RiskModel], test: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The per-class report of every candidate on the test part."""
    return _per_candidate(models, test_scores(models, test), lambda s, n: metrics.classification_report(
        s, threshold=threshold).select(F.lit(n).alias("name"), "*"))


def pick_best(evaluations: DataFrame, order: tuple[str, ...] = TrainConfig.candidates) -> DataFrame:
    """Highest ROC-AUC; on a tie the earlier candidate wins (one that ``order`` doesn't name comes last)."""
    rank = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("name"))
    return evaluations.orderBy(F.desc_nulls_last("roc_auc"), F.when(rank > 0, rank).otherwise(len(order) + 1), "name").limit(1)


def save_model(model: RiskModel, path: str, spark: SparkSession | None = None) -> str:
    """``spark`` is needed in a thread without an active session."""
    spark = spark or SparkSession.active()
    model.encoder.save(spark, path)
    if isinstance(model.classifier, (BalancedForest, WideLogistic)):
        model.classifier.save(spark, f"{path}/classifier")
    else:
        model.classifier.write().overwrite().save(f"{path}/classifier")
    return path


def load_model(path: str) -> RiskModel:
    spark = SparkSession.active()
    if path_exists(spark, f"{path}/classifier/forest"):
        return RiskModel(load_encoder(spark, path), BalancedForest.load(spark, f"{path}/classifier"))
    if path_exists(spark, f"{path}/classifier/wide"):
        return RiskModel(load_encoder(spark, path), WideLogistic.load(spark, f"{path}/classifier"))
    kind = DefaultParamsReader.loadMetadata(f"{path}/classifier", spark)["class"].rsplit(".", 1)[1]
    classifier = {c.__name__: c for c in (LogisticRegressionModel, RandomForestClassificationModel)}[kind]
    return RiskModel(load_encoder(spark, path), classifier.load(f"{path}/classifier"))


__all__ = ["TrainConfig", "Prepared", "RiskModel", "prepare", "fit_encoder", "classifiers", "train_candidates",
           "positive_probability", "test_scores", "evaluate", "evaluate_candidates", "report_candidates", "input_weights", "model_inputs",
           "pick_best", "save_model", "load_model", "MISSING_LABEL"]
