"""Registered queries: ``name → (spark, sf_dir) -> DataFrame``.

Every query starts from the driver tables via the stand-in log, so its work
grows with ``lineitem``. Queries downstream of a score use the deterministic
proxy score (so a DuckDB oracle can check them); the model queries train on
the same summary with the job's settings (300 trees, 250 iterations).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breachlens.functions.decision import recommended_action, risk_band, threshold_predict
from breachlens.operators import decide, explain, features, listing, metrics, reports, split, summary
from breachlens.operators.ranks import RANK_ERROR
from breachlens.plans import certificates, encoding, scoring, training
from breachlens.schema import KEY, LABEL, LOG_ORDER, PROB
from breachlens.session import at_once, materialise, remove_path, shared_dir, shuffles_freed, written
from breachlens.sources import event_log as src
from breachlens.sources import sinks
from breachlens.sources.stand_in import read_table, stand_in_event_log
from breachlens.streaming.summary_table import SummaryTable, follow

Query = Callable[[SparkSession, str], DataFrame]

# Dashboard state used by the list-view queries (the reference's widget values).
LIST_BANDS = ("High", "Medium")
LIST_MIN_PROB = 0.35
LIST_SORT = "reassignment_count_max"
SEARCH_QUERY = "c0+1[0-9]3"
LIST_QUERY = "1"
DETAIL_NUMBER = "INC0000001"
STREAM_FILES = 6
FILE_EVENTS = 1_000_000


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in_event_log(spark, sf_dir)


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.incident_summary(event_log(spark, sf_dir), order_by="event_seq")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.proxy_scored(incidents(spark, sf_dir))


# ── sources / sinks ──────────────────────────────────────────────────────────

def _q_scan_event_log(spark, d):
    path = src.write_event_log_csv(event_log(spark, d), shared_dir(spark, "event-log-csv"), compression="gzip")
    return src.read_event_log(spark, path).drop(LOG_ORDER)


def _q_scan_iso_log(spark, d):
    """A log with ISO dates, read without saying so."""
    path = src.write_event_log_csv(event_log(spark, d), shared_dir(spark, "iso-log-csv"), date_format=src.ISO, compression="gzip")
    return src.read_event_log(spark, path).drop(LOG_ORDER)


def _q_scan_quoted_log(spark, d):
    """A folder in which some files have line breaks and quotes inside fields."""
    log, path = written(event_log(spark, d), "quoted-log"), shared_dir(spark, "quoted-log-csv")     # both parts read it
    plain = F.pmod(F.col("event_seq"), F.lit(2)) == 0
    broken = F.concat(F.lit('a "quoted"\nsecond, line: '), F.col("category"))
    src.write_event_log_csv(log.where(plain), path, compression="gzip")
    src.write_event_log_csv(log.where(~plain).withColumn("category", broken), path, mode="append", compression="gzip")
    return src.read_event_log(spark, path).drop(LOG_ORDER)


def _q_parse_event_dates(spark, d):
    log = event_log(spark, d)
    cols = ("opened_at", "resolved_at", "sys_updated_at")
    as_text = log.select(KEY, "event_seq", *[F.date_format(c, src.DAY_FIRST).alias(c) for c in cols])
    return src.parse_event_dates(as_text)


def _q_normalise_made_sla(spark, d):
    return src.normalise_made_sla(event_log(spark, d).select(KEY, "event_seq", "made_sla"))


def _q_export_scored(spark, d):
    s = scored(spark, d)
    path = sinks.export_scored(s, shared_dir(spark, "scored-csv"))
    return sinks.read_exported(spark, path, s.schema)


def _q_log_profile(spark, d):
    return src.log_profile(event_log(spark, d))


def _q_score_quantiles_sketched(spark, d):
    """Quantiles from mergeable sketches: whether each value's rank is within the stated error of the wanted one."""
    s = scored(spark, d)
    found = reports.score_quantiles(s, exact=False)
    off = F.lit(RANK_ERROR) * F.col("n") + 1
    within = (F.col("below") <= F.col("q") * F.col("n") + off) & (F.col("upto") >= F.col("q") * F.col("n") - off)
    return reports.quantile_ranks(s, PROB, found, reports.SCORE_PROBS).select("name", "n", within.alias("within"))


def log_files(events: int) -> int:
    """Files of a log that a stream takes in ``STREAM_FILES`` batches: a file grows to ``FILE_EVENTS`` events, then a
    batch gets more files, so that no task reads more than one."""
    return STREAM_FILES * max(1, -(-events // (STREAM_FILES * FILE_EVENTS)))


def _q_summary_by_batches(spark, d):
    """The summary kept up by a stream that takes the log batch by batch, merged from the batches' partial states."""
    folder = shared_dir(spark, "log-stream")
    log = event_log(spark, d)
    files = log_files(read_table(spark, d, "lineitem").count())        # from the file footers
    log.repartition(files).write.parquet(folder)
    table = SummaryTable(spark, shared_dir(spark, "summary-state"), order_by="event_seq")
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files // STREAM_FILES).parquet(folder)
    follow(stream, table, shared_dir(spark, "summary-checkpoint")).awaitTermination()
    return table.summary()


# ── model queries: full settings; a model fitted for one query serves the others that only apply one ─────────────

def _incidents(spark, d):
    """The incidents, written once for an application's model queries on a data folder: split, training and scoring read them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INCIDENT_PATHS:
        path = shared_dir(spark, "incidents")
        with shuffles_freed(spark):
            incidents(spark, d).write.parquet(path)
        _INCIDENT_PATHS[key] = path
    return spark.read.parquet(_INCIDENT_PATHS[key])


_INCIDENT_PATHS: dict = {}


def _fit(spark, d):
    with shuffles_freed(spark):
        prep = training.prepare(_incidents(spark, d))
        return prep, training.train_candidates(prep)


def _saved_models(spark, d):
    """Paths of this application's fitted models for one data folder (in the shared folder, never in this process)."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MODEL_PATHS:
        prep, models = _fit(spark, d)
        _PART_PATHS[key] = prep.parts
        save = lambda n, m: training.save_model(m, shared_dir(spark, f"model-{n}"), spark)
        _MODEL_PATHS[key] = dict(zip(models, at_once(spark, [partial(save, n, m) for n, m in models.items()])))
    return _MODEL_PATHS[key]


_MODEL_PATHS: dict = {}
_PART_PATHS: dict = {}


def _models(spark, d):
    return {n: training.load_model(p) for n, p in _saved_models(spark, d).items()}


def _test_part(spark, d):
    """The rows that this application's models were not fitted on; without models yet, by the same split."""
    path = _PART_PATHS.get((spark.sparkContext.applicationId, d))
    parts = spark.read.parquet(path) if path else split.stratified_split(_incidents(spark, d))
    return parts.where(F.col("split") == "test")


def _q_evaluate(spark, d):
    return training.evaluate_candidates(_models(spark, d), _test_part(spark, d))


def _best_model(spark, d):
    models = _models(spark, d)
    return models[training.pick_best(training.evaluate_candidates(models, _test_part(spark, d))).first()["name"]]


def _better_than_chance():
    return F.col("roc_auc") > certificates.auc_bound(F.col("fn") + F.col("tp"), F.col("tn") + F.col("fp"))


def _q_pick_best(spark, d):
    """Whether the pick has the greatest ROC-AUC of all candidates, and more than chance gives."""
    evaluations = materialise(_q_evaluate(spark, d))
    greatest = evaluations.agg(F.max("roc_auc").alias("greatest"), F.count(F.lit(1)).alias("candidates"))
    return training.pick_best(evaluations).crossJoin(greatest).select(       # one row each
        "candidates", (F.col("tn") + F.col("fp")).alias("met"), (F.col("fn") + F.col("tp")).alias("breached"),
        (F.col("roc_auc") == F.col("greatest")).alias("is_greatest"), _better_than_chance().alias("better_than_chance"))


def _q_model_roundtrip(spark, d):
    """Every incident, and whether its score is the same after saving and loading the model."""
    best = _best_model(spark, d)
    loaded = training.load_model(training.save_model(best, shared_dir(spark, "best-model")))
    inc = _incidents(spark, d)
    a = scoring.score_incidents(best, inc, ranked=False).select(KEY, F.col(PROB).alias("p_saved"))
    b = scoring.score_incidents(loaded, inc, ranked=False).select(F.col(KEY).alias("_other"), F.col(PROB).alias("p_loaded"))
    both = a.join(b, F.col(KEY).eqNullSafe(F.col("_other")), "full")   # the summary has one row per ticket, also for NULL
    return both.select(F.coalesce(KEY, "_other").alias(KEY), F.col("p_saved").eqNullSafe(F.col("p_loaded")).alias("same"))


def another_log(spark, d):
    """A log of other tickets, written as plain CSV without ``event_seq``: every third event has a category that no
    training row has, and the order is that of the file."""
    log = event_log(spark, d)
    new = F.when(F.pmod(F.col("event_seq"), F.lit(3)) == 0, F.lit("Unseen, \"new\"")).otherwise(F.col("category"))
    log, rows = log.withColumn(KEY, F.concat(F.lit("N"), F.col(KEY))).withColumn("category", new), shared_dir(spark, "upload-rows")
    with shuffles_freed(spark):             # those of the joins are gone when the rows are sorted
        log.write.parquet(rows)
        log = spark.read.schema(log.schema).parquet(rows)
        path = src.write_event_log_csv(log.orderBy("event_seq").drop("event_seq"), shared_dir(spark, "upload-csv"), compression="gzip")
    remove_path(spark, rows)
    return path


def _checked_scores(scored):
    """Facts of scored incidents that hold for every good model: each score lies in [0, 1] and has its band and action,
    and all of them together tell breached from met tickets."""
    ok = F.col(PROB).between(0.0, 1.0)
    band = F.col("risk_band") == risk_band(PROB)
    action = F.col("recommended_action") == recommended_action(F.col("risk_band"))
    rows = materialise(scored.select(KEY, LABEL, PROB, "category", "total_events", (ok & band & action).alias("consistent")))
    informed = certificates.skill(rows).select(F.col("better_than_prior").alias("informed"))      # one row
    return rows.drop(PROB).crossJoin(F.broadcast(informed))


def _q_score_new_log(spark, d):
    return _checked_scores(scoring.score_new_log(_best_model(spark, d), src.read_event_log(spark, another_log(spark, d), numbered=True)))


def _trained(spark, d, name):
    with shuffles_freed(spark):
        prep = training.prepare(_incidents(spark, d))
        return prep, training.train_candidates(prep, training.TrainConfig(candidates=(name,)))[name]


def _q_train_logreg(spark, d):
    """Every input of the model, and whether the loss is flat there at its coefficient (see ``certificates``)."""
    prep, model = _trained(spark, d, "logreg")
    return certificates.named(model, certificates.optimality(model, prep)).select("feature", "optimal")


def _q_train_random_forest(spark, d):
    prep, model = _trained(spark, d, "random_forest")
    weights = training.model_inputs(model, spark).agg(F.count(F.lit(1)).alias("inputs"),
                                                      F.round(F.sum("weight"), 6).alias("importance"))
    skill = certificates.skill(training.test_scores({"random_forest": model}, prep.test))
    return weights.crossJoin(skill).select("inputs", F.lit(model.classifier.getNumTrees).cast("long").alias("trees"),
                                           "importance", F.col("n").alias("test_rows"), "better_than_prior")


def _q_model_weights(spark, d):
    """Coefficients and importances of both candidates."""
    prep, models = _fit(spark, d)
    frames = [training.model_inputs(m, spark).select(F.lit(n).alias("name"), "feature", "weight") for n, m in models.items()]
    return frames[0].union(frames[1])


def _q_train_candidates(spark, d):
    prep, models = _fit(spark, d)
    scores = training.test_scores(models, prep.test)
    skills = [certificates.skill(scores.where(F.col("name") == n)).select(F.lit(n).alias("name"), "better_than_prior") for n in models]
    return certificates.class_losses(scores).drop("log_loss").join(F.broadcast(skills[0].union(skills[1])), "name")


def _q_evaluate_candidates(spark, d):
    """Totals that the split fixes, and whether the order of scores is better than chance gives."""
    return _q_evaluate(spark, d).select("name", (F.col("tn") + F.col("fp")).alias("met"),
                                        (F.col("fn") + F.col("tp")).alias("breached"),
                                        _better_than_chance().alias("better_than_chance"))


def _q_report(spark, d):
    return training.report_candidates(_models(spark, d), _test_part(spark, d))


def _q_training_job(spark, d):
    """The job on another log: what the split fixes, and checks of the figures it reports."""
    from breachlens.plans.train_job import run_training
    log = src.read_event_log(spark, another_log(spark, d), numbered=True)
    done = run_training(spark, written(summary.incident_summary(log), "summary"), shared_dir(spark, "training-job"))
    greatest = done.agg(F.max("roc_auc").alias("greatest"), F.count_if("is_best").alias("picked"))
    return done.crossJoin(greatest).select(                                  # one row
        "name", (F.col("tn") + F.col("fp")).alias("met"), (F.col("fn") + F.col("tp")).alias("breached"),
        _better_than_chance().alias("better_than_chance"), "picked",
        (~F.col("is_best") | (F.col("roc_auc") == F.col("greatest"))).alias("pick_is_greatest"))


QUERIES: dict[str, Query] = {
    # A. sources / sinks
    "scan_event_log": _q_scan_event_log,
    "scan_iso_log": _q_scan_iso_log,
    "scan_quoted_log": _q_scan_quoted_log,
    "parse_event_dates": _q_parse_event_dates,
    "normalise_made_sla": _q_normalise_made_sla,
    "export_scored": _q_export_scored,
    "model_roundtrip": _q_model_roundtrip,
    "score_new_log": _q_score_new_log,
    "log_profile": _q_log_profile,
    # B. projections / filters / predicates
    "summary_minimal_schema": lambda s, d: summary.incident_summary(
        event_log(s, d).select(KEY, "event_seq", "priority", "reopen_count", "opened_at")),
    "feature_projection": lambda s, d: features.feature_projection(incidents(s, d)),
    "sla_label": lambda s, d: incidents(s, d).select(KEY, "made_sla", LABEL),
    "resolution_hours": lambda s, d: summary.resolution_hours(event_log(s, d)),
    "risk_band": lambda s, d: scored(s, d).select(KEY, PROB, risk_band(PROB).alias("risk_band")),
    "recommended_action": lambda s, d: scored(s, d).select(
        KEY, "risk_band", recommended_action(F.col("risk_band")).alias("recommended_action")),
    "threshold_predict": lambda s, d: scored(s, d).select(KEY, PROB, threshold_predict(PROB, 0.5).alias("predicted")),
    "filter_bands": lambda s, d: listing.filter_bands(scored(s, d), LIST_BANDS).select(KEY, PROB, "risk_band"),
    "filter_min_prob": lambda s, d: listing.filter_min_prob(scored(s, d), LIST_MIN_PROB).select(KEY, PROB),
    "search_incidents": lambda s, d: listing.search_incidents(scored(s, d), SEARCH_QUERY).select(KEY, PROB),
    "incident_detail": lambda s, d: listing.incident_detail(scored(s, d), DETAIL_NUMBER),
    # C. aggregations
    "total_events": lambda s, d: summary.total_events(event_log(s, d)),
    "sys_mod_stats": lambda s, d: summary.sys_mod_stats(event_log(s, d)),
    "first_non_null_attrs": lambda s, d: summary.first_non_null_attrs(event_log(s, d)),
    "last_sla_flag": lambda s, d: summary.last_sla_flag(event_log(s, d)),
    "incident_summary": lambda s, d: incidents(s, d),
    "kpi_overview": lambda s, d: reports.kpi_overview(scored(s, d)),
    "band_counts": lambda s, d: reports.band_counts(scored(s, d)),
    "score_quantiles": lambda s, d: reports.score_quantiles(scored(s, d)),
    "score_quantiles_sketched": _q_score_quantiles_sketched,
    "summary_by_batches": _q_summary_by_batches,
    "score_histogram": lambda s, d: reports.score_histogram(scored(s, d)),
    "priority_band_crosstab": lambda s, d: reports.priority_band_crosstab(scored(s, d)),
    "top_groups": lambda s, d: reports.top_groups(scored(s, d)),
    "top_categories": lambda s, d: reports.top_categories(scored(s, d)),
    "calibration_table": lambda s, d: reports.calibration_table(scored(s, d)),
    "confusion_matrix": lambda s, d: metrics.confusion_matrix(scored(s, d)),
    "threshold_metrics": lambda s, d: metrics.threshold_metrics(scored(s, d)),
    "threshold_sweep": lambda s, d: metrics.threshold_sweep(scored(s, d)),
    "roc_auc": lambda s, d: metrics.roc_auc(scored(s, d)),
    "classification_report": lambda s, d: metrics.classification_report(scored(s, d)),
    "driver_stats": lambda s, d: explain.driver_stats(scored(s, d)),
    # D. sorts / limits
    "ranked_incidents": lambda s, d: decide.ranked_incidents(scored(s, d)),
    "sort_incidents": lambda s, d: listing.sort_incidents(scored(s, d), "total_events", descending=False).select(
        KEY, "total_events", PROB),
    "incident_list": lambda s, d: listing.incident_list(scored(s, d), LIST_BANDS, LIST_MIN_PROB, LIST_SORT, True,
                                                        LIST_QUERY),
    "incident_list_count": lambda s, d: listing.incident_list_count(scored(s, d), LIST_BANDS, LIST_MIN_PROB),
    # E. explanations
    "risk_drivers": lambda s, d: _risk_drivers(s, d),
    "explain_offline": lambda s, d: explain.explain_offline(scored(s, d)),
    "explanation_facts": lambda s, d: explain.explanation_facts(scored(s, d)).select(
        KEY, "facts.sla_breach_probability", "facts.risk_level", "facts.recommended_action", "facts.key_factors.*"),
    "explanation_prompts": lambda s, d: explain.explanation_prompts(scored(s, d)),
    # F. ML preparation / training / evaluation
    "stratified_split": lambda s, d: split.stratified_split(incidents(s, d)).select(KEY, LABEL, "split"),
    "impute_numeric": lambda s, d: _impute_numeric(s, d),
    "impute_categorical": lambda s, d: _impute_categorical(s, d),
    "onehot_category_sizes": lambda s, d: _onehot_sizes(s, d),
    "class_weights": lambda s, d: features.class_weights(_train_rows(s, d)),
    "train_logreg": _q_train_logreg,
    "train_random_forest": _q_train_random_forest,
    "model_weights": _q_model_weights,
    "train_candidates": _q_train_candidates,
    "evaluate_candidates": _q_evaluate_candidates,
    "report_candidates": _q_report,
    "pick_best": _q_pick_best,
    "score_incidents": lambda s, d: _checked_scores(scoring.score_incidents(_best_model(s, d), _incidents(s, d))),
    "training_job": _q_training_job,
}


def _risk_drivers(spark, d):
    """Statistics and drivers read the scored incidents, which are written once with the columns of both."""
    signals = [c for c, _, _ in explain.SIGNALS]
    rows = written(scored(spark, d).select(KEY, *signals, "priority"), "scored")
    return explain.risk_drivers(rows).select(KEY, F.array_join("risk_drivers", " | ").alias("risk_drivers"))


def _train_rows(spark, d, columns=()):
    """The training part with key, label and the wanted columns. The split reads the summary several times."""
    rows = written(incidents(spark, d).select(KEY, LABEL, *columns), "incidents")
    return split.stratified_split(rows).where(F.col("split") == "train")


def _feature_types(spark, d):
    return features.split_feature_types(features.feature_projection(incidents(spark, d)))


def _impute_numeric(spark, d):
    num, _ = _feature_types(spark, d)
    return features.numeric_medians(_train_rows(spark, d, num), num)


def _impute_categorical(spark, d):
    _, cat = _feature_types(spark, d)
    return features.categorical_modes(_train_rows(spark, d, cat), cat)


def _onehot_sizes(spark, d):
    """From the vocabulary table that the models are trained with."""
    _, cat = _feature_types(spark, d)
    train = _train_rows(spark, d, cat)
    modes = {r["feature"]: r["mode"] for r in features.categorical_modes(train, cat).collect()}
    values = spark.read.parquet(encoding.vocabulary(train, cat, modes, shared_dir(spark, "vocabulary")))
    names = F.array(*[F.lit(c) for c in cat])
    return values.groupBy("col").agg(F.count(F.lit(1)).alias("n_categories")).select(
        names[F.col("col")].alias("feature"), "n_categories")


__all__ = ["QUERIES", "event_log", "incidents", "scored"]
