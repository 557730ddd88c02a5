"""Model-input preparation: feature projection, type discovery, imputation
statistics fitted on the training rows, one-hot sizes and class weights.

Statistics are computed with distributed aggregations and returned as small
DataFrames; ``impute`` applies them with a broadcast 1-row join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breachlens.operators.ranks import RANK_ERROR, approximate_quantiles, multi_column_quantiles
from breachlens.schema import LABEL, NON_FEATURE_COLS

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
            T.BooleanType)


def feature_projection(df: DataFrame, drop: tuple[str, ...] = NON_FEATURE_COLS) -> DataFrame:
    """Drop the identifier, label and raw timestamp columns that are not model inputs."""
    return df.drop(*[c for c in drop if c in df.columns])


def split_feature_types(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric columns, categorical columns) by data type; booleans count as numeric."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    cat = [f.name for f in df.schema.fields if f.name not in num]
    return num, cat


def numeric_medians(train: DataFrame, cols: list[str], exact: bool = True, rank_error: float = RANK_ERROR) -> DataFrame:
    """One row of medians (NULLs ignored), fitted on ``train``: exact with linear interpolation, or values of nearly
    that rank from one pass of mergeable sketches."""
    spec = {c: {c: 0.5} for c in cols}
    return multi_column_quantiles(train, spec) if exact else approximate_quantiles(train, spec, rank_error)


def _long_format(df: DataFrame, cols: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(pairs))


def categorical_modes(train: DataFrame, cols: list[str]) -> DataFrame:
    """Rows (feature, mode): most frequent non-null value per column, smallest value on ties.

    One shuffle for all columns: values are counted per (feature, value) with
    partial aggregation, then each feature keeps the best (count, value) pair
    — no per-column hash map of all distinct values in one task.
    """
    counts = (_long_format(train, cols).where(F.col("value").isNotNull())
              .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    best = F.min_by(F.col("value"), F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("v")))
    return counts.groupBy("feature").agg(best.alias("mode"))


def onehot_category_sizes(train: DataFrame, cols: list[str], modes: DataFrame | None = None) -> DataFrame:
    """Rows (feature, n_categories): one-hot width per column after mode imputation."""
    longf = _long_format(train, cols)
    if modes is not None:
        longf = (longf.join(F.broadcast(modes), "feature", "left")  # ≤ #columns rows
                      .select("feature", F.coalesce("value", "mode").alias("value")))
    return (longf.where(F.col("value").isNotNull()).groupBy("feature")
                 .agg(F.count_distinct("value").alias("n_categories")))


def class_weights(train: DataFrame, target: str = LABEL) -> DataFrame:
    """Balanced weights n / (k · n_c) per class (k = number of classes)."""
    cls = train.groupBy(target).agg(F.count(F.lit(1)).alias("n_c"))
    tot = cls.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    return (cls.crossJoin(F.broadcast(tot))  # 1 row
               .select(target, F.col("n_c").cast("long").alias("n_c"),
                       (F.col("n").cast("double") / (F.col("k") * F.col("n_c")).cast("double")).alias("weight")))


def impute(df: DataFrame, medians: DataFrame, modes: DataFrame | None = None,
           categorical: list[str] | None = None) -> DataFrame:
    """Fill NULL numerics with the fitted medians and NULL categoricals with the fitted modes."""
    med_cols = medians.columns
    out = df.crossJoin(F.broadcast(medians.select(*[F.col(c).alias(f"_med_{c}") for c in med_cols])))
    for c in med_cols:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")))
    out = out.drop(*[f"_med_{c}" for c in med_cols])
    if modes is not None:
        # ≤ one row per input column; explicit pivot values avoid a distinct job
        values = categorical if categorical is not None else [r["feature"] for r in modes.select("feature").collect()]
        wide = modes.groupBy().pivot("feature", values).agg(F.first("mode"))
        wcols = wide.columns
        out = out.crossJoin(F.broadcast(wide.select(*[F.col(c).alias(f"_mode_{c}") for c in wcols])))
        for c in wcols:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.col(f"_mode_{c}")))
        out = out.drop(*[f"_mode_{c}" for c in wcols])
    return out


__all__ = ["feature_projection", "split_feature_types", "numeric_medians", "categorical_modes",
           "onehot_category_sizes", "class_weights", "impute"]
