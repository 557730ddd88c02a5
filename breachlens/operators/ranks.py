"""Distributed prefix sums and exact quantiles as one lazy plan, without a global single-partition window.

A ``Window.orderBy(...)`` without ``partitionBy`` moves every row into one task.
The helpers here use the two-level form instead:

1. collapse to distinct values (partial aggregation absorbs hot values);
2. put each value into a bucket by a fixed monotone function of the value
   (``order_bucket``: a logarithmic scale, at most ``2·MAX_BUCKET + 1`` buckets);
3. prefix-sum the per-bucket totals (bounded by the number of buckets);
4. prefix-sum inside buckets with a window partitioned by bucket.

Buckets only affect balance, never the result, so the answer is exact. Nothing
runs while the plan is built: no counts, boundary jobs or checkpoints.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_OCTAVE = 1024
MAX_BUCKET = 1 << 20
NAN_SCORE = "A score is NaN."
_BUCKET = "_rank_bucket"


def order_bucket(value: Column, per_octave: int = BUCKETS_PER_OCTAVE) -> Column:
    """A bucket number that never falls when the value grows: sign(v) · ⌊per_octave · log2(1 + |v|)⌋, bounded."""
    v = value.cast("double")
    size = F.least(F.floor(F.lit(float(per_octave)) * F.log2(F.lit(1.0) + F.abs(v))), F.lit(MAX_BUCKET))
    return (F.signum(v) * size).cast("int")


def no_nan(value: Column) -> Column:
    """The value; the job fails on NaN (a NaN score has no place in any order)."""
    return F.when(F.isnan(value.cast("double")), F.raise_error(F.lit(NAN_SCORE)).cast("double")).otherwise(value)


def value_prefix_sums(df: DataFrame, value_col: str, sums: Mapping[str, Column],
                      per_octave: int = BUCKETS_PER_OCTAVE) -> DataFrame:
    """Distinct non-null ``value_col`` values with per-value sums and exclusive prefix sums.

    Output columns: ``value_col``, each ``name`` in ``sums`` (sum over rows with
    that value) and ``name_before`` (sum over rows with a strictly smaller value).
    ``value_col`` must be numeric; NaN fails the job.
    """
    names = list(sums)
    checked = df.withColumn(value_col, no_nan(F.col(value_col)))
    distinct = (checked.where(F.col(value_col).isNotNull()).groupBy(value_col)
                .agg(*[F.sum(expr).cast("long").alias(n) for n, expr in sums.items()])
                .withColumn(_BUCKET, order_bucket(F.col(value_col), per_octave)))
    # ≤ 2·MAX_BUCKET + 1 rows: a single-partition window here is bounded by construction.
    per_bucket = distinct.groupBy(_BUCKET).agg(*[F.sum(n).alias(n) for n in names])
    w_all = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(_BUCKET, *[F.coalesce(F.sum(n).over(w_all), F.lit(0)).alias(f"{n}_offset") for n in names])
    w_in = Window.partitionBy(_BUCKET).orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
    inside = distinct.select("*", *[F.coalesce(F.sum(n).over(w_in), F.lit(0)).alias(f"{n}_inside") for n in names])
    return inside.join(offsets, _BUCKET).select(
        value_col, *names, *[(F.col(f"{n}_offset") + F.col(f"{n}_inside")).cast("long").alias(f"{n}_before") for n in names])


def exact_quantiles(df: DataFrame, col: str, probs: Mapping[str, float],
                    per_octave: int = BUCKETS_PER_OCTAVE) -> DataFrame:
    """One row; for each ``name → q`` the linear-interpolation quantile of ``col`` (NaN fails the job).

    Same definition as pandas ``Series.quantile`` / numpy ``linear``: position
    (n−1)·q between the two neighbouring order statistics. NULL ignored; NULL
    when the column has no values.
    """
    return multi_column_quantiles(df.withColumn(col, no_nan(F.col(col))), {col: probs}, per_octave)


def multi_column_quantiles(df: DataFrame, spec: Mapping[str, Mapping[str, float]],
                           per_octave: int = BUCKETS_PER_OCTAVE) -> DataFrame:
    """One row of exact quantiles for several columns (NULL and NaN ignored), from ONE pass over ``df``.

    All columns are unpivoted to (column, value) pairs and counted per pair in one shuffle. Bucket totals say in
    which buckets the wanted positions lie; only those buckets are ranked.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in spec])
    counted = (df.select(F.inline(pairs)).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
               .groupBy("_col", "_v").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn(_BUCKET, order_bucket(F.col("_v"), per_octave)))
    by_col = Window.partitionBy("_col")
    before = by_col.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = counted.groupBy("_col", _BUCKET).agg(F.sum("_n").alias("_in")).select(
        "_col", _BUCKET, "_in", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_offset"),
        F.sum("_in").over(by_col).alias("_total"))
    asked = {c: F.array(*[F.struct(F.lit(n).alias("_name"), F.lit(float(q)).alias("_q")) for n, q in probs.items()])
             for c, probs in spec.items()}
    choice = F.lit(None)
    for c, names in asked.items():
        choice = F.when(F.col("_col") == c, names).otherwise(choice)
    wanted = per_bucket.select("*", F.inline(choice)).withColumn("_pos", (F.col("_total") - 1) * F.col("_q"))
    lo, hi, end = F.floor("_pos"), F.ceil("_pos"), F.col("_offset") + F.col("_in")
    wanted = wanted.where(((lo >= F.col("_offset")) & (lo < end)) | ((hi >= F.col("_offset")) & (hi < end)))
    ranked = counted.join(wanted.select("_col", _BUCKET, "_offset", "_name", "_pos"), ["_col", _BUCKET])
    inside = Window.partitionBy("_col", _BUCKET, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ranked = ranked.withColumn("_start", start)
    holds = lambda p: (p >= F.col("_start")) & (p < F.col("_start") + F.col("_n"))
    picks = ranked.groupBy("_col", "_name").agg(
        F.max(F.when(holds(lo), F.col("_v"))).alias("_lo"), F.max(F.when(holds(hi), F.col("_v"))).alias("_hi"),
        F.max(F.col("_pos") - lo).alias("_frac"))
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")
    return picks.agg(*[F.max(F.when((F.col("_col") == c) & (F.col("_name") == n), value)).alias(n)
                       for c, probs in spec.items() for n in probs])


RANK_ERROR = 1e-4


def approximate_quantiles(df: DataFrame, spec: Mapping[str, Mapping[str, float]], rank_error: float = RANK_ERROR) -> DataFrame:
    """One row like ``multi_column_quantiles``, from quantile sketches that tasks merge: no value is shuffled.

    Each result is a value of the column whose rank is within ``rank_error`` · n of the wanted one; there is no
    interpolation. A sketch keeps about 1 / ``rank_error`` values a task. NULL and NaN are ignored."""
    value = lambda c: F.col(c).cast("double")
    present = lambda c: F.when(~F.isnan(value(c)), value(c))
    sketches = df.agg(*[F.percentile_approx(present(c), [float(q) for q in probs.values()], int(math.ceil(1 / rank_error))).alias(
        f"_{i}") for i, (c, probs) in enumerate(spec.items())])
    return sketches.select(*[F.col(f"_{i}")[k].alias(n) for i, probs in enumerate(spec.values()) for k, n in enumerate(probs)])


__all__ = ["value_prefix_sums", "approximate_quantiles", "RANK_ERROR", "exact_quantiles", "multi_column_quantiles", "order_bucket", "no_nan", "NAN_SCORE"]
