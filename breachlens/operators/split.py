"""Exact, reproducible stratified train/test split.

Quotas follow scikit-learn's stratified shuffle split: ``n_test = ceil(test_size·n)``
(in floating point, as it computes it), per-class train quota by largest
remainder of ``n_c/n·n_train``, the rest of each class is test. Ties between
equal remainders go to the smaller label (scikit-learn breaks them at random).

Which rows go to test is decided by rank inside the class on
``md5(number ‖ '#' ‖ seed)``: uniform, seed-dependent and identical in any SQL
engine. The hash of the last test row of each class is found from counts by
hash prefix, and every row is tagged by a comparison with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breachlens.schema import KEY, LABEL

# Fixed value: the message users of the public job know.
TARGET_MISSING = "Target column '{target}' not found."


def split_hash(key: str, seed: int):
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"#{int(seed)}")))


def class_quotas(df: DataFrame, target: str = LABEL, test_size: float = 0.2) -> DataFrame:
    """One row per class: n_c, train quota, test quota (a tiny DataFrame)."""
    cls = df.groupBy(target).agg(F.count(F.lit(1)).alias("n_c"))
    w_all = Window.partitionBy(F.lit(1))  # over #classes rows
    n = F.sum("n_c").over(w_all)
    n_test = F.ceil(F.lit(float(test_size)) * n.cast("double"))
    q = cls.select(target, "n_c", n.alias("n"), (n - n_test).alias("n_train"))
    cont = F.col("n_c").cast("double") / F.col("n").cast("double") * F.col("n_train").cast("double")
    q = q.withColumn("_floor", F.floor(cont)).withColumn("_rem", cont - F.floor(cont))
    need = F.col("n_train") - F.sum("_floor").over(w_all)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("_rem"), F.asc(target))
    q = q.withColumn("_extra", F.when(F.row_number().over(order) <= need, 1).otherwise(0))
    train = (F.col("_floor") + F.col("_extra")).cast("long")
    return q.select(target, F.col("n_c").cast("long").alias("n_c"), train.alias("train_quota"),
                    (F.col("n_c") - train).cast("long").alias("test_quota"))


def _cutoffs(df: DataFrame, target: str, quotas: DataFrame, prefix: int = 4) -> DataFrame:
    """One row per class with a test quota above 0: the hash of the last test row.

    Rows are counted by hash prefix (at most 16^prefix counts a class); only the bucket in which the quota falls is
    ranked, so neither a shuffle nor a sort of whole rows is needed.
    """
    bucket = F.substring("_h", 1, prefix)
    hashes = df.select(target, "_h", bucket.alias("_b"))
    before = Window.partitionBy(target).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashes.groupBy(target, "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        target, "_b", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    quota = F.col("test_quota")
    at = counts.join(F.broadcast(quotas), target).where((quota > F.col("_before")) & (quota <= F.col("_before") + F.col("_n")))
    # one bucket a class
    inside = hashes.join(F.broadcast(at.select(target, "_b", (quota - F.col("_before")).alias("_rank"))), [target, "_b"])
    row = F.row_number().over(Window.partitionBy(target).orderBy("_h"))
    return inside.withColumn("_row", row).where("_row = _rank").select(target, F.col("_h").alias("_cutoff"))


def stratified_split(df: DataFrame, target: str = LABEL, test_size: float = 0.2, seed: int = 42,
                     key: str = KEY) -> DataFrame:
    """Adds ``split`` ∈ {'train','test'}; exact per-class quotas (``key`` must be unique, ``target`` a class label)."""
    if target not in df.columns:
        raise ValueError(TARGET_MISSING.format(target=target))
    hashed = df.withColumn("_h", split_hash(key, seed))
    quotas = class_quotas(df, target, test_size).select(target, "test_quota")
    out = hashed.join(F.broadcast(_cutoffs(hashed, target, quotas)), target, "left")  # ≤ #classes rows
    split = F.when(F.col("_h") <= F.col("_cutoff"), F.lit("test")).otherwise(F.lit("train"))
    return out.withColumn("split", split).drop("_h", "_cutoff")


__all__ = ["stratified_split", "class_quotas", "split_hash", "TARGET_MISSING"]
