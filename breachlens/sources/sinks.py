"""Export scored incidents (CSV with header or parquet), sorted by score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from breachlens.operators.decide import ranked_incidents
from breachlens.sources.event_log import CSV_OPTIONS


def export_scored(scored: DataFrame, path: str, fmt: str = "csv") -> str:
    """Write every scored incident, highest probability first (range-partitioned sort)."""
    writer = ranked_incidents(scored).write.mode("overwrite")
    if fmt == "csv":
        writer.options(**CSV_OPTIONS).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def read_exported(spark: SparkSession, path: str, schema, fmt: str = "csv") -> DataFrame:
    if fmt == "csv":
        return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)
    return spark.read.format(fmt).load(path)


__all__ = ["export_scored", "read_exported"]
