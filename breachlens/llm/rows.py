"""Row identity for operators that decide on narrow tables and then go back to whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachlens.session import shared_dir

KEY = ("row_a", "row_b")


class Tables:
    """Intermediate tables of one job: written to the shared folder and read again, so no lineage is kept."""

    def __init__(self, spark, name: str):
        self.spark, self.base, self.n = spark, shared_dir(spark, name), 0

    def put(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        self.n += 1
        df.write.parquet(path := f"{self.base}/{self.n}", compression=compression)
        return self.spark.read.parquet(path)


def row_key(df: DataFrame) -> list[Column]:
    """Two hashes (96 bits) over all columns; rows that agree in every column have the same ones."""
    parts = [df[c] for c in df.columns] + [df[c].isNull() for c in df.columns]
    return [F.xxhash64(*parts).alias("row_a"), F.hash(*parts).alias("row_b")]


def with_documents(docs: DataFrame, table: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``table`` (row_a, row_b and the columns ``extra``) as its document's columns and ``extra``.

    Documents that agree in every column are one row before the join, so repeated rows never multiply; ``extra``
    replaces document columns of the same names.
    """
    one = (docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *row_key(docs))
           .groupBy(*KEY).agg(F.first("row").alias("row")))
    out = table.select(*KEY, F.struct(F.lit(0).alias("_"), *extra).alias("extra")).join(one, list(KEY))
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in extra], *[F.col(f"extra.{c}") for c in extra])


__all__ = ["Tables", "row_key", "with_documents", "KEY"]
