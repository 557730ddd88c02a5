"""Documents to training shards: language ID, near-duplicate removal, decontamination, mixing, sharding.

Every stage takes ``(spark, docs, sf_dir)``; ``run`` writes each result as Parquet into the shared folder and reads it
again as the next one's documents, so a lost executor never costs more than the current stage. All stages but the
last return the columns of documents.

* language: documents without a letter (null and empty text too) go, and those whose score does not reach the bound of
  their language; labels come from the rows of the stage's own input that have one. Without any label, all documents
  with a letter stay.
* near_duplicates: one document of each class of near-duplicates stays, the one of least id.
* decontaminate: a document with any word of a benchmark window goes.
* mix: documents are left out or repeated so that each source's words come near its target.
* shard: every remaining row gets its ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from breachlens.llm import decontaminate, language, mixing, order_minhash, sharding
from breachlens.session import shared_dir


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.train(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.deduplicated(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]

# Trained models and sketches decide in several stages, so there is no SQL for the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
