"""The incident summary kept up batch by batch.

A ticket's partial state holds what its part of the log contributes: counts, sums,
extremes, and for first and last values the least or greatest (order, value).
States merge by the same aggregates, in any grouping and order, so any split of a
log into batches gives the summary of the whole log.

``SummaryTable`` is a folder: ``parts/batch=N`` holds the state of batch N (a
batch that is run again overwrites its own folder), ``base/version=N`` the merged
state of all batches up to N, and ``versions`` names the complete bases, so a
base whose writing failed is never read. Work per batch is in proportion to the
batch, not to the table; ``compact`` keeps the number of parts low.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from breachlens.operators.summary import MISSING_KEY_MESSAGE, hours_between, normalised_flag, order_key, placed, sla_label
from breachlens.schema import CATEGORICAL_ATTRS, KEY
from breachlens.session import path_exists, remove_path

_MERGE = {"events": F.sum, "mod_max": F.max, "mod_sum": F.sum, "mod_n": F.sum, "reassignment_max": F.max, "reopen_max": F.max,
          "opened_min": F.min, "resolved_max": F.max, "last_flag": F.max, **{f"first_{c}": F.min for c in CATEGORICAL_ATTRS}}


def partial_state(log: DataFrame, order_by: str | Sequence[str] | None = None, key: str = KEY) -> DataFrame:
    """One row per ticket of a part of the log. The order has to say where an event stands in the whole log."""
    cols = set(log.columns)
    if key not in cols:
        raise ValueError(MISSING_KEY_MESSAGE)
    attrs = [c for c in CATEGORICAL_ATTRS if c in cols]
    order = order_key(log.columns, order_by) if attrs or "made_sla" in cols else []
    aggs: list[Column] = [F.count(F.lit(1)).alias("events")]
    if "sys_mod_count" in cols:
        aggs += [F.max("sys_mod_count").alias("mod_max"), F.sum("sys_mod_count").alias("mod_sum"), F.count("sys_mod_count").alias("mod_n")]
    for source, name in (("reassignment_count", "reassignment_max"), ("reopen_count", "reopen_max"), ("resolved_at", "resolved_max")):
        if source in cols:
            aggs.append(F.max(source).alias(name))
    if "opened_at" in cols:
        aggs.append(F.min("opened_at").alias("opened_min"))
    aggs += [F.min(placed(c, order)).alias(f"first_{c}") for c in attrs]
    if "made_sla" in cols:
        aggs.append(F.max(placed("made_sla", order)).alias("last_flag"))
    return log.groupBy(key).agg(*aggs)


def merged(states: DataFrame, key: str = KEY) -> DataFrame:
    """One state per ticket from any number of them."""
    return states.groupBy(key).agg(*[_MERGE[c](c).cast(states.schema[c].dataType).alias(c) for c in states.columns if c != key])


def summary_of(state: DataFrame, key: str = KEY, drop_unlabelled: bool = True) -> DataFrame:
    """The summary's rows from one state per ticket, columns as ``incident_summary`` has them."""
    cols = set(state.columns)
    value = lambda c: F.col(f"{c}.value")
    out = [F.col(key), F.col("events").alias("total_events")]
    if "mod_n" in cols:
        out += [F.col("mod_max").alias("sys_mod_count_max"),
                F.try_divide(F.col("mod_sum").cast("double"), F.col("mod_n").cast("double")).alias("sys_mod_count_mean")]
    out += [F.col(a).alias(b) for a, b in (("reassignment_max", "reassignment_count_max"), ("reopen_max", "reopen_count_max")) if a in cols]
    out += [value(f"first_{c}").alias(c) for c in CATEGORICAL_ATTRS if f"first_{c}" in cols]
    out += [F.col(a).alias(b) for a, b in (("opened_min", "opened_at_min"), ("resolved_max", "resolved_at_max")) if a in cols]
    if "opened_min" in cols and "resolved_max" in cols:
        out.append(hours_between(F.col("opened_min"), F.col("resolved_max")).alias("resolution_hours"))
    if "last_flag" in cols:
        flag = normalised_flag(value("last_flag").cast("string"))
        out += [flag.alias("made_sla"), sla_label(flag).alias("sla_breached")]
    done = state.select(*out)
    return done.where(F.col("sla_breached").isNotNull()) if drop_unlabelled and "last_flag" in cols else done


class SummaryTable:
    """See the module. One writer at a time; readers see every batch that is complete."""

    def __init__(self, spark: SparkSession, path: str, order_by: str | Sequence[str] | None = None, key: str = KEY):
        self.spark, self.path, self.order_by, self.key = spark, path.rstrip("/"), order_by, key

    def version(self) -> int:
        """The batch up to which states are merged, -1 before the first compaction."""
        if not path_exists(self.spark, f"{self.path}/versions"):
            return -1
        return self.spark.read.schema("version long").parquet(f"{self.path}/versions").agg(F.max("version")).first()[0]

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Take in a batch; the same batch again changes nothing."""
        if batch_id > self.version():
            partial_state(batch, self.order_by, self.key).write.mode("overwrite").parquet(f"{self.path}/parts/batch={batch_id}")

    def _states(self) -> tuple[DataFrame, int]:
        """The base and the parts after it, and the last batch among them."""
        version = self.version()
        base = self.spark.read.parquet(f"{self.path}/base/version={version}") if version >= 0 else None
        if not path_exists(self.spark, f"{self.path}/parts"):
            raise ValueError(f"no batch has been applied to {self.path}")
        # without schema inference an empty folder (all parts merged and deleted) can be read as well
        reader = self.spark.read if base is None else self.spark.read.schema(T.StructType([*base.schema.fields, T.StructField("batch", T.LongType())]))
        parts = reader.parquet(f"{self.path}/parts").where(F.col("batch") > version)
        top = parts.agg(F.max("batch")).first()[0]
        states = parts.drop("batch")
        return states if base is None else base.unionByName(states), version if top is None else top

    def state(self) -> DataFrame:
        return merged(self._states()[0], self.key)

    def summary(self, drop_unlabelled: bool = True) -> DataFrame:
        return summary_of(self.state(), self.key, drop_unlabelled)

    def compact(self, vacuum: bool = False) -> int:
        """Merge all batches into a new base and return its version; with ``vacuum`` delete what it replaces."""
        states, top = self._states()
        old = self.version()
        if top > old:
            merged(states, self.key).write.mode("overwrite").parquet(f"{self.path}/base/version={top}")
            self.spark.createDataFrame([(top,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
            if vacuum:
                gone = [r["batch"] for r in self.spark.read.parquet(f"{self.path}/parts").select("batch").distinct().collect()]
                for path in [f"parts/batch={b}" for b in gone if b <= top] + ([f"base/version={old}"] if old >= 0 else []):
                    remove_path(self.spark, f"{self.path}/{path}")
        return top


def follow(events: DataFrame, table: SummaryTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep a table up with a streaming log; by default until all that is there has been read."""
    writer = events.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


__all__ = ["partial_state", "merged", "summary_of", "SummaryTable", "follow"]
