"""Sharding by sampled splitters: shards of nearly equal bytes, each a range of keys.

The key orders rows by a hash of the text, then of the id: equal texts are neighbours, and a large group of them can
still be cut. A size-weighted sample of keys (about ``SAMPLE`` rows, each drawn with a chance in proportion to its
size) gives quantile boundaries of ``RANGES`` ranges per shard. Exact bytes and rows of every range follow; a range of
more than twice the mean is subdivided by a hash of the row number, which also cuts rows that repeat one key. Running
totals inside ranges and over the bounded list of ranges give every row its place on the line of all bytes, and equal
lengths of that line are the shards, so a shard differs from the mean by less than a row.

Defined cases: null text has no bytes (size 8); repeated rows are separate records; equal keys are ordered by row
number; fewer rows than shards leave shards empty; an empty table gives no rows; extra columns are ignored, except in
``sharded``, which returns them (columns named ``shard`` or ``slot`` are replaced).
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breachlens.llm.rows import KEY, Tables, row_key, with_documents

SHARDS = 24
RANGES = 64            # ranges per shard
SAMPLE = 16            # sampled keys per range
LOW_BITS = 20          # of the key, from the id


def _splitters(rows: DataFrame, total: int, ranges: int) -> list[float]:
    """Quantile boundaries of a size-weighted sample of keys, ascending, without repeats."""
    chance = F.col("size") * (ranges * SAMPLE / max(1, total))
    draw = F.pmod(F.xxhash64("r", F.lit(5)), F.lit(1 << 30)) / (1 << 30)
    drawn = rows.select("key", F.floor(chance + draw).cast("int").alias("n")).where("n > 0").collect()
    keys = sorted(float(r["key"]) for r in drawn for _ in range(r["n"]))
    cuts = {keys[len(keys) * i // ranges] for i in range(1, ranges)} if keys else set()
    return [float("-inf"), *sorted(cuts or {0.0}), float("inf")]


def placed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS,
           ranges: int = RANGES) -> DataFrame:
    """One row per record: ``id``, row key, ``size``, ``text_crc32``, ``shard``, ``slot`` (0, 1, … in its shard)."""
    tables = Tables(docs.sparkSession, "sharding")
    n_ranges = shards * ranges
    high = F.shiftleft(F.xxhash64(docs[text]).bitwiseAND((1 << (63 - LOW_BITS)) - 1), LOW_BITS)
    low = F.xxhash64(docs[id_col]).bitwiseAND((1 << LOW_BITS) - 1)
    rows = tables.put(docs.select(
        docs[id_col].alias("id"), *row_key(docs), high.bitwiseOR(low).alias("key"),
        (F.coalesce(F.octet_length(docs[text]), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(docs[text], F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("r")))
    whole = rows.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).first()
    total, n = whole["size"] or 0, whole["n"]
    ranged = Bucketizer(splits=_splitters(rows, total, n_ranges), inputCol="place", outputCol="range").transform(
        rows.withColumn("place", F.col("key").cast("double"))).withColumn("range", F.col("range").cast("int"))
    load = F.greatest(F.sum("size") / max(1, total), F.count(F.lit(1)) / max(1, n)) * n_ranges
    parts = ranged.groupBy("range").agg(F.when(load > 2, F.ceil(load)).otherwise(1).cast("int").alias("parts"))
    part = F.when(F.col("parts") == 1, 0).otherwise(F.pmod(F.xxhash64("r", F.lit(3)), F.col("parts"))).cast("int")
    divided = tables.put(ranged.join(F.broadcast(parts), "range").select(*rows.columns, "range", part.alias("part")))
    # at most 3 · n_ranges rows: a range of load l has ceil(l) parts, and all loads together are at most 2 · n_ranges
    sums = divided.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before")
                                             for c in ("bytes", "n")])
    inside = Window.partitionBy("range", "part").orderBy("key", "r")
    lined = (divided.withColumn("own_bytes", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("own_n", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["range", "part"]))
    start = F.col("bytes_before") + F.col("own_bytes") - F.col("size")
    lined = tables.put(lined.select(
        "id", *KEY, "size", "text_crc32", (F.col("n_before") + F.col("own_n")).alias("line"),
        F.floor(start * shards / max(1, total)).cast("int").alias("shard")))
    first = lined.groupBy("shard").agg(F.min("line").alias("first"))
    return lined.join(F.broadcast(first), "shard").select(
        "id", *KEY, "size", "text_crc32", "shard", (F.col("line") - F.col("first")).cast("long").alias("slot"))


def sharded(docs: DataFrame, **columns) -> DataFrame:
    """The documents with their ``shard`` and ``slot``."""
    return with_documents(docs, placed(docs, **columns), ("shard", "slot"))


__all__ = ["placed", "sharded", "SHARDS"]
