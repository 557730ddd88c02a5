"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a list of slots of ``block`` words. Slot k has the golden-ratio point frac((k + 1/2) · 0.618…), which the
cumulative target shares map to a source, so every stretch of the mix has each source in nearly its share. Slots are
ranked per source, and the slot of rank r takes block r of the source: its documents are laid end to end in hashed
order, over and over (at most ``MOST_TIMES`` times), and cut into equal blocks. A source's last slot takes just the
words that are left of its target. The points deviate from the shares by a few slots; slots beyond a source's need are
left out, missing ones close the list.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share the words of all sources; a target
stops at ``MOST_TIMES`` times its source's size, and the excess is shared anew by weight.

A source of any size is spread by hash over ``buckets`` ranges, so no task holds a source; running totals within a
range use a window, those over ranges a window over at most ``buckets`` rows a source. Sources are numbered and shared
out on Spark, so there may be any number of them: the driver holds only sums, one set per round of sharing the excess.
Up to ``BROADCAST_SOURCES`` sources are broadcast to their documents, more are joined by a shuffle.

Defined cases: null or blank text has size 0 and takes 0; a source without words has target 0; repeated rows are
separate documents; an empty table gives an empty mix; the order depends on ids and texts only, so reruns agree; extra
columns are ignored, except in ``mixed``, which returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breachlens.llm.rows import KEY, Tables, row_key, with_documents

BLOCK = 1024
BUCKETS = 1024
MOST_TIMES = 3
BROADCAST_SOURCES = 100_000
MOST_CELLS = 1 << 16                               # stretches of points that are mapped to sources together
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 1 << 16                                   # slots that are ranked together
GOLDEN = 0.6180339887498949
_HIGH = (2 ** 20 * 6180339887498948482045868 % 10 ** 25) / 1e25   # frac(2^20 · GOLDEN)


def running(df: DataFrame, value: Column, name: str, by: str = "source_no") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of lower ``by`` (dense, unique numbers) as column ``name``."""
    cut = df.withColumn("_value", value).withColumn("_chunk", F.expr(f"{by} div {CHUNK}"))
    sums = cut.groupBy("_chunk").agg(F.sum("_value").alias("_sum"))
    lower = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)      # one row per CHUNK numbers
    offsets = sums.select("_chunk", F.coalesce(F.sum("_sum").over(lower), F.lit(0)).alias("_offset"))
    inside = F.sum("_value").over(Window.partitionBy("_chunk").orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    return (cut.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(offsets, "_chunk")
            .withColumn(name, F.col("_offset") + F.col("_inside")).select(*df.columns, name))


def numbered(totals: DataFrame, tables: Tables) -> DataFrame:
    """source_no, source, source_size: the sources (source, n) numbered by code point, null last."""
    by = [F.col("source").isNull(), F.col("source")]
    laid = totals.repartitionByRange(*by).sortWithinPartitions(*by)
    laid = tables.put(laid.withColumn("at", F.monotonically_increasing_id()))
    inside, part = F.expr(f"at & {(1 << 33) - 1}"), F.expr("at >> 33")
    counts = laid.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    lower = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)        # one row per partition
    offsets = counts.select("part", F.coalesce(F.sum("rows").over(lower), F.lit(0)).alias("offset"))
    return laid.withColumn("part", part).join(F.broadcast(offsets), "part").select(
        (F.col("offset") + inside).alias("source_no"), "source", F.col("n").alias("source_size"))


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source_no, source_size) with ``target`` and ``need``, the target in whole words."""
    weight, most = 1 + F.col("source_no") % 3, MOST_TIMES * F.col("source_size")
    full_at = lambda share: F.lit(share) * weight > most
    share, n_full = -1.0, -1
    while True:    # in each round the sources that the share fills leave their excess to the others
        full = full_at(share)
        r = sources.agg(F.count_if(full).alias("full"), F.sum("source_size").alias("words"),
                        F.sum(F.when(full, most)).alias("taken"), F.sum(F.when(~full, weight)).alias("weight")).first()
        if r["full"] <= n_full or not r["weight"]:
            break
        n_full, share = r["full"], ((r["words"] or 0) - (r["taken"] or 0)) / r["weight"]
    target = F.when(full_at(share), most.cast("double")).otherwise(F.lit(share) * weight)
    own = sources.withColumn("target", target)
    return own.withColumn("need", F.least(most, (F.col("target") + 0.5).cast("long")))


def schedule(spark, need: DataFrame | list[tuple[int, int]], block: int, tables: Tables | None = None) -> DataFrame:
    """slot, source_no, rank: the mix's slots for sources that need so many words each (all more than 0).

    Each step is written, so that no plan has more than a few shuffles: the driver's memory grows with its plans."""
    tables = tables or Tables(spark, "schedule")
    if not isinstance(need, DataFrame):
        need = spark.createDataFrame(need, "source_no long, need long")
    wanted = tables.put(need.select(F.col("source_no").cast("long"), "need",
                                    F.expr(f"(need + {block - 1}) div {block}").alias("slots")))
    sums = wanted.agg(F.sum("slots"), F.sum("need"), F.count(F.lit(1))).first()
    total, words, n_sources = (x or 0 for x in sums)
    cells = min(MOST_CELLS, 1 + (total + n_sources) // 4096)
    cell = lambda p: F.floor(p * cells).cast("long")
    # each slot's point gets the last source whose share starts at or before it; a share too small for a double gets none
    place = F.expr(f"((slot div {1 << 20}) * {_HIGH!r}D + (slot % {1 << 20}) * {GOLDEN!r}D + {GOLDEN / 2!r}D) % 1D")
    points = spark.range(total).withColumnRenamed("id", "slot").withColumn("point", place)
    points = points.select(cell(F.col("point")).alias("cell"), "point", F.lit(None).cast("long").alias("starts"), "slot")
    starts = running(wanted, F.col("need"), "before").select((F.col("before") / max(1, words)).alias("point"), "source_no")
    starts = tables.put(starts.where("point < 1").select(cell(F.col("point")).alias("cell"), "point", F.col("source_no").alias("starts")))
    lower = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)        # one row per cell
    carried = spark.range(cells).withColumnRenamed("id", "cell").join(
        starts.groupBy("cell").agg(F.max("starts").alias("last")), "cell", "left").select(
        "cell", F.lit(-1.0).alias("point"), F.max("last").over(lower).alias("starts"))
    none = F.lit(None).cast("long").alias("slot")
    laid = points.union(starts.select("*", none)).union(carried.select("*", none))
    upto = Window.partitionBy("cell").orderBy("point", F.col("slot").isNotNull(), "starts")
    found = F.last("starts", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    drawn = tables.put(laid.withColumn("source_no", found).where("slot IS NOT NULL").select(
        "slot", "source_no", F.expr(f"slot div {CHUNK}").alias("chunk")))
    earlier = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("source_no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    counts = tables.put(counts.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(
        wanted.select("source_no", "slots"), "source_no"))
    inside = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    ranked = tables.put(drawn.withColumn("inside", inside).join(counts, ["source_no", "chunk"])
                        .withColumn("rank", F.col("offset") + F.col("inside")).where("rank < slots").select("slot", "source_no", "rank"))
    got = tables.put(wanted.join(counts.groupBy("source_no").agg(F.sum("n").alias("n")), "source_no", "left").select(
        "source_no", "slots", F.least("slots", F.coalesce("n", F.lit(0))).alias("got")))
    short = running(got, F.col("slots") - F.col("got"), "before").where("got < slots")
    closing = short.select("source_no", "before", "got", F.expr("explode(sequence(got, slots - 1))").alias("rank")).select(
        (F.lit(total) + F.col("before") + F.col("rank") - F.col("got")).alias("slot"), "source_no", "rank")
    return ranked.union(tables.put(closing))


def mixture(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK,
            buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(documents, mix). Documents: row number ``r``, ``id``, row key, ``size``, ``source_size``, ``target``.
    Mix: ``slot``, ``r``, ``pass_no``, ``first`` (place of the first word taken) and ``words``."""
    spark = docs.sparkSession
    tables = Tables(spark, "mixing")
    size = F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(docs[id_col].alias("id"), docs[source].alias("source"), size.alias("size"),
                        F.xxhash64(docs[id_col], docs[text]).alias("h"), *row_key(docs))
    sized = tables.put(sized.withColumn("r", F.monotonically_increasing_id()))
    totals = sized.groupBy("source").agg(F.sum("size").alias("n"))
    sources = tables.put(targets(tables.put(numbered(totals, tables))))
    few = sources.count() <= BROADCAST_SOURCES
    bucket = F.pmod(F.col("h"), F.lit(buckets)).cast("int")
    rows = tables.put(sized.join(F.broadcast(sources) if few else sources, sized["source"].eqNullSafe(sources["source"])).select(
        "r", "id", *KEY, "h", "size", "source_no", "source_size", "target", "need", bucket.alias("bucket")))
    before = Window.partitionBy("source_no", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tables.put(sums.select("source_no", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")))
    laid = (rows.where("size > 0").withColumn("inside", F.coalesce(F.sum("size").over(before), F.lit(0)))
            .join(offsets, ["source_no", "bucket"]).withColumn("place", F.col("offset") + F.col("inside")))
    passes = laid.select("r", "source_no", "need", "size", "place", "source_size",
                         F.explode(F.array(*[F.lit(i) for i in range(MOST_TIMES)])).alias("pass_no"))
    start = F.col("pass_no") * F.col("source_size") + F.col("place")
    taken = passes.select("r", "source_no", "pass_no", start.alias("start"),
                          F.least(start + F.col("size"), F.col("need")).alias("end")).where("start < end")
    blocks = F.expr(f"explode(sequence(start div {block}, (end - 1) div {block}))")
    pieces = tables.put(taken.select("*", blocks.alias("rank")).select(
        "source_no", "rank", "r", "pass_no", F.greatest("start", F.col("rank") * block).alias("low"),
        F.least("end", (F.col("rank") + 1) * block).alias("high"), "start"))
    slots = schedule(spark, sources.where("need > 0").select("source_no", "need"), block, tables)
    mix = tables.put(pieces.join(slots, ["source_no", "rank"]).select(
        "slot", "r", "pass_no", (F.col("low") - F.col("start")).alias("first"), (F.col("high") - F.col("low")).alias("words")))
    return rows.select("r", "id", *KEY, "size", "source_size", "target"), mix


def taken_words(docs: DataFrame, **columns) -> DataFrame:
    """One row per document: ``id``, row key, ``size``, ``source_size``, ``target``, ``taken``."""
    rows, mix = mixture(docs, **columns)
    sums = mix.groupBy("r").agg(F.sum("words").alias("taken"))
    return rows.join(sums, "r", "left").select(
        "id", *KEY, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, **columns) -> DataFrame:
    """The documents as often as the mix takes them: words taken over size, rounded; those without words stay once."""
    rows = Tables(docs.sparkSession, "mixed").put(taken_words(docs, **columns))
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    return with_documents(docs, rows.where(times > 0).select(*KEY, F.explode(F.array_repeat(F.lit(0), times)).alias("_")))


__all__ = ["targets", "schedule", "mixture", "taken_words", "mixed"]
