"""Document fingerprints by one-permutation MinHash with optimal densification, in DataFrame functions alone.

The 64-bit hashes of a text's five-word shingles fall into ``BINS`` bins by their top bits; a bin keeps its least
hash. An empty bin takes the value of the filled bin that comes first in the bin's own random order of all bins (the
order depends on the two bin numbers only, so two texts agree on it), and the low ``BITS`` bits of all bins are stored
as hex. Two fingerprints agree in a share e of bins; chance agreement of stored bits is taken out:
likeness = (e - 2^-BITS) / (1 - 2^-BITS), at least 0.

A document's neighbour is the next one by descending id. The rows are dealt into ranges of ids, of ``RANGE_BYTES`` of
text on average, so a task's share does not grow with the table (rows of one id are in one range); the first rows of a
range also go to the range before (the first of all to the last), where they come last, so each neighbour is found
inside its range by a window and the texts are shuffled once.

Defined cases: null text is empty; a text of fewer than five words, but not none, has one shingle of all of them; a
text without words has the empty fingerprint, whose likeness is 1 to another empty one and 0 to any other; rows with
equal ids are ordered by a hash of the text, null ids come last; a single document is its own neighbour; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breachlens.llm.spans import let

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
BITS = 8
SPACE = " \t\n\x0b\f\r"
RANGE_BYTES = 4 << 20       # of texts in a range of ids
TASK_RANGES = 4             # ranges of a task
MOST_RANGES = 1 << 16


def shingle_hashes(text: Column) -> Column:
    """Hashes of the runs of five words (repeats stay), of all words if there are fewer, none without words."""
    def hashed(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(SHINGLE))))
        return F.when(F.size(w) >= SHINGLE, runs).otherwise(F.array(F.xxhash64(w)))

    bare = F.trim(text, F.lit(SPACE))
    return F.when(bare != "", let(F.split(bare, r"[\x20\x09-\x0D]+"), hashed)).otherwise(F.array().cast("array<bigint>"))


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def _dense(least: Column) -> Column:
    """The value of every bin from the least hashes of the filled ones."""
    def value(j: Column, bins: Column) -> Column:
        borrowed = F.array_min(F.transform(least, lambda h, i: F.struct(F.xxhash64(j, bins[i]).alias("o"), h.alias("h"))))["h"]
        return let(F.array_position(bins, j), lambda at: F.when(at > 0, F.get(least, (at - 1).cast("int"))).otherwise(borrowed))

    return let(F.transform(least, _bin), lambda bins: F.transform(
        F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: value(j, bins)))


def fingerprint(text: Column) -> Column:
    """Hex of the low bits of all bins; empty for a text without words."""
    def packed(s: Column) -> Column:
        least = F.filter(s, lambda h, i: ~_bin(h).eqNullSafe(_bin(F.get(s, i - 1))))
        low = lambda h: F.lpad(F.lower(F.hex(h.bitwiseAND((1 << BITS) - 1))), BITS // 4, "0")
        return let(least, lambda x: F.array_join(F.transform(_dense(x), low), ""))

    return let(F.sort_array(shingle_hashes(text)), lambda s: F.when(F.size(s) > 0, packed(s)).otherwise(F.lit("")))


def likeness(a: Column, b: Column) -> Column:
    """Bias-corrected share of agreeing bins of two fingerprints, from 0 to 1."""
    digits = BITS // 4
    own = lambda x, i: F.substring(x, i * digits + 1, F.lit(digits))
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: own(a, i) == own(b, i))) / BINS
    chance = 2.0 ** -BITS
    estimate = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(estimate)


def with_next(docs: DataFrame, id_col: str, carried: list[str], text: str) -> DataFrame:
    """Every row with the struct ``next`` of the ``carried`` columns of its neighbour by descending id."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = int(min(MOST_RANGES, 2 + size // RANGE_BYTES))
    place = F.coalesce(F.col(id_col).cast("double"), F.lit(float("-inf")))
    ids = docs.select(F.col(id_col).alias("id"), place.alias("place"))
    cuts = ids.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    splits = [float("-inf"), *sorted({c for c in cuts or [] if c != float("-inf")} or {0.0}), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="place", outputCol="range")
    # whole numbers: of doubles, a window would hash another, normalised, key than the repartitioning before it
    into = lambda df: cut.transform(df).withColumn("range", F.col("range").cast("int"))
    # one row per range, at most MOST_RANGES: its greatest id
    tops = (into(ids).groupBy("range").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("range")).collect())
    before = [(tops[i]["top"], tops[i]["top"] is None, tops[i - 1]["range"]) for i in range(len(tops))]
    ghosts = spark.createDataFrame(before, f"top {docs.schema[id_col].dataType.simpleString()}, none boolean, before int")
    own = into(docs.withColumn("place", place)).join(
        F.broadcast(ghosts), F.col(id_col).eqNullSafe(F.col("top")) & (F.col("none") == F.col(id_col).isNull()), "left")
    where = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("ghost")),
                    F.struct(F.col("before").alias("range"), F.lit(True).alias("ghost")))
    dealt = own.select(*docs.columns, F.inline(F.filter(where, lambda w: w["range"].isNotNull())))
    dealt = dealt.repartition(1 + len(tops) // TASK_RANGES, "range")       # tasks by bytes, whatever the session's number
    order = Window.partitionBy("range").orderBy(
        "ghost", F.col(id_col).isNull(), F.bitwise_not(F.col(id_col)), F.xxhash64(text))
    following = F.lead(F.struct(*carried)).over(order)
    return dealt.select(*docs.columns, "ghost", following.alias("next")).where(~F.col("ghost")).drop("ghost")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``. The edited text is the text with its last third replaced by as many characters
    (or all) from the start of its neighbour."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = with_next(own.withColumn("fingerprint", fingerprint(F.col("text"))), "id", ["text", "fingerprint"], "text")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next.text"), F.lit(1), third))
    made = own.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint",
                      F.col("next.fingerprint").alias("next_fingerprint"))
    made = made.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint",
                       fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return made.select("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


__all__ = ["fingerprint", "likeness", "fingerprints", "with_next", "shingle_hashes"]
