"""Quality classifier from weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer.

Each heuristic votes good (1), bad (-1) or abstains (0) on a whole text. The counts of vote patterns over all documents
(at most 3^8 rows) give the labellers' accuracies by expectation-maximisation, and with them a posterior label for each
pattern. A logistic regression over hashed words, trained on the posterior labels of a bounded sample
(``SAMPLE_DOCUMENTS`` documents, each once as good and once as bad with the posterior as weight), scores every text.

Defined cases: null text is empty; a text without words has no features, only the model's intercept, and is never
kept; an empty table gives no rows; a sample with one label only (or none) gives all texts the posterior of their
pattern; equal texts get equal scores; extra columns pass through, columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachlens.llm.rows import Tables
from breachlens.llm.spans import let
from breachlens.llm.weak_labels import em

FEATURES = 1 << 14
SAMPLE_DOCUMENTS = 8000
THRESHOLD = 0.4
REGULARISATION = 0.01
RESULTS = ("quality_score", "quality_posterior", "keep")
# Frequent words of the languages served.
STOPWORDS = ("the and of to in is that for it with as was on be by la le de et les des un une est que pour dans en el los "
             "las por con una para der die das und ist nicht ein eine mit zu den von").split()


def votes(text: Column, words: Column) -> dict[str, Column]:
    """The labellers' votes on a text and its lower-cased words."""
    n, chars = F.size(words), F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / chars

    def between(x: Column, good, bad) -> Column:
        return let(x, lambda v: F.when(bad(v), -1).when(good(v), 1).otherwise(0))

    stop = F.size(F.filter(words, lambda w: w.isin(STOPWORDS))) / F.greatest(n, F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return {
        "v_length": between(n, lambda v: v >= 40, lambda v: v < 4),
        "v_symbols": between(share(r"[^\p{L}\p{N}\s]+"), lambda v: v <= 0.05, lambda v: v > 0.09),
        "v_stopwords": between(stop, lambda v: v >= 0.08, lambda v: v < 0.02),
        "v_lines": let(lines, lambda x: let(F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1)), lambda v: F.when(
            (v < 0.6) & (F.size(x) > 2), -1).when((v > 0.9) & (F.size(x) > 2), 1).otherwise(0))),
        "v_runs": between(F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]{2,}|\s[^\p{L}\p{N}\s]\s")) / F.greatest(n, F.lit(1)),
                          lambda v: v <= 0.05, lambda v: v > 0.25),
        "v_repeats": between(F.size(F.filter(words, lambda w, i: w.eqNullSafe(F.get(words, i - 1)))) / F.greatest(n, F.lit(1)),
                             lambda v: v <= 0.05, lambda v: v > 0.25),
        "v_capitals": between(share(r"\p{Lu}+"), lambda v: v <= 0.08, lambda v: v > 0.3),
        "v_distinct": let(F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1)), lambda v: F.when(
            (v < 0.2) & (n >= 12), -1).when(v > 0.4, 1).otherwise(0)),
    }


NAMES = ("v_length", "v_symbols", "v_stopwords", "v_lines", "v_runs", "v_repeats", "v_capitals", "v_distinct")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def label_model(voted: DataFrame) -> list[tuple[tuple[int, ...], int, float]]:
    """(votes, count, posterior of good) of every vote pattern."""
    rows = voted.groupBy(*NAMES).agg(F.count(F.lit(1)).alias("n")).collect()   # ≤ 3^8
    rows = sorted((tuple(r)[:-1], r["n"]) for r in rows)
    _, _, posterior = em([(v, float(n)) for v, n in rows])
    return [(v, n, p) for (v, n), p in zip(rows, posterior)]


def scored(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCUMENTS,
           threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of the documents (default: all) with ``quality_score`` (of the linear scorer),
    ``quality_posterior`` (of the label model) and ``keep``.

    Texts are read once: their votes and hashed words are written, and all that follows reads those."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession, "quality")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    body = F.coalesce(F.col("_text"), F.lit(""))
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept], F.lit(0).alias("_")).alias("_row"), docs[f"`{text}`"].alias("_text"),
                      F.xxhash64(docs[f"`{id_col}`"], docs[f"`{text}`"]).alias("_h"))
    own = own.withColumn("_words", _words(body))        # once for all that uses it
    own = own.withColumn("_votes", F.struct(*[v.cast("int").alias(k) for k, v in votes(body, F.col("_words")).items()]))
    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_words", outputCol="_features").transform(own)
    voted = tables.put(hashed.select("_row", "_h", body.rlike(r"[\p{L}\p{N}]").alias("_nonempty"), "_votes.*", "_features"))
    patterns = label_model(voted)
    total = sum(n for _, n, _ in patterns)
    code = F.lit(0)            # votes as digits to the base 3
    for name in NAMES:
        code = code * 3 + F.col(name) + 1
    codes = [0.0] * 3 ** len(NAMES)
    for v, _, p in patterns:
        at = 0
        for x in v:
            at = at * 3 + x + 1
        codes[at] = p
    posterior = F.element_at(F.split(F.lit(" ".join(f"{p:.4g}" for p in codes)), " ").cast("array<double>"), code + 1)
    voted = voted.withColumn("_posterior", posterior)
    chosen = F.pmod("_h", F.lit(1 << 30)) < min(1 << 30, (sample << 30) // max(1, total))
    twice = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("_posterior").alias("weight")),
                              F.struct(F.lit(0.0).alias("label"), (1 - F.col("_posterior")).alias("weight"))))
    train = tables.put(voted.where(chosen).orderBy("_h").limit(2 * sample).select("_features", twice.alias("y")).select(
        "_features", "y.*").where("weight > 0.001"))
    if train.select("label").distinct().count() == 2:
        model = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="weight", regParam=REGULARISATION, maxIter=25,
                                   probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred").fit(train)
        voted = model.transform(voted)
        score = vector_to_array("_p")[1]
    else:
        score = F.col("_posterior")
    voted = voted.withColumn("_score", score)
    good = F.col("_nonempty") & ((F.col("_score") + F.col("_posterior")) / 2 >= threshold)
    return voted.select(*[F.col(f"_row.`{c}`") for c in kept], F.col("_score").alias("quality_score"),
                        F.col("_posterior").alias("quality_posterior"), good.alias("keep"))


__all__ = ["scored", "label_model", "votes", "NAMES"]
