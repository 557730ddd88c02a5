"""Secret scan: fixed patterns, and tokens that a character Markov model finds random. DataFrame functions only.

Two first-order Markov models over the characters of ``ALPHABET``, one of random strings, one of ordinary identifiers,
are trained from labelled samples: counts of neighbouring character pairs by label, summed on Spark (at most two times
the square of the alphabet reach the driver). Every token of ``TOKEN`` (12 characters or more) is judged by its
log-likelihood ratio alone. It is a secret if the ratio is above a bound for its length: ``SIGMAS`` deviations above the
mean that ordinary samples of that length have under the same models, and ``LEAST`` at any length. A token that lies
within a span of a fixed pattern is that span already.

``corpus_samples`` takes the labelled samples from the corpus: values that a pattern of kind assign or access found, and
the distinct words of a bounded sample of documents, in their own case and in capitals (texts hold few words in
capitals). Numbers and runs of one character, of which texts may hold none, are ordinary by ``ORDINARY``.

Defined cases: null text is empty; texts without a match have no spans; without any labelled secret the random model is
uniform; characters outside the alphabet end a token; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachlens.llm.rows import Tables
from breachlens.llm.spans import joined, labelled, let, matches

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_VALUE = 12
KINDS = ("assign", "access", "hex", "markov")
TOKEN = r"[A-Za-z0-9+/_=-]{12,}"
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{5,19}(?![A-Za-z0-9+/_=-])"
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-."
SAMPLE_DOCUMENTS = 4000      # bound on documents whose words are labelled samples
SIGMAS, LEAST = 4.5, 3.0
# Ordinary whatever the corpus: all pairs of digits, and each character repeated.
ORDINARY = tuple("".join(f"{a}{b}" for b in string.digits) * 8 for a in string.digits) + tuple(c * 24 for c in ALPHABET)


def base_matches(text: Column) -> dict[str, Column]:
    """The matches of each fixed kind (start, end, value, before)."""
    assign = F.filter(matches(text, ASSIGN, 1), lambda m: F.length(m["value"]) >= MIN_VALUE)
    return {"assign": assign, "access": matches(text, ACCESS), "hex": matches(text, HEX)}


def scanned(docs: DataFrame, id_col: str, text: str, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """id, base spans, counts, labelled values and candidate tokens of every document."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = own.count()
    chosen = F.pmod(F.xxhash64("id", "text", F.lit(11)), F.lit(1 << 30)) < min(1 << 30, (sample << 30) // max(1, n))
    found = F.struct(*[v.alias(k) for k, v in base_matches(F.col("text")).items()])
    value = lambda m: m["value"]

    def parts(f: Column) -> Column:
        spans = F.concat(*[labelled(f[k], i, k) for i, k in enumerate(KINDS[:3])])
        return F.struct(spans.alias("spans"), *[F.size(f[k]).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                        F.concat(F.transform(f["assign"], value), F.transform(f["access"], value)).alias("secrets"))

    words = F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return (own.select("id", let(found, parts).alias("found"), words.alias("words"),
                       matches(F.col("text"), TOKEN).alias("tokens"))
            .select("id", "found.*", "words", "tokens"))


def corpus_samples(scan: DataFrame) -> DataFrame:
    """Labelled samples (value, secret, n) of a scan: values of assignments and access keys, words of sampled documents
    that hold neither a long hex run nor a key, and the ordinary ones of any corpus."""
    secret = scan.select(F.explode("secrets").alias("value"), F.lit(True).alias("secret"))
    word = scan.select(F.explode(F.filter("words", lambda w: ~F.array_contains(F.col("secrets"), w))).alias("value"))
    word = word.where(~F.col("value").rlike(f"{HEX}|{ACCESS}")).select(
        F.explode(F.array("value", F.upper("value"))).alias("value"), F.lit(False).alias("secret"))
    counted = secret.union(word).groupBy("value", "secret").agg(F.count(F.lit(1)).alias("n"))
    return counted.union(scan.sparkSession.createDataFrame([(v, False, 1) for v in ORDINARY], "value string, secret boolean, n long"))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of all character pairs, row by row of the alphabet, from samples
    (value, secret, n)."""
    pairs = samples.where(F.length("value") > 1).select("secret", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring(F.col("value"), i, F.lit(2)))).alias("pair"))
    size = len(ALPHABET)
    known = F.col("pair").rlike(r"^[A-Za-z0-9+/_=.-]{2}$")
    counts = {True: [0.0] * size * size, False: [0.0] * size * size}
    for r in pairs.where(known).groupBy("secret", "pair").agg(F.sum("n").alias("n")).collect():
        a, b = (ALPHABET.index(c) for c in r["pair"])
        counts[bool(r["secret"])][a * size + b] += r["n"]

    def logs(own: list[float], weight: float, base: list[float]) -> list[float]:
        """Log of P(second | first): the counts, and ``weight`` more pairs spread by the base distribution."""
        out = []
        for a in range(size):
            row = own[a * size:(a + 1) * size]
            out += [math.log((n + weight * q) / (sum(row) + weight)) for n, q in zip(row, base)]
        return out

    seen = [1.0 + sum(counts[False][b::size]) for b in range(size)]
    ordinary = logs(counts[False], size, [n / sum(seen) for n in seen])   # rare pairs fall back to single characters
    # the base of the random model is a uniform string, and weighs more, as its samples may be of one kind
    random = logs(counts[True], 4.0 * size, [1 / size] * size)
    return [r - o for r, o in zip(random, ordinary)]


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """The sum of the pairs' log-likelihood ratios."""
    size = len(ALPHABET)
    table = F.split(F.lit(" ".join(f"{x:.5f}" for x in ratios)), " ").cast("array<double>")
    place = lambda s, i: F.instr(F.lit(ALPHABET), F.substring(s, i, F.lit(1)))
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda total, i: total + F.element_at(
        table, (place(token, i) - 1) * size + place(token, i + 1)))


def ordinary_scores(samples: DataFrame, ratios: list[float]) -> tuple[float, float]:
    """Mean of the ratio per pair of the ordinary samples, and deviation of a sample's ratio from it, per root of a pair."""
    pairs = F.length("value") - 1
    known = samples.where(~F.col("secret") & (pairs >= 4) & ~F.col("value").rlike(r"[^A-Za-z0-9+/_=.-]"))
    scored = known.select("n", pairs.alias("pairs"), log_ratio(F.col("value"), ratios).alias("score"))
    r = scored.agg(F.sum(F.col("n") * F.col("score")), F.sum(F.col("n") * F.col("pairs")), F.sum("n"),
                   F.sum(F.col("n") * F.col("score") ** 2 / F.col("pairs"))).first()
    if not r[2]:
        return 0.0, 0.0
    mean = r[0] / r[1]
    return mean, math.sqrt(max(0.0, r[3] / r[2] - 2 * mean * r[0] / r[2] + mean * mean * r[1] / r[2]))


def bound(length: Column, mean: float, deviation: float) -> Column:
    """The least ratio of a secret of this length."""
    pairs = length - 1
    return F.greatest(F.lit(LEAST), mean * pairs + SIGMAS * deviation * F.sqrt(pairs))


def secrets(docs: DataFrame, samples: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id``, ``n_assign``, ``n_access``, ``n_hex``, ``base`` and ``spans`` (kind:start:end,
    by start, comma-joined; ``spans`` with those of the Markov models). ``samples``: (value, secret, n)."""
    tables = Tables(docs.sparkSession, "secrets")
    scan = tables.put(scanned(docs, id_col, text))
    samples = tables.put(corpus_samples(scan) if samples is None else samples)
    ratios = train(samples)
    mean, deviation = ordinary_scores(samples, ratios)
    covered = lambda m: F.exists("spans", lambda s: (s["start"] <= m["start"]) & (m["end"] <= s["end"]))
    random = lambda m: log_ratio(m["value"], ratios) >= bound(F.length(m["value"]), mean, deviation)
    added = labelled(F.filter("tokens", lambda m: ~covered(m) & random(m)), 3, KINDS[3])
    return scan.select("id", "n_assign", "n_access", "n_hex", joined(F.col("spans")).alias("base"),
                       joined(F.concat("spans", added)).alias("spans"))


__all__ = ["secrets", "scanned", "train", "corpus_samples", "ordinary_scores", "bound", "log_ratio", "base_matches", "KINDS"]
