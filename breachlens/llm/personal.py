"""Personal data: weak supervision over candidate spans. DataFrame functions only; the driver sees counts of patterns.

Candidates are the matches of the fixed patterns (email, ip, card, phone) before any check, and of looser ones
(national phone numbers, social security numbers, bank account numbers, masked emails). Three labellers vote on each:
its format (digits, ranges, check digits), a gazetteer (domains, dial codes, country codes, issuer digits) and the
words before it. Expectation-maximisation over the counts of vote patterns estimates the labellers' reliabilities;
its posterior labels train a logistic span classifier over kind, votes and length. A looser candidate whose format is
right and which the classifier accepts is added; the fixed ones stay as they are.

Defined cases: null text is empty; texts without candidates have no spans; a table without candidates trains nothing
and adds nothing; repeated rows give repeated results; extra columns are ignored. Spans are in code points. Patterns
use possessive runs and start a run only at its beginning (or after the match before), so long runs take linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachlens.llm.rows import Tables
from breachlens.llm.spans import joined, matches
from breachlens.llm.weak_labels import em, logistic

_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
PATTERNS = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+.-])(?<!\+[0-9]{1,3}[\x20-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "masked_email": _LOCAL + r"\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z]{2,}",
}
KINDS = tuple(PATTERNS)
BASE = KINDS[:4]
CONTEXT = 40
# Words that stand before a kind, and gazetteers.
NEAR = {
    "email": "mail|contact|write|address", "ip": r"\bip\b|server|host|address", "card": "card|visa|master|amex|credit",
    "phone": "phone|tel|call|mobile|fax", "local_phone": "phone|tel|call|mobile|fax", "ssn": "ssn|social|security",
    "iban": "iban|account|bank|konto", "masked_email": "mail|contact|write|address",
}
DOMAINS = "com|org|net|edu|gov|int|info|biz|io|de|fr|es|it|nl|uk|eu|ch|at|be|pt|pl|se|us|ca|au|jp|cn|in|br|mx|ar|ru"
DIAL_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|60|61|62|63|64|65|66|81|82|84|86|90|91|92|351|353|358|420"
COUNTRIES = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|TR"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def luhn(digits: Column) -> Column:
    """Check digit of a digit string (of at most 19 digits): every second digit from the right is doubled."""
    def weight(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + weight(i)) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def well_formed(kind: str, value: Column) -> Column:
    """The format check of a kind; for the fixed kinds, the one that a match must pass."""
    n = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": F.when((n >= 12) & (n <= 19), luhn(_digits(value))).otherwise(F.lit(False)),
        "phone": (n >= 9) & (n <= 15),
        "local_phone": value.rlike(r"^\(?[2-9]"),
        "ssn": ~value.rlike(r"^(?:000|666|9)|-00-|-0000$"),
        "iban": F.length(F.regexp_replace(value, " ", "")).between(15, 34) & value.rlike("[0-9]{6}|[0-9]{4} [0-9]{4}"),
        "masked_email": F.lit(True),
    }[kind]


def listed(kind: str, value: Column) -> Column:
    """The gazetteer's vote: 1, -1, or 0 where it knows nothing."""
    yes = {"email": value.rlike(rf"(?i)\.(?:{DOMAINS})$"), "masked_email": value.rlike(rf"(?i)(?:{DOMAINS})$"),
           "card": value.rlike("^[3-6]"), "phone": value.rlike(rf"^\+(?:{DIAL_CODES})(?![0-9]*[A-Za-z])"),
           "iban": value.rlike(f"^(?:{COUNTRIES})"), "ip": ~value.rlike(r"^0*(?:0|127|255)\.")}.get(kind)
    if yes is None:
        return F.lit(0)
    return F.when(yes, 1).otherwise(0 if kind in ("email", "masked_email") else -1)


def candidates(text: Column, kind: str) -> Column:
    """Array of (start, order, kind, end, format, gazetteer, context, long) for all candidates of one kind."""
    return F.transform(matches(text, PATTERNS[kind], context=CONTEXT), lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"), m["end"].alias("end"),
        F.when(well_formed(kind, m["value"]), 1).otherwise(-1).alias("format"), listed(kind, m["value"]).alias("gazetteer"),
        F.when(m["before"].rlike(f"(?i){NEAR[kind]}"), 1).otherwise(0).alias("context"),
        (F.length(m["value"]) >= 12).cast("int").alias("long")))


VOTES = ("format", "gazetteer", "context")


def classifier(scan: DataFrame) -> tuple[list[float], list[float]]:
    """(reliabilities of the labellers, weights of the span classifier) from the candidates of all documents."""
    spans = scan.select(F.explode("candidates").alias("c")).select("c.order", *[f"c.{v}" for v in VOTES], "c.long")
    rows = spans.groupBy("order", *VOTES, "long").agg(F.count(F.lit(1)).alias("n")).collect()  # ≤ 8 · 3^3 · 2 rows
    rows = sorted((tuple(r) for r in rows))
    accuracy, _, posterior = em([(r[1:4], float(r[5])) for r in rows])
    features = [[1.0] + [float(r[0] == k) for k in range(len(KINDS))] + [float(x) for x in r[1:5]] for r in rows]
    weights = logistic([(x, p, float(r[5])) for x, p, r in zip(features, posterior, rows)])
    return accuracy, weights


def probability(c: Column, weights: list[float]) -> Column:
    """The classifier's probability that a candidate is personal data."""
    k = len(KINDS)
    kind = F.element_at(F.array(*[F.lit(w) for w in weights[1:k + 1]]), c["order"] + 1)
    z = F.lit(weights[0]) + kind
    for name, w in zip((*VOTES, "long"), weights[k + 1:]):
        z = z + c[name] * F.lit(w)
    return 1 / (1 + F.exp(-z))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: ``id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base`` and ``spans``
    (kind:start:end by start, comma-joined; ``spans`` with those that the classifier adds)."""
    tables = Tables(docs.sparkSession, "personal")
    body = F.coalesce(F.col("text"), F.lit(""))
    scan = tables.put(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).select(
        "id", F.concat(*[candidates(body, k) for k in KINDS]).alias("candidates")))
    _, weights = classifier(scan)
    if not weights:
        weights = [0.0] * (len(KINDS) + 5)
    right = lambda c: c["format"] == 1
    fixed = F.filter("candidates", lambda c: (c["order"] < len(BASE)) & right(c))
    added = F.filter("candidates", lambda c: (c["order"] >= len(BASE)) & right(c) & (probability(c, weights) >= threshold))
    out = scan.select("id", fixed.alias("fixed"), added.alias("added"))
    count = lambda k: F.size(F.filter("fixed", lambda c: c["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("id", *[count(k) for k in BASE], joined(F.col("fixed")).alias("base"), joined(F.concat("fixed", "added")).alias("spans"))


__all__ = ["personal_data", "candidates", "classifier", "probability", "luhn", "well_formed", "PATTERNS", "KINDS"]
