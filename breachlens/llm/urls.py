"""URL filter: domain rules first, else logistic regression on hashed character n-grams of host and path.

Rules are (verdict, host and path prefix); a rule fits its host and all subdomains if the url's path starts with the
rule's path, and the longest fitting rule wins. What no rule fits is judged by the model: n-grams of ``NGRAMS``
characters of the host (with ``^`` and ``$`` at its ends) and of the path are hashed to ``FEATURES`` counts, host and
path apart, and a logistic regression trained from a small labelled URL table scores them. ``LABELLED`` is the default
table, made of hosts and paths by a rule; any DataFrame (url, blocked) serves.

Defined cases: null, or a url without ``://``, has empty host and path, fits no rule and is allowed; equal urls get
equal verdicts; a training table without both labels is an error; extra columns pass through, columns named like the
results are replaced.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
NGRAMS = (1, 2, 3, 4, 5)
FEATURES = 1 << 15
REGULARISATION = 0.005
THRESHOLD = 0.5

# The labelled table: hosts of unwanted kinds and ordinary ones, made of common words. None is taken from the tables that
# the filter is tried on, nor are their unwanted words. Both kinds have the same subdomains and paths, so these don't tell
# them apart; unwanted hosts also come with paths of their own.
UNWANTED = (
    "buy-viagra viagra-shop discount-meds online-pharmacy weight-loss hair-growth miracle-cure diet-tea generic-tablets "
    "royal-poker lucky-slots mega-jackpot lottery-prize roulette-bonus sports-betting blackjack-room bingo-bonus "
    "xxx-cams sex-dating porn-tube escort-girls sexy-webcam nude-pics hookup-tonight hot-singles erotic-chat "
    "payday-loan instant-cash debt-relief earn-money get-rich crypto-giveaway bitcoin-doubler forex-signals "
    "replica-watch fake-handbags luxury-replica warez-crack torrent-crack serial-keygen cracked-games "
    "popup-banner banner-click click-affiliate pop-under affiliate-traffic cpa-offers pixel-redirect "
    "seo-backlinks link-exchange buy-followers article-spinner mass-mailer doorway-pages link-wheel "
    "secure-login account-update bank-verify virus-alert driver-updater toolbar-install "
    "psychic-hotline shock-news viagrageneric pornhd pokerbonus loansnow").split()
ORDINARY = (
    "encyclopedia library harbour weather compiler garden maps university traveller museum recipes theatre science history "
    "parliament orchestra gazette brennan mentor weber anderson strand hospital railway gardening observatory school journal "
    "tribune bakery ferry lingua erwin tension thinner thorn athens nation heron ontario station mother rather another tables "
    "thanet andover erst theresa trinity inter ingrid sheraton edith anita bleriot whistler ouest henry reading eastend "
    "algebra geometry novel poetry canyon glacier pottery village kitchen cycling marathon chess botany geology biology "
    "airport tramway lighthouse castle cathedrale archive atlas almanac calendar notebook pencil furniture carpenter plumber "
    "dentist clinic nursery kinder academy seminar lecture thesis grammar dictionary translation opera ballet cinema gallery "
    "sculpture painter violin piano choir festival parade market orchard vineyard meadow forest river mountain "
    "zealand-birds city-council st-andrews open-science north-sea town-hall").split()
PATHS = ("", "en/12", "news/2021/story.html", "fr/7?page=2", "item/44#top", "de/55/", "about", "es/18.html", "article?id=987", "index.html")
UNWANTED_PATHS = ("order?aff=12", "join", "bonus", "claim", "buy-now", "click?id=1", "download.exe", "deposit", "live/cams", "redirect?sub=3")


def _labelled() -> tuple[tuple[str, int], ...]:
    rows = []
    for hosts, blocked in ((UNWANTED, 1), (ORDINARY, 0)):
        for i, host in enumerate(hosts):
            for k, sub in enumerate(("", "www.", "m.", "blog.")):
                rows.append((f"{('http', 'https')[(i + k) % 2]}://{sub}{host}.test/{PATHS[(3 * k + i) % len(PATHS)]}", blocked))
        if blocked:
            rows += [(f"http://{host}.test/{UNWANTED_PATHS[i % len(UNWANTED_PATHS)]}", 1) for i, host in enumerate(hosts)]
    return tuple(rows)


LABELLED = _labelled()      # (url, 1: block)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, pattern, 2)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES, what: int = 1) -> Column:
    """The longest fitting rule (``what`` 1) or its verdict (0); null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1])):
        own, slash, prefix = rule[1].partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + prefix)
        out = F.when(fits, F.lit(rule[what])).otherwise(out)
    return out


def _grams(s: Column) -> list[Column]:
    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(s) - (n - 1))
        return F.when(F.length(s) >= n, F.transform(starts, lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array())

    return [runs(n) for n in NGRAMS]


def _features(df: DataFrame, host: Column, path: Column) -> DataFrame:
    tagged = F.concat(*_grams(F.concat(F.lit("^"), host, F.lit("$"))),
                      *[F.transform(g, lambda x: F.concat(F.lit("/"), x)) for g in _grams(path)])
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features").transform(
        df.withColumn("_grams", tagged))


def train(labelled: DataFrame, url: str = "url", blocked: str = "blocked") -> LogisticRegressionModel:
    """A logistic regression over the hashed n-grams of labelled urls, both labels weighing the same in all.

    N-grams are not scaled by their spread, so common ones (a hyphen) carry over to hosts that the table doesn't hold."""
    own = labelled.select(F.col(url).alias("url"), F.col(blocked).cast("int").alias("blocked")).where("blocked is not null")
    n = {r["blocked"]: r["n"] for r in own.groupBy("blocked").agg(F.count(F.lit(1)).alias("n")).limit(3).collect()}
    if len(n) != 2:
        raise ValueError("the labelled urls need both labels")
    weight = F.when(F.col("blocked") == min(n), sum(n.values()) / (2 * n[min(n)])).otherwise(sum(n.values()) / (2 * n[max(n)]))
    model = LogisticRegression(featuresCol="_features", labelCol="blocked", weightCol="_weight", regParam=REGULARISATION,
                               standardization=False, maxIter=60, probabilityCol="_probability", rawPredictionCol="_raw",
                               predictionCol="_predicted")
    return model.fit(_features(own.withColumn("_weight", weight), *parts(F.col("url"))))


def default_labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELLED), "url string, blocked int")


def judged(pages: DataFrame, model: LogisticRegressionModel, url: str = "url", rules=RULES,
           threshold: float = THRESHOLD) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule``, ``block_score`` (of the model) and ``verdict``."""
    added = ("host", "path", "rule", "block_score", "verdict")
    held = [F.struct(*[F.col(c) for c in pages.columns]).alias("_row"), F.col(url).alias("_url")]
    df = pages.select(*held)
    host, path = parts(F.col("_url"))
    df = df.withColumn("_host", host).withColumn("_path", path)
    host, path = F.col("_host"), F.col("_path")
    scored = model.transform(_features(df, host, path))
    score = vector_to_array("_probability")[1]
    empty = (host == "") & (path == "")
    verdict = F.coalesce(fitting_rule(host, path, rules, 0),
                         F.when(~empty & (score >= threshold), F.lit("block")).otherwise(F.lit("allow")))
    new = {"host": host, "path": path, "rule": fitting_rule(host, path, rules), "block_score": score, "verdict": verdict}
    return scored.select(*[F.col(f"_row.`{c}`") for c in pages.columns if c not in added],
                         *[new[c].alias(c) for c in added])


__all__ = ["parts", "fitting_rule", "train", "judged", "default_labelled", "RULES", "LABELLED"]
