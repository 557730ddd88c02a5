"""Language identification by a bidirectional gated recurrent network over the bytes of a text.

Every byte position gets a language distribution from the states of a forward and a backward recurrence; the
document's distribution is the mean over all its positions. Texts are cut into stretches of ``STRETCH`` bytes that
start from a zero state, as in training, so the work per byte is constant and a whole batch of stretches steps
together in numpy. Gates use the piecewise linear sigmoid and the candidate state the softsign, which numpy
evaluates fast.

Training runs on the driver over a bounded sample: about ``per_lang`` documents of each language, a window of
``WINDOW_CHARS`` characters at a hashed place in each. Backpropagation through time and Adam, fixed seeds, so the same
rows give the same model. Only text and label are used. The output layer grows with the labels; beyond 250 of them the
sample per language shrinks to ``MOST_SAMPLE`` rows in all, but every label keeps one, and steps are added so that each
language is seen as often as with 320. Work per byte grows with the number of languages, memory does not. The driver
holds the sample. The ``MAX_LANGS`` labels with the most rows are learned (twice the number of living languages): that is
a bound of the fit, as the sample is; every document gets a prediction.

A document is accepted if its score reaches the bound of its predicted language, which lies ``MIN_SCORE`` of the way
from chance (one over the number of languages) to the ``LOW`` quantile of the scores of texts that training did not see
and the model got right: the first ``SHORT`` bytes of a window of every such labelled row, as short texts score lowest. A
language with fewer than ``LEAST_HELD`` of those has no bound.

Defined cases: null text or text without a letter gives ``und`` with score 0; without any labelled text every
prediction is ``und``, and every document with a letter is accepted; rows with null labels are not trained on; repeated
rows get equal predictions; extra columns pass through, columns named like the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breachlens.llm.arrow_text import add_columns, pieces, utf8
from breachlens.session import written

STATES = 8
STRETCH = 64
WINDOW_CHARS = 192
PER_LANG = 400
MAX_LANGS = 1 << 14
MOST_SAMPLE = 100_000  # rows trained on
CELLS = 1 << 24        # probabilities that are held at a time
MIN_SCORE = 0.3        # how far from chance to a language's low scores a document must come
LOW = 0.01
SHORT = 8
LEAST_HELD = 10
BUCKETS = 1024         # of scores, when a quantile is looked for
LEAST_SPLIT = 50       # languages with fewer labelled rows hold none out
BLOCK = 4096           # stretches that step together
PAD = 256              # the symbol after the end of a text: it keeps the state
PIECE_BYTES = 2 << 20
UNDETERMINED = "und"
HAS_LETTER = r"\p{L}"


@dataclass
class Model:
    langs: list[str]
    inputs: np.ndarray      # 2 directions × 3·STATES gate inputs × 257 symbols
    recurrent: np.ndarray   # 2 × 3·STATES × STATES
    output: np.ndarray      # languages × 2·STATES
    bias: np.ndarray        # languages
    low: np.ndarray | None = None   # languages: the low quantile of held-out scores, nan where unknown


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of the stretches of every text."""
    size = np.diff(offsets)
    count = -(-size // STRETCH)
    text = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[text] + k * STRETCH
    return start, np.minimum(STRETCH, offsets[text + 1] - start), text


def symbols(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Symbols by step (rows) and stretch (columns), padded."""
    step = np.arange(STRETCH)[:, None]
    at = np.minimum(start[None, :] + step, len(data) - 1)
    return np.where(step < length[None, :], data[at].astype(np.intp), PAD)


def _steps(direction: int):
    return range(STRETCH) if direction == 0 else range(STRETCH - 1, -1, -1)


def states(m: Model, x: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States after every step: steps × 2·STATES × stretches. ``trace`` gets what the backward pass needs."""
    n, h2 = x.shape[1], 2 * STATES
    out = np.empty((STRETCH, h2, n), np.float32)
    for d in range(2):
        h = np.zeros((STATES, n), np.float32)
        for t in _steps(d):
            gate_in = np.take(m.inputs[d], x[t], axis=1)
            a = m.recurrent[d] @ h
            raw = gate_in[:h2]
            raw += a[:h2]
            gates = np.clip(raw, 0, 1)
            z, r = gates[:STATES], gates[STATES:]
            s = a[h2:] * r
            s += gate_in[h2:]
            scale = np.abs(s)
            scale += 1
            s /= scale
            if trace is not None:
                trace.append((d, t, h, raw, z, r, a[h2:], scale, s))
            h = h - s
            h *= z
            h += s
            out[t, d * STATES:(d + 1) * STATES] = h
    return out


def position_probabilities(m: Model, h: np.ndarray) -> np.ndarray:
    """Language probabilities of all positions: steps × languages × stretches."""
    p = np.matmul(m.output, h)
    p += m.bias[:, None]
    p -= p.max(1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(1, keepdims=True)
    return p


def pooled(m: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean language probabilities of every text (rows); zeros for an empty text."""
    start, length, text = stretches(data, offsets)
    sums = np.zeros((len(offsets) - 1, len(m.langs)))
    for lo in range(0, len(start), BLOCK):
        s, n, own = start[lo:lo + BLOCK], length[lo:lo + BLOCK], text[lo:lo + BLOCK]
        h = states(m, symbols(data, s, n))
        most = max(1, CELLS // (STRETCH * max(1, len(m.langs))))
        for a in range(0, len(s), most):
            b = a + most
            p = position_probabilities(m, h[:, :, a:b])
            p *= (np.arange(STRETCH)[:, None] < n[None, a:b])[:, None, :]
            np.add.at(sums, own[a:b], p.sum(0).T)
    return sums / np.maximum(np.diff(offsets), 1)[:, None]


def best(m: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language (number) and score of every text."""
    n, most = len(offsets) - 1, max(1, CELLS // max(1, len(m.langs)))
    found, score = np.zeros(n, int), np.zeros(n)
    for a in range(0, n, most):
        own = offsets[a:min(n, a + most) + 1]
        p = pooled(m, data[own[0]:own[-1]], own - own[0])
        found[a:a + most], score[a:a + most] = p.argmax(1), p.max(1)
    return found, score


def bounds(m: Model, min_score: float) -> np.ndarray:
    """The least accepted score of every language; 0 where nothing is known."""
    if m.low is None:
        return np.zeros(len(m.langs))
    chance = 1 / max(1, len(m.langs))
    return np.nan_to_num(chance + min_score * (m.low - chance) - 1e-6, nan=0.0)


def gradients(m: Model, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over the positions of labelled stretches, and its gradients by backpropagation through time."""
    trace: list = []
    h = states(m, x, trace)
    p = position_probabilities(m, h)
    real = (x != PAD)[:, None, :]
    total = max(1, int(real.sum()))
    loss = -float((np.log(np.maximum(p[:, label, np.arange(len(label))], 1e-9)) * real[:, 0]).sum()) / total
    p[:, label, np.arange(len(label))] -= 1
    p *= real / np.float32(total)
    d_output = np.matmul(p, h.transpose(0, 2, 1)).sum(0)
    d_state = np.matmul(m.output.T, p)
    d_inputs, d_recurrent = np.zeros_like(m.inputs), np.zeros_like(m.recurrent)
    carry = [np.zeros((STATES, x.shape[1]), np.float32)] * 2
    at: list[list] = [[], []]
    for d, t, before, raw, z, r, a, scale, s in reversed(trace):
        g = carry[d] + d_state[t, d * STATES:(d + 1) * STATES]
        slope = np.where((raw > 0) & (raw < 1), 1, np.float32(0.05))   # a little beyond the ends, so gates can return
        ds = g * (1 - z) / (scale * scale)
        back = np.concatenate([g * (before - s) * slope[:STATES], ds * a * slope[STATES:], ds * r])
        d_recurrent[d] += back @ before.T
        carry[d] = g * z + m.recurrent[d].T @ back
        back[2 * STATES:] = ds
        at[d].append((x[t], back))
    for d in range(2):
        xs, gs = np.concatenate([a for a, _ in at[d]]), np.concatenate([b for _, b in at[d]], 1)
        for j in range(3 * STATES):
            d_inputs[d, j] = np.bincount(xs, gs[j], PAD + 1)
    return loss, [d_inputs, d_recurrent, d_output, p.sum((0, 2))]


def fit(texts: list[bytes], langs: list[str], seed: int = 7, steps: int = 160, batch: int = 128,
        rate: float = 0.02) -> Model:
    """A model trained on labelled texts."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    scale = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    m = Model(names, scale(2, 3 * STATES, PAD + 1), scale(2, 3 * STATES, STATES), scale(len(names), 2 * STATES),
              np.zeros(len(names), np.float32))
    m.inputs[:, :2 * STATES] += 0.5
    m.inputs[:, :STATES, PAD] = 9
    if not texts or len(names) < 2:
        return m
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    start, length, text = stretches(data, offsets)
    number = {x: k for k, x in enumerate(names)}
    label = np.array([number[x] for x in langs])[text]
    groups = np.split(np.argsort(label, kind="stable"), np.cumsum(np.bincount(label, minlength=len(names)))[:-1])
    groups = [g for g in groups if len(g)]
    batch = max(8, min(batch, CELLS // (STRETCH * len(names))))
    steps = max(steps, 64 * len(names) // batch)
    weights = [m.inputs, m.recurrent, m.output, m.bias]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    for i in range(1, steps + 1):
        pick = np.array([g[rng.integers(len(g))] for g in (
            groups[((i - 1) * batch + j) % len(groups)] for j in range(batch))])
        _, grads = gradients(m, symbols(data, start[pick], length[pick]), label[pick])
        lr = rate * min(1, 2 * (1 - i / (steps + 1)))
        for w, g, a, b in zip(weights, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (lr * (a / (1 - 0.9 ** i)) / (np.sqrt(b / (1 - 0.99 ** i)) + 1e-6)).astype(np.float32)
        m.inputs[:, :STATES, PAD] = 9
    return m


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          per_lang: int = PER_LANG, **options) -> Model:
    """Fit on about ``per_lang`` hashed rows of each language; the low scores come from all other labelled rows."""
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(HAS_LETTER))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not counts:
        return fit([], [])
    per_lang = max(1, min(per_lang, MOST_SAMPLE // len(counts)))
    most = {name: (4 << 30) // 5 if n >= LEAST_SPLIT else 1 << 30 for name, n in counts.items()}
    shares = labelled.sparkSession.createDataFrame(
        [(name, min(most[name], max(1, (per_lang << 30) // n))) for name, n in counts.items()], "lang string, share long")
    span = F.greatest(F.length("text") - WINDOW_CHARS, F.lit(0)) + 1
    place = F.pmod(F.xxhash64("key", F.lit(2)), span).cast("int") + 1
    draw = F.pmod(F.xxhash64("key", "text", F.lit(1)), F.lit(1 << 30))
    sample = (rows.join(F.broadcast(shares), "lang").select("lang", "text", "key", draw.alias("draw"), "share")
              .where(F.col("draw") < F.col("share") * 5 / 4)
              .select("lang", F.substring(F.col("text"), place, F.lit(WINDOW_CHARS)).alias("text"),
                      (F.col("draw") >= F.col("share")).alias("held"), "draw").distinct()     # a repeated row is drawn once
              .orderBy("draw", "lang", "text").limit(5 * per_lang * len(counts)).collect())
    got = [(r["lang"], r["text"].encode()) for r in sample if not r["held"]]
    missing = [(x,) for x in counts.keys() - {x for x, _ in got}]   # no row drawn: the first one by hash
    if missing:
        own = rows.join(F.broadcast(labelled.sparkSession.createDataFrame(missing, "lang string")), "lang")
        first = own.groupBy("lang").agg(F.min(F.struct(
            draw.alias("draw"), F.substring(F.col("text"), place, F.lit(WINDOW_CHARS)).alias("text"))).alias("row"))
        got += [(r["lang"], r["row"]["text"].encode()) for r in first.collect()]
    got.sort()
    m = fit([t for _, t in got], [x for x, _ in got], **options)
    # every row that training left out, repeated ones once
    held = (rows.join(F.broadcast(shares), "lang").where(draw >= F.col("share"))
            .select("lang", F.substring(F.substring(F.col("text"), place, F.lit(WINDOW_CHARS)).cast("binary"), 1, SHORT).alias("text"),
                    F.xxhash64("key", "text").alias("row")).distinct())
    low = {r["lang"]: r["low"] for r in low_scores(held, m).collect()}         # one row per language
    m.low = np.array([low.get(x, np.nan) for x in m.langs])
    return m


def low_scores(held: DataFrame, model: Model) -> DataFrame:
    """lang, low: the exact ``LOW`` quantile of the scores of the rows (lang, text) of each language that the model gets
    right, for languages with ``LEAST_HELD`` of them. Scores are counted by bucket, only the bucket of the quantile is ranked."""
    sent = held.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        number = {x: k for k, x in enumerate(m.langs)}
        for batch in batches:
            lang, text = (batch.column(batch.schema.get_field_index(x)) for x in ("lang", "text"))
            texts = text.to_pylist()
            found, score = best(m, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
            right = np.array([number[x] for x in lang.to_pylist()], int) == found
            yield pa.RecordBatch.from_arrays([lang.filter(pa.array(right)), pa.array(score[right])], names=["lang", "score"])

    scores = (held.select("lang", "text").mapInArrow(run, "lang string, score double")
              .groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.floor(F.col("score") * BUCKETS)))
    scores = written(scores, "low-scores")
    own = Window.partitionBy("lang")
    before = own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = scores.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).select(
        "lang", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.col("n").alias("own"), F.sum("n").over(own).alias("total"))
    at = (F.col("total") - 1) * LOW
    holds = lambda p, start, n: (p >= start) & (p < start + n)
    near = lambda start, n: holds(F.floor(at), start, n) | holds(F.ceil(at), start, n)
    wanted = buckets.where((F.col("total") >= LEAST_HELD) & near(F.col("start"), F.col("own")))          # at most two a language
    inside = Window.partitionBy("lang", "bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = scores.join(F.broadcast(wanted), ["lang", "bucket"]).withColumn(
        "first", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    value = lambda p: F.max(F.when(holds(p, F.col("first"), F.col("n")), F.col("score")))
    ends = ranked.groupBy("lang").agg(value(F.floor(at)).alias("lo"), value(F.ceil(at)).alias("hi"), F.max(at - F.floor(at)).alias("part"))
    return ends.select("lang", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("low"))


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None,
             min_score: float | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) with ``lang_pred`` and ``score``, the pooled probability of that language.

    With ``min_score`` only of the accepted documents."""
    added = {"lang_pred": T.StringType(), "score": T.DoubleType()}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    flag = "_has_letter"
    while flag in docs.columns:
        flag += "_"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches):
        m = sent.value
        names = np.array([*m.langs, UNDETERMINED], object)
        for batch in pieces(batches, text, PIECE_BYTES):
            letters = batch.column(flag).to_numpy(zero_copy_only=False).astype(bool)
            if m.langs:
                found, score = best(m, *utf8(batch.column(text)))
                found, score = np.where(letters, found, len(m.langs)), np.where(letters, score, 0.0)
            else:
                found, score = np.zeros(len(letters), int), np.zeros(len(letters))
            new = {"lang_pred": pa.array(names[found], pa.string()), "score": pa.array(np.clip(score, 0, 1), pa.float64())}
            if min_score is not None:
                least = np.append(bounds(m, min_score), 0)
                chosen = pa.array(letters & (score >= least[found]))
                batch, new = batch.filter(chosen), {k: v.filter(chosen) for k, v in new.items()}
            yield batch, new

    letters = F.coalesce(F.col(text).rlike(HAS_LETTER), F.lit(False)).alias(flag)
    return add_columns(docs.select(*dict.fromkeys([*keep, text]), letters), make, added, keep)


def accepted(docs: DataFrame, model: Model, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The documents with a letter whose score reaches the bound of their predicted language, columns as they are."""
    held = {c: f"own_{c}_{i}" for i, c in enumerate(docs.columns) if c in ("lang_pred", "score")}
    kept = identify(docs.withColumnsRenamed(held), model, text, min_score=min_score).drop("lang_pred", "score")
    return kept.withColumnsRenamed({v: k for k, v in held.items()}).select(*docs.columns)


def held_out(key: Column) -> Column:
    """The fold that training never sees: crc32 of the id as text has remainder 2 modulo 4."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


__all__ = ["Model", "fit", "train", "identify", "accepted", "held_out", "UNDETERMINED"]
