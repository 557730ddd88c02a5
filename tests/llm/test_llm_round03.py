"""Bounds of languages from every row left out; strays meet their own bucket."""

import numpy as np
import pytest

from breachlens.llm import language
from breachlens.llm import order_minhash as om


def test_low_scores_are_exact_over_all_rows(spark):
    rng = np.random.default_rng(3)
    words = {"a": "abc", "b": "xyz", "c": "mno"}
    text = lambda x, n: "".join(rng.choice(list(words[x]), n)).encode()
    langs = [x for x in "abc" for _ in range(60)]
    model = language.fit([text(x, 64) for x in langs], langs)
    held = [(x, bytes(text(x, 8))) for x in "aaab" for _ in range(250)] + [("c", bytes(text("c", 8)))] * (language.LEAST_HELD - 1)
    got = {r["lang"]: r["low"] for r in language.low_scores(spark.createDataFrame(held, "lang string, text binary").repartition(5), model).collect()}
    found, score = language.best(model, np.frombuffer(b"".join(t for _, t in held), np.uint8), np.arange(len(held) + 1) * 8)
    for k, x in enumerate(model.langs):
        own = [s for (y, _), f, s in zip(held, found, score) if y == x and f == k]
        if len(own) >= language.LEAST_HELD:
            assert got[x] == pytest.approx(np.quantile(own, language.LOW), abs=1e-6)
        else:
            assert x not in got


def test_strays_meet_their_own_bucket_only(spark):
    rows = [(1, 10, 10, False), (1, 11, 10, False), (1, 12, 12, True), (2, 20, 20, False), (2, 21, 21, True), (2, 12, 12, True)]
    pairs = om._stray_pairs(spark.createDataFrame(rows, "h long, c long, root long, stray boolean")).collect()
    assert sorted((r["a"], r["b"]) for r in pairs) == [(10, 12), (11, 12), (12, 20), (12, 21), (20, 21)]
