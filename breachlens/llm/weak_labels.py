"""Expectation-maximisation over votes of overlapping labellers, from counts of vote patterns.

A vote is +1, -1 or 0 (abstains). With k labellers there are at most 3^k patterns, so the counts of any number of rows
are a bounded table, and the driver needs no rows.
"""

from __future__ import annotations

import math

# Before any row is seen, a vote of -1 speaks for a negative, and a positive seldom gets one; what +1 and 0 say is left
# to the data. The weight of these prior tables is a share of the rows, so it is the same at every size.
PRIOR = {True: {1: 0.6, 0: 0.35, -1: 0.05}, False: {1: 0.35, 0: 0.25, -1: 0.4}}
PRIOR_SHARE = 0.02


def em(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 60) -> tuple[list[float], float, list[float]]:
    """(accuracy of each labeller, share of positives, probability of positive for each pattern).

    Votes are independent given the label, with a table P(vote | label) of its own for each labeller, so one that says
    the same of both labels weighs nothing. A start that takes any vote of -1 for a sign of a negative settles which
    class is which. Without patterns: no accuracies, a share of 1/2.
    """
    total = sum(n for _, n in patterns)
    if not total:
        return [], 0.5, []
    k = len(patterns[0][0])
    posterior = [0.95 if min(v) >= 0 else 0.3 / sum(x < 0 for x in v) for v, _ in patterns]
    share, tables = 0.5, []
    for _ in range(rounds):
        share = min(0.98, max(0.02, sum(p * n for p, (_, n) in zip(posterior, patterns)) / total))
        tables = []
        for j in range(k):
            both = {}
            for label in (True, False):
                count = {v: PRIOR_SHARE * total * PRIOR[label][v] for v in (1, 0, -1)}
                for p, (votes, n) in zip(posterior, patterns):
                    count[votes[j]] += n * (p if label else 1 - p)
                both[label] = {v: c / sum(count.values()) for v, c in count.items()}
            tables.append(both)
        posterior = []
        for votes, _n in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(t[True][v] / t[False][v]) for v, t in zip(votes, tables))
            posterior.append(1 / (1 + math.exp(-max(-50.0, min(50.0, odds)))))
    accuracy = []
    for t in tables:
        right = share * t[True][1] + (1 - share) * t[False][-1]
        cast = right + share * t[True][-1] + (1 - share) * t[False][1]
        accuracy.append(right / cast)
    return accuracy, share, posterior


def logistic(rows: list[tuple[list[float], float, float]], rounds: int = 300, rate: float = 1.0,
             penalty: float = 1e-3) -> list[float]:
    """Weights of a logistic regression over (features, probability of the label, count) rows."""
    size = len(rows[0][0]) if rows else 0
    total = sum(n for _, _, n in rows) or 1.0
    w, g2 = [0.0] * size, [1e-8] * size
    for _ in range(rounds):
        grad = [penalty * x for x in w]
        for x, y, n in rows:
            z = sum(a * b for a, b in zip(w, x))
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))
            for j, a in enumerate(x):
                if a:
                    grad[j] += n / total * (p - y) * a
        for j in range(size):
            g2[j] += grad[j] * grad[j]
            w[j] -= rate * grad[j] / math.sqrt(g2[j])
    return w


__all__ = ["em", "logistic"]
