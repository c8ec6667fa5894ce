"""Weak supervision over counted vote patterns: expectation-maximisation and a classifier trained on its posteriors.

Both work on a table of patterns with counts that Spark has summed over all rows. Its size is bounded by the number of votes and
features (three to the power of the rules), whatever the size of the corpus, so plain Python on the driver is enough.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

#: A rule is taken to be better than chance, and never to be perfect.
LEAST, MOST = 0.55, 0.995
ROUNDS = 200


@dataclass(frozen=True)
class Reliability:
    """Of the two classes' share and each rule: how often its vote is right when the truth is 1 and when it is 0."""

    share: float
    right: tuple[tuple[float, float], ...]

    def weights(self) -> tuple[float, list[tuple[float, float]]]:
        """Log odds of the share, and for each rule those that a vote of 1 and a vote of -1 add."""
        return math.log(self.share / (1 - self.share)), [(math.log(one / (1 - zero)), math.log((1 - one) / zero)) for one, zero in self.right]

    def posterior(self, votes: Sequence[int]) -> float:
        start, each = self.weights()
        return sigmoid(start + sum((up if v > 0 else down) for v, (up, down) in zip(votes, each, strict=True) if v))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def clamp(x: float, low: float, high: float) -> float:
    return min(high, max(low, x))


def estimate(patterns: Sequence[tuple[Sequence[int], int]], n_rules: int, share: float = 0.8, start: Sequence[float] | None = None, hold: float = 0.0) -> Reliability:
    """EM for votes 1, -1 and 0 (abstains) with their counts, started from rules that are right nine times in ten, or as start says; hold is the weight of
    the start beside the votes, for rules that seldom meet. Without rows: the start."""
    start = start or (0.9,) * n_rules
    now = Reliability(share, tuple((x, x) for x in start))
    total = sum(n for _, n in patterns)
    if not total:
        return now
    for _ in range(ROUNDS):
        truth = [(v, n, now.posterior(v)) for v, n in patterns]
        right = []
        for r in range(n_rules):
            # Ten invented votes or more, as right as at the start: a rule that hardly votes stays near it.
            invented = 10.0 + hold * sum(n for v, n, _ in truth if v[r])
            one, zero = [invented * start[r], invented], [invented * start[r], invented]
            for v, n, p in truth:
                if v[r]:
                    one[0] += n * p * (v[r] > 0)
                    one[1] += n * p
                    zero[0] += n * (1 - p) * (v[r] < 0)
                    zero[1] += n * (1 - p)
            right.append((clamp(one[0] / one[1], LEAST, MOST), clamp(zero[0] / zero[1], LEAST, MOST)))
        after = Reliability(clamp((sum(n * p for _, n, p in truth) + hold * total * share) / (total * (1 + hold)), 0.05, 0.95), tuple(right))
        moved = max(abs(after.share - now.share), *(abs(a - b) for x, y in zip(after.right, now.right, strict=True) for a, b in zip(x, y, strict=True)))
        now = after
        if moved < 1e-7:
            break
    return now


def train(rows: Sequence[tuple[Sequence[float], float, float]], ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton's steps on (features, wanted probability, count); the first weight is the constant."""
    k = len(rows[0][0]) + 1 if rows else 1
    w = [0.0] * k
    for _ in range(30):
        slope, curve = [-ridge * x for x in w], [[ridge * (i == j) for j in range(k)] for i in range(k)]
        for x, want, n in rows:
            x = (1.0, *x)
            p = sigmoid(sum(a * b for a, b in zip(w, x, strict=True)))
            for i in range(k):
                if x[i]:
                    slope[i] += n * (want - p) * x[i]
                    for j in range(k):
                        curve[i][j] += n * p * (1 - p) * x[i] * x[j]
        step = solve(curve, slope)
        w = [a + b for a, b in zip(w, step, strict=True)]
        if max(map(abs, step)) < 1e-9:
            break
    return w


def solve(a: list[list[float]], b: list[float]) -> list[float]:
    """x with a x = b, by elimination with the largest pivot; a is positive definite."""
    rows = [[*r, y] for r, y in zip(a, b, strict=True)]
    n = len(rows)
    for i in range(n):
        top = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[top] = rows[top], rows[i]
        for r in range(i + 1, n):
            f = rows[r][i] / rows[i][i]
            rows[r] = [x - f * y for x, y in zip(rows[r], rows[i], strict=True)]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (rows[i][n] - sum(rows[i][j] * x[j] for j in range(i + 1, n))) / rows[i][i]
    return x
