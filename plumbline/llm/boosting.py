"""Gradient-boosted trees for the logistic loss, small enough to become one Spark expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    """value of a leaf, or a test (feature <= cut) with two branches."""

    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> Node:
    best, cut = 1e-6, None
    if depth:
        for f in range(x.shape[1]):
            for c in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= c
                gl, hl = g[low].sum(), h[low].sum()
                gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
                if gain > best:
                    best, cut = gain, (f, float(c))
    if cut is None:
        return Node(value=float(-g.sum() / (h.sum() + ridge)))
    low = x[:, cut[0]] <= cut[1]
    return Node(0.0, cut[0], cut[1], _grow(x[low], g[low], h[low], depth - 1, ridge), _grow(x[~low], g[~low], h[~low], depth - 1, ridge))


def _apply(t: Node, x: np.ndarray) -> np.ndarray:
    if t.low is None:
        return np.full(len(x), t.value)
    return np.where(x[:, t.feature] <= t.cut, _apply(t.low, x), _apply(t.high, x))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.4, ridge: float = 1.0) -> list[Node]:
    """Trees whose sum is a log-odds; equal rows are merged by weight first, so cost follows the distinct feature rows."""
    rows, at = np.unique(np.column_stack((x, y)), axis=0, return_inverse=True)
    weight = np.bincount(at.ravel()).astype(float)
    x, y = rows[:, :-1], rows[:, -1]
    score, out = np.zeros(len(x)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        t = _grow(x, weight * (p - y), weight * p * (1 - p), depth, ridge)
        _scale(t, rate)
        out.append(t)
        score += _apply(t, x)
    return out


def _scale(t: Node, by: float) -> None:
    t.value *= by
    if t.low is not None:
        _scale(t.low, by)
        _scale(t.high, by)


def predict(trees: list[Node], x: np.ndarray) -> np.ndarray:
    return sum((_apply(t, x) for t in trees), np.zeros(len(x)))


def walk_sql(trees: list[Node], f: str) -> str:
    """The trees' sum as a SQL expression over f, an array<double> of the features: a walk over constant arrays of the nodes' features, cuts and branches.

    Its size in the plan is that of the arrays, however often a feature is tested. A leaf's branches lead to itself, so each walk takes as many steps.
    """
    feature, cut, low, high, value, roots, deepest = [], [], [], [], [], [], 0

    def add(t: Node, depth: int) -> int:
        nonlocal deepest
        deepest, k = max(deepest, depth), len(feature)
        for column, v in ((feature, max(0, t.feature)), (cut, t.cut), (low, k), (high, k), (value, t.value)):
            column.append(v)
        if t.low is not None:
            low[k], high[k] = add(t.low, depth + 1), add(t.high, depth + 1)
        return k

    roots += [add(t, 0) for t in trees]
    if not deepest:
        return f"{sum(value)!r}D"
    whole = lambda v: f"array({', '.join(map(str, v))})"
    real = lambda v: f"array({', '.join(f'{x!r}D' for x in map(float, v))})"
    step = f"IF({f}[{whole(feature)}[k]] <= {real(cut)}[k], {whole(low)}[k], {whole(high)}[k])"
    return f"aggregate({whole(roots)}, 0D, (a, r) -> a + {real(value)}[aggregate(sequence(1, {deepest}), r, (k, _) -> {step})])"


def calibrated_thresholds(score: np.ndarray, y: np.ndarray, group: np.ndarray, precision: float) -> dict[int, float]:
    """Per group the lowest score at which the selection reaches the given precision on these rows; infinite if none does."""
    out = {}
    for k in np.unique(group).tolist():
        s, t = score[group == k], y[group == k]
        o = np.argsort(-s, kind="stable")
        share = np.cumsum(t[o]) / np.arange(1, len(o) + 1)
        last = np.append(s[o][1:] != s[o][:-1], True)
        ok = np.flatnonzero((share >= precision) & last)
        out[int(k)] = float(s[o][ok[-1]]) if len(ok) else float("inf")
    return out
