"""Gradient-boosted trees with monotonic constraints, fitted in numpy and flattened into node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All nodes of all trees side by side. A leaf has feature -1; a row goes left if its value is below the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: every tree steps down all rows at once."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                down = np.where(x[rows, np.maximum(f, 0)] < self.threshold[at], self.left[at], self.right[at])
                at = np.where(f < 0, at, down)
            total += self.value[at]
        return total


def _best_split(gh: np.ndarray, monotone: np.ndarray, low: float, high: float, l2: float, least: float):
    """gh[feature, bin, (g, h)] -> gain, feature, bin (left holds the bins before it), left and right values."""
    left = gh.cumsum(1)[:, :-1]
    right = gh.sum(1, keepdims=True) - left
    value = [np.clip(-s[..., 0] / (s[..., 1] + l2), low, high) for s in (left, right)]
    gain = sum(-(s[..., 0] * v + 0.5 * (s[..., 1] + l2) * v * v) for s, v in zip((left, right), value))
    bad = (left[..., 1] < least) | (right[..., 1] < least) | (monotone[:, None] * (value[1] - value[0]) < 0)
    gain = np.where(bad, -np.inf, gain)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return gain[f, b], int(f), int(b) + 1, value[0][f, b], value[1][f, b]


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Forest:
    """Logistic loss. monotone: 1, -1 or 0 for each feature: the score may only rise, only fall, or do either with it.

    A split whose two values break the constraint is not made, and the values below it stay on their side of
    the middle between the two, so the constraint holds for the whole tree and for their sum.
    """
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T)], 1)
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base, signs = float(np.log(p / (1 - p))), np.asarray(monotone)
    score, nodes, roots = np.full(len(y), base), [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = q - y, q * (1 - q)

        def whole(rows, low, high):
            return float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))

        root = len(nodes)
        roots.append(root)
        nodes.append([-1, 0.0, 0, 0, 0.0])
        todo = [(root, np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, low, high = todo.pop()
            value, best = whole(rows, low, high), None
            if level < depth and len(rows) > 1:
                gh = np.stack([np.stack([np.bincount(code[rows, f], w[rows], bins) for w in (g, h)], 1) for f in range(x.shape[1])])
                gain, f, b, lv, rv = _best_split(gh, signs, low, high, l2, least)
                alone = -(g[rows].sum() * value + 0.5 * (h[rows].sum() + l2) * value * value)
                if gain > alone + 1e-6:
                    best = f, b, lv, rv
            if best is None:
                nodes[node][4] = rate * value
                score[rows] += rate * value
                continue
            f, b, lv, rv = best
            middle, side = (lv + rv) / 2, code[rows, f] < b
            nodes[node][:4] = [f, float(edges[f][b - 1]), len(nodes), len(nodes) + 1]
            nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
            up, down = signs[f] > 0, signs[f] < 0
            todo.append((len(nodes) - 2, rows[side], level + 1, middle if down else low, middle if up else high))
            todo.append((len(nodes) - 1, rows[~side], level + 1, middle if up else low, middle if down else high))
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes)) if nodes else (np.zeros(0, int),) * 5
    return Forest(feature.astype(np.int32), threshold.astype(float), left.astype(np.int32), right.astype(np.int32), value.astype(float), np.array(roots, np.int32), depth, base)
