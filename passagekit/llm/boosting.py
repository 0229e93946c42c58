"""Gradient-boosted trees for small tables: logistic loss, depth-limited trees on binned features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary classifier. fit() is deterministic; score() returns log-odds."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
        self.prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f = np.full(len(y), self.prior)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), int)
            size = (1 << self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            for at in range(size):
                rows = np.flatnonzero(node == at)
                g, h = grad[rows].sum(), hess[rows].sum()
                value[at] = self.rate * g / (h + self.ridge)
                if at >= size // 2 or len(rows) < 8:
                    continue
                best = (1e-6, -1, 0)
                for j, e in enumerate(edges):
                    if len(e):
                        left_g = np.cumsum(np.bincount(binned[rows, j], grad[rows], len(e) + 1))[:-1]
                        left_h = np.cumsum(np.bincount(binned[rows, j], hess[rows], len(e) + 1))[:-1]
                        gain = left_g**2 / (left_h + self.ridge) + (g - left_g) ** 2 / (h - left_h + self.ridge) - g * g / (h + self.ridge)
                        k = int(np.argmax(gain))
                        if gain[k] > best[0] + 1e-12:
                            best = (float(gain[k]), j, k)
                if best[1] >= 0:
                    feature[at], cut[at] = best[1], edges[best[1]][best[2]]
                    node[rows] = np.where(binned[rows, best[1]] <= best[2], 2 * at + 1, 2 * at + 2)
            f += value[node]
            self.trees.append((feature, cut, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                j = feature[node]
                inner = j >= 0
                down = 2 * node + np.where(x[np.arange(len(x)), np.maximum(j, 0)] <= cut[node], 1, 2)
                node = np.where(inner, down, node)
            out += value[node]
        return out


def calibrate(score: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(a, b): the chance is 1 / (1 + exp(-(a * score + b))), by Newton steps on held-out rows. Of n rows of a kind one
    more counts as of the other, so that scores which part the kinds cleanly give no chances of 0 and 1."""
    a, b = 1.0, 0.0
    ones = y.sum()
    y = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        w, e = p * (1 - p) + 1e-9, y - p
        h = np.array([[(w * score * score).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(e * score).sum(), e.sum()]))
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)
