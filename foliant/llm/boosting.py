"""Gradient-boosted trees for small tables of features: histogram splits, logistic loss, and calibration on held-out rows."""

from __future__ import annotations

import numpy as np


class Boosted:
    """trees: arrays (feature, cut, value) of complete binary trees of one depth; a row goes right where its feature exceeds the cut."""

    def __init__(self, depth: int = 3, rounds: int = 40, rate: float = 0.3, l2: float = 1.0):
        self.depth, self.rounds, self.rate, self.l2 = depth, rounds, rate, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start, self.slope, self.shift = 0.0, 1.0, 0.0
        #: Thresholds by kind, where the model has them.
        self.least: dict[str, float] = {}

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape
        self.start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        z = np.full(n, self.start)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 24)))[:-1] for j in range(m)]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p) + 1e-6
            size = 2**self.depth - 1
            feature, cut = np.zeros(size, np.int64), np.full(size, np.inf)
            at = np.zeros(n, np.int64)
            for node in range(size):
                rows = np.flatnonzero(at == node)
                best = (1e-6, 0, np.inf)
                if len(rows) > 8:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for j in range(m):
                        for c in cuts[j]:
                            right = x[rows, j] > c
                            gr, hr = g[rows][right].sum(), h[rows][right].sum()
                            gain = gr**2 / (hr + self.l2) + (gs - gr) ** 2 / (hs - hr + self.l2) - gs**2 / (hs + self.l2)
                            if gain > best[0]:
                                best = (gain, j, c)
                feature[node], cut[node] = best[1], best[2]
                at[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
            leaf = at - size
            value = np.zeros(size + 1)
            np.add.at(value, leaf, -g)
            weight = np.zeros(size + 1)
            np.add.at(weight, leaf, h)
            value = self.rate * value / (weight + self.l2)
            self.trees.append((feature, cut, value))
            z += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            z += value[at - len(feature)]
        return z

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Platt scaling on rows that the trees haven't seen."""
        z = self.raw(x)
        hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
        for _ in range(400):
            p = 1 / (1 + np.exp(-(self.slope * z + self.shift)))
            d = p - np.where(y > 0, hi, lo)
            self.slope -= 0.2 * float((d * z).mean())
            self.shift -= 0.2 * float(d.mean())
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))
