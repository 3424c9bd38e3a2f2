"""Gradient-boosted trees on histograms, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Logistic boosting; every tree is grown level by level to `depth` on quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least: int = 5):
        self.rounds, self.depth, self.rate, self.l2, self.least = rounds, depth, rate, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """x: finite values (n, features); y: 0 or 1. One class only: a constant score."""
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.empty(0) for j in range(m)]
        # rare values lie beyond every quantile; zero against more is the split that they need
        self.edges = [np.unique(np.append(e, 0.0)) for e in self.edges]
        b = self._binned(x)
        p = (y.sum() + 1) / (n + 2)
        self.start = float(np.log(p / (1 - p)))
        self.trees, f = [], np.full(n, self.start)
        for _ in range(self.rounds if 0 < y.sum() < n else 0):
            q = 1 / (1 + np.exp(-f))
            tree, value = self._grow(b, q - y, q * (1 - q))
            self.trees.append(tree)
            f += value
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), int)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple, np.ndarray]:
        n, m = b.shape
        width = BINS + 2
        node = np.zeros(n, int)
        splits = []
        for level in range(self.depth):
            k = 1 << level
            feature, cut = np.zeros(k, int), np.full(k, width)
            best = np.full(k, 1e-6)
            gt, ht = np.bincount(node, g, k), np.bincount(node, h, k)
            whole = gt**2 / (ht + self.l2)
            for j in range(m):
                at = node * width + b[:, j]
                gl, hl, cl = (np.bincount(at, w, k * width).reshape(k, width).cumsum(1) for w in (g, h, None))
                gain = gl**2 / (hl + self.l2) + (gt[:, None] - gl) ** 2 / (ht[:, None] - hl + self.l2) - whole[:, None]
                gain[(cl < self.least) | (cl[:, -1:] - cl < self.least)] = -1
                c = gain.argmax(1)
                better = gain[np.arange(k), c] > best
                best[better], feature[better], cut[better] = gain[np.arange(k), c][better], j, c[better]
            splits.append((feature, cut))
            node = 2 * node + (b[np.arange(n), feature[node]] > cut[node])
        k = 1 << self.depth
        leaf = -self.rate * np.bincount(node, g, k) / (np.bincount(node, h, k) + self.l2)
        return (splits, leaf), leaf[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        for splits, leaf in self.trees:
            node = np.zeros(len(x), int)
            for feature, cut in splits:
                node = 2 * node + (b[rows, feature[node]] > cut[node])
            f += leaf[node]
        return f


class Isotonic:
    """Least-squares non-decreasing fit by pooling adjacent violators; between its points, linear."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        xs, at = np.unique(x, return_inverse=True)
        w = np.bincount(at, minlength=len(xs)).astype(float)
        v = np.bincount(at, y, len(xs)) / np.maximum(w, 1)
        pools: list[list[float]] = []  # mean, weight, first and last x
        for xi, vi, wi in zip(xs, v, w, strict=True):
            pools.append([vi, wi, xi, xi])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                b, a = pools.pop(), pools.pop()
                pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
        self.x = np.array([z for p in pools for z in (p[2], p[3])])
        self.y = np.array([z for p in pools for z in (p[0], p[0])])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y) if len(self.x) else np.full(len(x), 0.5)
