"""Gradient-boosted regression trees on binned features, for logistic loss. Fits in memory."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """``rounds`` trees of ``depth`` levels; every level of a tree is stored as arrays."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.edges: list[np.ndarray] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned, n, width = self._binned(x), *x.shape
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        flat = binned + np.arange(width) * BINS
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.full(2**self.depth, -1), np.zeros(2**self.depth, int)
            node = np.ones(n, int)
            for level in range(self.depth):
                for here in range(2**level, 2 ** (level + 1)):
                    mine = np.flatnonzero(node == here)
                    if len(mine) < 4:
                        continue
                    at = flat[mine].ravel()
                    g = np.bincount(at, np.repeat(gradient[mine], width), width * BINS).reshape(width, BINS).cumsum(axis=1)
                    h = np.bincount(at, np.repeat(weight[mine], width), width * BINS).reshape(width, BINS).cumsum(axis=1)
                    total_g, total_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + self.least) + (total_g - g) ** 2 / (total_h - h + self.least) - total_g**2 / (total_h + self.least)
                    gain[(h < 1e-3) | (total_h - h < 1e-3)] = 0
                    best = int(gain.argmax())
                    if gain.flat[best] > 1e-6:
                        feature[here], cut[here] = divmod(best, BINS)
                used = feature[node]
                node = 2 * node + ((used >= 0) & (binned[np.arange(n), np.maximum(used, 0)] > cut[node]))
            leaf = node - 2**self.depth
            size = 2**self.depth
            value = self.rate * np.bincount(leaf, gradient, size) / (np.bincount(leaf, weight, size) + self.least)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def chance(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        binned, rows = self._binned(x), np.arange(len(x))
        score = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.ones(len(x), int)
            for _ in range(self.depth):
                used = feature[node]
                node = 2 * node + ((used >= 0) & (binned[rows, np.maximum(used, 0)] > cut[node]))
            score += value[node - 2**self.depth]
        return 1 / (1 + np.exp(-score))
