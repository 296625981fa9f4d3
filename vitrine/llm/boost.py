"""Gradient-boosted trees for a binary label, small enough to train on the driver and to ship to tasks."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of depth-limited trees over binned features; training is deterministic."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if x.shape[1] else np.zeros((len(x), 0), dtype=int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # cuts between neighbouring values, so that the least value is apart from the rest
        self.edges = [np.unique(np.append(c, np.unique(v)[:1] + 1e-9)) for c, v in zip(cuts, x.T, strict=True)]
        b, m = self._binned(x), x.shape[1]
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        self.base, self.nodes = float(np.log(share / (1 - share))), []
        score = np.full(len(y), self.base)
        width = max(len(e) for e in self.edges) + 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p) + 1e-12
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size, dtype=int), np.zeros(size)
            at = np.zeros(len(y), dtype=int)
            for level in range(self.depth + 1):
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(at == node)
                    if not len(rows):
                        continue
                    g, h = grad[rows].sum(), hess[rows].sum()
                    value[node] = g / (h + 1.0)
                    if level == self.depth or len(rows) < 2:
                        continue
                    flat = (b[rows] + np.arange(m) * width).ravel()
                    gs = np.bincount(flat, np.repeat(grad[rows], m), m * width).reshape(m, width).cumsum(axis=1)
                    hs = np.bincount(flat, np.repeat(hess[rows], m), m * width).reshape(m, width).cumsum(axis=1)
                    gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                    gain[(hs < self.least * 1e-3) | (h - hs < self.least * 1e-3)] = 0
                    best = int(np.argmax(gain))
                    if gain.flat[best] <= 1e-9:
                        continue
                    feature[node], cut[node] = divmod(best, width)
                    at[rows] = np.where(b[rows, feature[node]] <= cut[node], 2 * node + 1, 2 * node + 2)
            self.nodes.append((feature, cut, value * self.rate))
            score += self._walk(b, *self.nodes[-1])
        return self

    def _walk(self, b: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(b), dtype=int), np.arange(len(b))
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            right = b[rows, np.maximum(f, 0)] > cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the label."""
        out = np.full(len(x), self.base)
        if len(x):
            b = self._binned(x)
            for tree in self.nodes:
                out += self._walk(b, *tree)
        return out
