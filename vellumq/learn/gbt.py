"""Gradient-boosted trees on histograms, in numpy. Models are small and are sent to the tasks as arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """A fitted model: bin edges of each feature and trees of equal depth in heap order."""

    edges: list[np.ndarray]
    feature: np.ndarray  # tree, inner node
    cut: np.ndarray  # tree, inner node: go right if bin > cut
    value: np.ndarray  # tree, leaf
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bins of the features of all rows; a missing value (NaN) is below all others."""
        out = np.empty(x.shape, np.uint8)
        for f, e in enumerate(self.edges):
            out[:, f] = np.searchsorted(e, np.nan_to_num(x[:, f], nan=-np.inf), "left")
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees for each row."""
        b = self.bins(np.asarray(x, float))
        out = np.full(len(b), self.base)
        rows = np.arange(len(b))
        depth = self.feature.shape[1].bit_length() if self.feature.size else 0
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(b), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - (1 << depth) + 1]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """For a model fitted with the logistic loss."""
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, loss: str = "squared", trees: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 48, least: int = 8, penalty: float = 1.0, weight: np.ndarray | None = None) -> Boosted:
    """Boosted trees for ``y`` by the squared or the logistic loss; deterministic."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, m = x.shape
    w = np.ones(n) if weight is None else np.asarray(weight, float)
    edges = [np.unique(np.quantile(c[np.isfinite(c)], np.linspace(0, 1, bins)[1:-1])) if np.isfinite(c).any() else np.empty(0) for c in x.T]
    mean = float((y * w).sum() / max(w.sum(), 1e-9))
    base = mean if loss == "squared" else float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    model = Boosted(edges, np.empty((0, (1 << depth) - 1), np.int64), np.empty((0, (1 << depth) - 1), np.int64), np.empty((0, 1 << depth)), base)
    b = model.bins(x).astype(np.int64)
    score = np.full(n, base)
    offset = np.arange(m) * bins
    features, cuts, values = [], [], []
    for _ in range(trees):
        if loss == "squared":
            grad, hess = (y - score) * w, w
        else:
            p = 1 / (1 + np.exp(-score))
            grad, hess = (y - p) * w, np.maximum(p * (1 - p), 1e-6) * w
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, 255)
        for level in range(depth):
            width = 1 << level
            local = node - (width - 1)
            at = (local[:, None] * (m * bins) + offset + b).ravel()
            size = width * m * bins
            g, h, c = (np.bincount(at, np.repeat(v, m), size).reshape(width, m, bins).cumsum(axis=2) for v in (grad, hess, np.ones(n)))
            gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + penalty) + (gt - g) ** 2 / (ht - h + penalty) - gt**2 / (ht + penalty)
            gain[(c < least) | (ct - c < least)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            feature[width - 1 : 2 * width - 1] = best // bins
            cut[width - 1 : 2 * width - 1] = np.where(good, best % bins, 255)
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
        leaf = node - (1 << depth) + 1
        g, h = np.bincount(leaf, grad, 1 << depth), np.bincount(leaf, hess, 1 << depth)
        value = rate * g / (h + penalty)
        score += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    model.feature, model.cut, model.value = np.array(features), np.array(cuts), np.array(values)
    return model
