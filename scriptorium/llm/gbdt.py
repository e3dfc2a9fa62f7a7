"""Histogram gradient-boosted trees for two classes, flattened into arrays and traversed by numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: node i has children 2i + 1 and 2i + 2; inner nodes ask feature <= threshold.

    feature, threshold: (trees, inner nodes); value: (trees, leaves). A node that was not split sends all to the left.
    """

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margins(self, x: np.ndarray, rows: int = 8192) -> np.ndarray:
        trees, inner = self.feature.shape
        depth, which = (inner + 1).bit_length() - 1, np.arange(trees)
        out = np.empty(len(x))
        for at in range(0, len(x), rows):
            part = x[at : at + rows]
            node, own = np.zeros((len(part), trees), np.int32), np.arange(len(part))[:, None]
            for _ in range(depth):
                node = 2 * node + 1 + (part[own, self.feature[which, node]] > self.threshold[which, node])
            out[at : at + rows] = self.value[which, node - inner].sum(axis=1) + self.base
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -40, 40)))


def constant(rate: float, features: int) -> Trees:
    """No tree: every row gets the same probability."""
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    return Trees(np.zeros((1, 1), np.int32), np.full((1, 1), np.inf), np.zeros((1, 2)), float(np.log(rate / (1 - rate))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on binned features. One class only, or no rows: a constant."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5, x.shape[1])
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(m) * bins
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, threshold, value = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    prior = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, prior)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            cell = ((node - first)[:, None] * (m * bins) + flat).ravel()
            sums = [np.bincount(cell, np.repeat(w, m), width * m * bins).reshape(width, m, bins).cumsum(axis=2) for w in (g, h)]
            gl, hl = sums[0][:, :, :-1], sums[1][:, :, :-1]
            gt, ht = sums[0][:, :, -1:], sums[1][:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins - 1)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, first + k], threshold[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += value[t, leaf]
    return Trees(feature, threshold, value, prior)
