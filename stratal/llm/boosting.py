"""Gradient-boosted trees for two classes in numpy: histograms of quantile bins, logistic loss, complete trees of one depth."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 2.0) -> dict:
    """The trees as arrays: feature and threshold of each inner node (level order), value of each leaf."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], axis=1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    z = np.full(n, base)
    features, thresholds, leaves = [], [], []
    offsets = np.arange(k) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p) + 1e-9
        node, feature, threshold = np.zeros(n, dtype=np.int64), np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            width = 2**level
            cell = ((node * k * bins)[:, None] + offsets + binned).ravel()
            sums = [np.bincount(cell, weights=np.repeat(v, k), minlength=width * k * bins).reshape(width, k, bins) for v in (g, h)]
            left = [np.cumsum(s, axis=2) for s in sums]
            total = [s[:, :, -1:] for s in left]
            gain = left[0] ** 2 / (left[1] + 1) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + 1) - total[0] ** 2 / (total[1] + 1)
            gain[(left[1] < least) | (total[1] - left[1] < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            split = np.full(width, bins)
            for v in range(width):
                j, b = divmod(int(best[v]), bins)
                if gain[v, j, b] > 1e-6 and b < len(edges[j]):
                    feature[width - 1 + v], threshold[width - 1 + v], split[v] = j, edges[j][b], b
            node = 2 * node + (binned[np.arange(n), feature[width - 1 + node]] > split[node])
        leaf = -rate * np.bincount(node, weights=g, minlength=2**depth) / (np.bincount(node, weights=h, minlength=2**depth) + 1)
        z += leaf[node]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return {"base": base, "depth": depth, "features": np.stack(features), "thresholds": np.stack(thresholds), "leaves": np.stack(leaves)}


def logits(model: dict, x: np.ndarray) -> np.ndarray:
    z, rows = np.full(len(x), model["base"]), np.arange(len(x))
    for feature, threshold, leaf in zip(model["features"], model["thresholds"], model["leaves"], strict=True):
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(model["depth"]):
            at = 2**level - 1 + node
            node = 2 * node + (x[rows, feature[at]] > threshold[at])
        z += leaf[node]
    return z
