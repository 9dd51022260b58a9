"""Gradient-boosted regression trees for a binary target, in numpy, on binned features."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    """Complete binary trees of one depth: feature and threshold of inner nodes, values of leaves, and the first log odds."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; splits are searched among `bins` quantiles of each feature."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(width)], 1)
    size = max(len(e) for e in edges) + 1
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score = np.full(n, base)
    feature, threshold, value = np.zeros((rounds, 2**depth - 1), np.int32), np.full((rounds, 2**depth - 1), np.inf), np.zeros((rounds, 2**depth))
    for r in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p) + 1e-9
        leaf = np.zeros(n, np.int64)
        for level in range(depth):
            many = 2**level
            gain, pick, cut = np.zeros(many), np.zeros(many, int), np.full(many, np.inf)
            for j in range(width):
                at = leaf * size + binned[:, j]
                gs = np.bincount(at, g, many * size).reshape(many, size).cumsum(1)
                hs = np.bincount(at, h, many * size).reshape(many, size).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                own = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                own = own[:, : len(edges[j])]
                if own.shape[1]:
                    best = own.argmax(1)
                    better = own[np.arange(many), best] > gain + 1e-9
                    gain[better], pick[better], cut[better] = own[np.arange(many), best][better], j, edges[j][best][better]
            feature[r, many - 1 : 2 * many - 1], threshold[r, many - 1 : 2 * many - 1] = pick, cut
            leaf = 2 * leaf + (x[np.arange(n), pick[leaf]] > cut[leaf])
        value[r] = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        score += value[r][leaf]
    return Trees(feature, threshold, value, base)


def log_odds(trees: Trees, x: np.ndarray) -> np.ndarray:
    out, rows = np.full(len(x), trees.base), np.arange(len(x))
    depth = trees.value.shape[1].bit_length() - 1
    for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, f[node]] > t[node])
        out += v[node - (2**depth - 1)]
    return out
