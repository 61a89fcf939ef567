"""Gradient-boosted trees for two classes, on histograms of the features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 80, 5, 48, 0.15, 2.0, 8.0


@dataclass
class Trees:
    """Complete trees: ``feature`` and ``limit`` by tree and inner node, ``value`` by tree and leaf."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    start: float

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        rows = np.ascontiguousarray(rows, np.float32)
        flat, width = rows.ravel(), rows.shape[1]
        first = np.arange(len(rows)) * width
        out = np.full(len(rows), self.start)
        depth = int(np.log2(self.value.shape[1]))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            at = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (flat[first + feature[at]] > limit[at])
            out += value[at - len(feature)]
        return out


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosting with Newton steps on the logistic loss; each tree is grown level by level."""
    rows = np.ascontiguousarray(rows, np.float32)
    n, width = rows.shape
    limits = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.column_stack([np.searchsorted(limits[j], rows[:, j], side="left") for j in range(width)])
    rate = labels.mean()
    start = float(np.log(rate / (1 - rate)))
    odds = np.full(n, start)
    inner = 2**depth - 1
    features, bounds, values = [], [], []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-odds))
        slope, curve = labels - chance, chance * (1 - chance)
        feature, bound = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            begin, count = 2**level - 1, 2**level
            gain_of, choice = np.full(count, 1e-6), {}
            for j in range(width):
                key = (node - begin) * BINS + binned[:, j]
                g = np.bincount(key, slope, count * BINS).reshape(count, BINS).cumsum(axis=1)
                h = np.bincount(key, curve, count * BINS).reshape(count, BINS).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
                gain[(h < LEAST / 4) | (all_h - h < LEAST / 4)] = -1
                gain[:, len(limits[j]) :] = -1
                best = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(count), best] > gain_of):
                    gain_of[k], choice[k] = gain[k, best[k]], (j, best[k])
            for k, (j, cut) in choice.items():
                feature[begin + k], bound[begin + k] = j, limits[j][cut]
            node = 2 * node + 1 + (rows[np.arange(n), feature[node]] > bound[node])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, 2**depth), np.bincount(leaf, curve, 2**depth)
        value = RATE * g / (h + RIDGE)
        odds += value[leaf]
        features.append(feature)
        bounds.append(bound)
        values.append(value)
    return Trees(np.array(features), np.array(bounds), np.array(values), start)
