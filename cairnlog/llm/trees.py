"""Gradient-boosted regression trees for a yes or no, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete trees of one depth; a node's children follow at 2i + 1 and 2i + 2."""

    base: float
    feature: np.ndarray  # trees, inner nodes
    limit: np.ndarray  # trees, inner nodes: values above go right
    leaf: np.ndarray  # trees, leaves

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            out += leaf[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 32, depth: int = 4, rate: float = 0.25, bins: int = 32, penalty: float = 2.0) -> Boosted:
    """Fit by Newton steps on the log-loss; splits are searched over quantile bins of all features."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    inner = 2**depth - 1
    model = Boosted(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    total = np.full(len(x), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, curve = p - y, p * (1 - p)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            own = at - first
            best = np.full(count, 1e-6)
            for f in range(x.shape[1]):
                if not len(edges[f]):
                    continue
                key = own * bins + binned[:, f]
                g = np.bincount(key, slope, count * bins).reshape(count, bins).cumsum(axis=1)
                h = np.bincount(key, curve, count * bins).reshape(count, bins).cumsum(axis=1)
                gain = g**2 / (h + penalty) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + penalty) - g[:, -1:] ** 2 / (h[:, -1:] + penalty)
                cut = gain[:, : len(edges[f])].argmax(axis=1)
                value = gain[np.arange(count), cut]
                better = np.flatnonzero(value > best)
                best[better] = value[better]
                model.feature[t, first + better] = f
                model.limit[t, first + better] = edges[f][cut[better]]
            at = 2 * at + 1 + (x[np.arange(len(x)), model.feature[t, at]] > model.limit[t, at])
        g, h = np.bincount(at - inner, slope, inner + 1), np.bincount(at - inner, curve, inner + 1)
        model.leaf[t] = -rate * g / (h + penalty)
        total += model.leaf[t, at - inner]
    return model
