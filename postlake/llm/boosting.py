"""Gradient-boosted trees in numpy, for models that are fitted on a bounded sample and sent to the tasks."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary classifier: logistic loss, binned features, trees of one depth."""

    def __init__(
        self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 2.0, least: float = 3.0
    ) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.base = 0.0
        self.features = np.zeros((0, 2**depth - 1), np.int32)
        self.cuts = np.zeros((0, 2**depth - 1))
        self.leaves = np.zeros((0, 2**depth))
        self.scale, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Fit to features (n, k) and labels 0 or 1. With no row or one class, the share of ones is the model."""
        n, k = x.shape
        share = (float(y.sum()) + 0.5) / (n + 1)
        self.base = float(np.log(share / (1 - share)))
        if n == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(k)]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        margin = np.full(n, self.base)
        offsets = np.arange(k) * self.bins
        features, cuts, leaves = [], [], []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature = np.zeros(2**self.depth - 1, np.int32)
            cut = np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                width = 2**level
                key = (node[:, None] * (k * self.bins) + offsets + binned).ravel()
                size = width * k * self.bins
                gs = np.bincount(key, np.repeat(g, k), size).reshape(width, k, self.bins).cumsum(2)
                hs = np.bincount(key, np.repeat(h, k), size).reshape(width, k, self.bins).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                gain[(hs < self.least) | (ht - hs < self.least)] = 0
                flat = gain.reshape(width, -1)
                best = flat.argmax(1)
                f, b = best // self.bins, best % self.bins
                open_ = flat[np.arange(width), best] > 1e-9
                at = width - 1 + np.arange(width)
                feature[at] = np.where(open_, f, 0)
                cut[at] = [edges[i][j] if o and j < len(edges[i]) else np.inf for i, j, o in zip(f, b, open_)]
                node = node * 2 + (x[np.arange(n), feature[at][node]] > cut[at][node])
            total_g = np.bincount(node, g, 2**self.depth)
            total_h = np.bincount(node, h, 2**self.depth)
            leaf = self.rate * total_g / (total_h + self.l2)
            margin += leaf[node]
            features.append(feature)
            cuts.append(cut)
            leaves.append(leaf)
        self.features, self.cuts, self.leaves = np.array(features), np.array(cuts), np.array(leaves)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds before calibration."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            out += leaf[node]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Fit scale and shift of the log-odds on rows that were not used to fit the trees."""
        if len(y) < 10 or y.min() == y.max():
            return self
        m = self.margin(x)
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            r, w = y - p, p * (1 - p) + 1e-9
            hess = np.array([[(w * m * m).sum() + 1.0, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, np.array([(r * m).sum() - (a - 1), r.sum()]))
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-8:
                break
        if a > 0:
            self.scale, self.shift = float(a), float(b)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.scale * self.margin(x) + self.shift

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def threshold_for(probability: np.ndarray, y: np.ndarray, precision: float, otherwise: float = 0.99) -> float:
    """Lowest cut whose selection has at least this precision; ``otherwise`` where none has."""
    order = np.argsort(-probability, kind="stable")
    hits = np.cumsum(y[order])
    share = hits / np.arange(1, len(y) + 1)
    good = np.flatnonzero(share >= precision)
    return float(probability[order][good[-1]]) if len(good) else otherwise
