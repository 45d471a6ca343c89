"""Boosted trees for two classes, and a calibration of their scores, in numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    """Gradient boosting on the logistic loss; trees of fixed depth that split at quantiles of the features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, cuts: int = 31, shrink: float = 1.0):
        self.rounds, self.depth, self.rate, self.cuts, self.shrink = rounds, depth, rate, cuts, shrink
        self.start, self.trees, self.edges = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        q = np.linspace(0, 1, self.cuts + 2)[1:-1]
        self.edges = [np.unique(np.quantile(c, q)) for c in x.T]
        bins = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), np.int64), []
            for d in range(self.depth):
                level = [self._split(bins, g, h, node == k) for k in range(1 << d)]
                feature, cut = (np.array(v) for v in zip(*level, strict=True))
                node = 2 * node + (bins[np.arange(len(y)), feature[node]] > cut[node])
                splits.append((feature, cut))
            n = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + self.shrink)
            f += leaf[node]
            self.trees.append((splits, leaf))
        return self

    def _split(self, bins, g, h, mine) -> tuple[int, int]:
        """Feature and last bin of the left side with the largest gain; (0, large) keeps all left."""
        best, gain = (0, 1 << 30), 1e-9
        if mine.sum() < 2:
            return best
        b, g, h = bins[mine], g[mine], h[mine]
        all_g, all_h = g.sum(), h.sum()
        for j in range(b.shape[1]):
            n = len(self.edges[j]) + 1
            gl, hl = np.cumsum(np.bincount(b[:, j], g, n))[:-1], np.cumsum(np.bincount(b[:, j], h, n))[:-1]
            if not len(gl):
                continue
            s = self.shrink
            got = gl**2 / (hl + s) + (all_g - gl) ** 2 / (all_h - hl + s) - all_g**2 / (all_h + s)
            if got.max() > gain:
                gain, best = got.max(), (j, int(got.argmax()))
        return best

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])
        f = np.full(len(x), self.start)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = 2 * node + (bins[np.arange(len(x)), feature[node]] > cut[node])
            f += leaf[node]
        return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least scores of the steps and the share of positives on each, non-decreasing (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    steps: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        steps.append([s, v, 1.0])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, v1, n1 = steps.pop()
            steps[-1][1] += v1
            steps[-1][2] += n1
    return np.array([s for s, _, _ in steps]), np.array([(v + 0.5 * (v > 0)) / (n + 1) for _, v, n in steps])


def calibrated(steps: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    at = np.searchsorted(steps[0], score, "right") - 1
    return np.where(at >= 0, steps[1][np.maximum(at, 0)], 0.0)
