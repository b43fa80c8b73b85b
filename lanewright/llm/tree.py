"""A small decision tree (Gini, axis-parallel cuts), grown on a labelled table."""

from __future__ import annotations

import numpy as np


class DecisionTree:
    """Leaves hold the majority class; ties go to the smaller class."""

    def __init__(self, depth: int = 12, least: int = 1) -> None:
        self.depth, self.least = depth, least
        self.nodes: list[tuple[int, float, int, int, int]] = []  # feature (-1: leaf), cut, below, above, class

    def fit(self, x: np.ndarray, y: np.ndarray) -> DecisionTree:
        self.classes = int(y.max()) + 1
        self._grow(x, y, 0)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        me = len(self.nodes)
        counts = np.bincount(y, minlength=self.classes)
        self.nodes.append((-1, 0.0, 0, 0, int(counts.argmax())))
        if depth >= self.depth or counts.max() == len(y):
            return me
        best = (1e-9, -1, 0.0)
        pure = len(y) - (counts**2).sum() / len(y)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v = x[order, f]
            below = np.zeros((len(y), self.classes))
            below[np.arange(len(y)), y[order]] = 1
            below = below.cumsum(0)[:-1]
            n = np.arange(1, len(y))
            left = n - (below**2).sum(1) / n
            above = counts - below
            right = (len(y) - n) - (above**2).sum(1) / (len(y) - n)
            gain = np.where((v[1:] > v[:-1]) & (n >= self.least) & (len(y) - n >= self.least), pure - left - right, 0)
            k = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[k] > best[0]:
                best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
        if best[1] < 0:
            return me
        side = x[:, best[1]] <= best[2]
        lo = self._grow(x[side], y[side], depth + 1)
        hi = self._grow(x[~side], y[~side], depth + 1)
        self.nodes[me] = (best[1], best[2], lo, hi, int(counts.argmax()))
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, cut, lo, hi, klass = (np.array(c) for c in zip(*self.nodes))
        while True:
            live = np.flatnonzero(feature[at] >= 0)
            if not len(live):
                return klass[at]
            n = at[live]
            at[live] = np.where(x[live, feature[n]] <= cut[n], lo[n], hi[n])
