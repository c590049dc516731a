"""Histogram gradient-boosted trees for two classes, in numpy.

Features are binned once by quantiles; each level of a tree is one histogram
over (node, feature, bin).  A fitted model is three arrays: all trees are
complete and flattened in heap order, so scoring walks every row down a tree
with array indexing only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """``feature`` and ``threshold`` by tree and inner node, ``leaf`` by tree and leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.ndim == 2 else 0
        depth = int(np.log2(inner + 1)) if inner else 0
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            raw += leaf[at - inner]
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def constant(p: float) -> Trees:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Trees(np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 0)), float(np.log(p / (1 - p))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Fit to labels 0 and 1; with one class only, a constant."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # x <= e[k] is bin k at most
    inner, base = 2**depth - 1, float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(n, base)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    cell = binned + np.arange(m) * bins
    rows = np.arange(n)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            where = ((at - first)[:, None] * (m * bins) + cell).ravel()
            sums = [np.bincount(where, np.repeat(v, m), count * m * bins).reshape(count, m, bins).cumsum(2) for v in (g, h)]
            gl, hl = sums
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in np.flatnonzero(gain.reshape(count, -1).max(1) > 1e-9):
                j, b = divmod(int(best[k]), bins)
                if b < len(edges[j]):
                    feature[t, first + k], threshold[t, first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[rows, feature[t, at]] > threshold[t, at])
        gs, hs = (np.bincount(at - inner, v, inner + 1) for v in (g, h))
        leaf[t] = -rate * gs / (hs + l2)
        raw += leaf[t, at - inner]
    return Trees(feature, threshold, leaf, base)
