"""Gradient-boosted trees for a binary target, small enough to travel with a task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    start: float
    feature: np.ndarray  # (trees, 2 ** depth - 1); an infinite cut splits nothing
    cut: np.ndarray
    leaf: np.ndarray  # (trees, 2 ** depth)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 2.0, every: int = 1) -> Trees:
    """Logistic loss, Newton leaves, splits on quantile histograms; a tree sees one in ``every`` rows, in turn. Deterministic."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    binned = [np.searchsorted(cuts[j], x[:, j], side="left").astype(np.int64) for j in range(k)]
    useful = [j for j in range(k) if len(cuts[j])]
    share = (y.sum() + 1) / (n + 2)
    start = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    logit = np.full(n, start)
    for t in range(trees):
        some = slice(t % every, None, every)
        p = 1 / (1 + np.exp(-logit[some]))
        g, h = y[some] - p, p * (1 - p)
        at = np.zeros(len(g), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            node = at - first
            best = np.full(width, 1e-6)
            row, size = node * bins, width * bins
            for j in useful:
                key = row + binned[j][some]
                gl = np.bincount(key, g, size).reshape(width, bins).cumsum(1)
                hl = np.bincount(key, h, size).reshape(width, bins).cumsum(1)
                ga, ha = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least) | (ha - hl < least)] = -1
                gain[:, len(cuts[j]) :] = -1
                b = gain.argmax(1)
                top = gain[np.arange(width), b]
                for v in np.flatnonzero(top > best):
                    best[v], feature[t, first + v], cut[t, first + v] = top[v], j, cuts[j][b[v]]
            at = 2 * at + 1 + (x[some][np.arange(len(g)), feature[t][at]] > cut[t][at])
        place = at - inner
        leaf[t] = rate * np.bincount(place, g, inner + 1) / (np.bincount(place, h, inner + 1) + ridge)
        logit += Trees(0.0, feature[t : t + 1], cut[t : t + 1], leaf[t : t + 1]).logit(x)
    return Trees(start, feature, cut, leaf)
