"""Gradient-boosted trees over dense features, and isotonic calibration, in numpy.

Logistic loss, second-order leaf values, histograms of quantile bins; complete trees of a fixed
depth stored as arrays, so that scoring a block is a few array operations for each tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """base: log-odds before any tree; feature, cut: (trees, inner nodes); leaf: (trees, leaves)."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        inner, rows = self.feature.shape[1], np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - inner] if len(node) else 0
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Fits on rows x and labels y (0 or 1); ``least`` bounds the hessian weight of a leaf."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    rate_of_one = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(rate_of_one / (1 - rate_of_one)))
    inner, score = 2**depth - 1, np.full(n, base)
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = (1e-6, 0, np.inf)
            if len(rows) > 1:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j in range(width):
                    if not len(edges[j]):
                        continue
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, g[rows], len(edges[j]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(edges[j]) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(hl < least) | (hs - hl < least)] = 0
                    if (at := int(gain.argmax()), gain.max())[1] > best[0]:
                        best = (float(gain[at]), j, float(edges[j][at]))
            _, feature[t, k], cut[t, k] = best
            node[rows] = 2 * k + 1 + (x[rows, best[1]] > best[2])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        score += leaf[t][at]
    return Trees(base, feature, cut, leaf)


@dataclass(frozen=True)
class Isotonic:
    """A rising piecewise-linear map through the means of pooled blocks."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.at, self.value), 0, 1)


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool-adjacent-violators; each block's mean is smoothed by half a row of either label."""
    if not len(raw):
        return Isotonic(np.array([-10.0, 10.0]), np.array([0.0, 1.0]))
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of raw
    xs, start = raw[order], 0
    ys = y[order].astype(float)
    for end in [*np.flatnonzero(np.diff(xs)) + 1, len(xs)]:  # ties stay together
        blocks.append([ys[start:end].sum(), end - start, xs[start:end].sum()])
        start = end
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    value = np.maximum.accumulate((b[:, 0] + 0.5) / (b[:, 1] + 1))
    mean = b[:, 2] / b[:, 1]
    # A gentle slope beyond the outer blocks keeps the order of the raw scores.
    at = np.concatenate([[mean[0] - 8], mean, [mean[-1] + 8]])
    return Isotonic(at, np.concatenate([[value[0] / 2], value, [(1 + value[-1]) / 2]]))
