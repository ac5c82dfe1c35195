"""Gradient-boosted trees with monotonic constraints, kept as flat numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: node i of a tree has the children 2i+1 (value <= threshold) and 2i+2."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray  # (trees, 2**depth - 1); infinity where a node isn't split
    value: np.ndarray  # (trees, 2**depth)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of features: all rows go down a tree together, one level at a time."""
        total = np.full(len(x), self.base)
        inner, rows = self.feature.shape[1], np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...] | None = None, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 2.0, penalty: float = 1.0) -> Forest:
    """Logistic loss and Newton steps on histograms. monotone: +1, -1 or 0 for each feature."""
    n, width = x.shape
    monotone = monotone or (0,) * width
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    inner = 2**depth - 1
    features, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    total = np.full(n, base)
    weight = lambda g, h: -g / (h + penalty)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = at - first
            best = np.full(count, 1e-6)
            pick = [None] * count
            for j in range(width):
                b = len(edges[j]) + 1
                if b == 1:
                    continue
                key = local * b + binned[:, j]
                g = np.bincount(key, grad, minlength=count * b).reshape(count, b).cumsum(axis=1)
                h = np.bincount(key, hess, minlength=count * b).reshape(count, b).cumsum(axis=1)
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                lo, hi = low[first : first + count, None], high[first : first + count, None]
                wl, wr = np.clip(weight(gl, hl), lo, hi), np.clip(weight(gt - gl, ht - hl), lo, hi)
                w0 = np.clip(weight(gt, ht), lo, hi)
                loss = lambda gg, hh, w: gg * w + 0.5 * (hh + penalty) * w**2
                gain = loss(gt, ht, w0) - loss(gl, hl, wl) - loss(gt - gl, ht - hl, wr)
                gain[(hl < least / 4) | (ht - hl < least / 4)] = -np.inf
                if monotone[j]:
                    gain[(wr - wl) * monotone[j] < 0] = -np.inf
                k = gain.argmax(axis=1)
                for i in np.flatnonzero(gain[np.arange(count), k] > best):
                    best[i], pick[i] = gain[i, k[i]], (j, int(k[i]), float(wl[i, k[i]]), float(wr[i, k[i]]))
            for i, found in enumerate(pick):
                node = first + i
                low[2 * node + 1 : 2 * node + 3], high[2 * node + 1 : 2 * node + 3] = low[node], high[node]
                if found:
                    j, k, wl, wr = found
                    features[t, node], thresholds[t, node] = j, edges[j][k]
                    # Below a constrained split, neither side may pass the middle of the two.
                    middle = (wl + wr) / 2
                    if monotone[j] > 0:
                        high[2 * node + 1], low[2 * node + 2] = middle, middle
                    elif monotone[j] < 0:
                        low[2 * node + 1], high[2 * node + 2] = middle, middle
            at = 2 * at + 1 + (x[np.arange(n), features[t, at]] > thresholds[t, at])
        g, h = np.bincount(at - inner, grad, minlength=inner + 1), np.bincount(at - inner, hess, minlength=inner + 1)
        values[t] = rate * np.clip(weight(g, h), low[inner:], high[inner:])
        total += values[t, at - inner]
    return Forest(features, thresholds, values, base)
