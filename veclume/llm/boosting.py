"""Gradient-boosted trees on histograms for a logistic loss, and isotonic calibration; NumPy only."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """A complete tree of a fixed depth: per level and node a feature and a bin, rows with more go right."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        depth = int(np.log2(len(self.value)))
        for _ in range(depth):
            right = bins[rows, self.feature[node]] > self.cut[node]
            node = 2 * node + 1 + right
        return node - (len(self.value) - 1)


@dataclass
class Boosted:
    """Trees over quantile bins of dense features."""

    trees: int = 60
    depth: int = 4
    rate: float = 0.15
    ridge: float = 1.0
    max_bins: int = 64
    prior: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    grown: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        share = np.clip(y.mean() if n else 0.5, 1e-4, 1 - 1e-4)
        self.prior = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.max_bins + 1)[1:-1])) if n else np.zeros(0) for k in range(width)]
        self.grown = []
        if n < 10 or share in (1e-4, 1 - 1e-4):
            return self
        bins = self.bins(x)
        least = max(3, min(20, n // 100))
        size = self.max_bins + 1
        raw = np.full(n, self.prior)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(bins, p - y, p * (1 - p), least, size)
            self.grown.append(tree)
            raw += tree.value[tree.leaves(bins)]
        return self

    def _grow(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray, least: int, size: int) -> Tree:
        inner, leaves = (1 << self.depth) - 1, 1 << self.depth
        feature, cut = np.zeros(inner, np.int64), np.full(inner, size)
        node = np.zeros(len(g), np.int64)
        rows = np.arange(len(g))
        for level in range(self.depth):
            first, count = (1 << level) - 1, 1 << level
            at = node - first
            best = np.full(count, 1e-6)
            for k in range(bins.shape[1]):
                key = at * size + bins[:, k]
                sums = [np.bincount(key, w, count * size).reshape(count, size).cumsum(axis=1) for w in (g, h, None)]
                (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(nl < least) | (nt - nl < least)] = -1
                where = gain.argmax(axis=1)
                value = gain[np.arange(count), where]
                better = value > best
                best[better] = value[better]
                feature[first : first + count][better] = k
                cut[first : first + count][better] = where[better]
            node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
        leaf = node - inner
        value = -self.rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + self.ridge)
        return Tree(feature, cut, value)

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        out = np.full(len(x), self.prior)
        for t in self.grown:
            out += t.value[t.leaves(bins)]
        return out


@dataclass
class Isotonic:
    """An increasing map of raw scores (log-odds) to probabilities by pooling adjacent violators.

    Between the centres of pools it is linear; below the first and above the
    last one it follows the logistic curve from the pool's value to 0 and 1, so
    that scores keep their order there. The outer pools' values stay off 0 and 1
    by what one more row would change.
    """

    at: np.ndarray
    value: np.ndarray

    @classmethod
    def fit(cls, raw: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []  # sum, count, sum of raw
        for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
            pools.append([v, 1, r])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                a = pools.pop()
                pools[-1] = [x + z for x, z in zip(pools[-1], a, strict=True)]
        if not pools:
            return cls(np.zeros(1), np.full(1, 0.5))
        value = np.array([p[0] / p[1] for p in pools])
        share = float(np.clip(y.mean(), 0.001, 0.999))
        value = np.clip(value, share / (pools[0][1] + 1), 1 - (1 - share) / (pools[-1][1] + 1))
        return cls(np.array([p[2] / p[1] for p in pools]), value)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        chance = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
        out = np.interp(raw, self.at, self.value)
        out = np.where(raw < self.at[0], self.value[0] * chance(raw) / chance(self.at[0]), out)
        return np.where(raw > self.at[-1], 1 - (1 - self.value[-1]) * chance(-raw) / chance(-self.at[-1]), out)
