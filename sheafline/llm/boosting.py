"""Gradient-boosted regression trees for a yes or no, small enough to be trained on the driver and sent to the workers."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of trees of fixed depth over quantile cuts. Deterministic."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, cuts: int = 24, leaf: int = 10, share: float = 1.0):
        self.rounds, self.depth, self.rate, self.cuts, self.leaf, self.share = rounds, depth, rate, cuts, leaf, share
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape
        p = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        if n < 2 * self.leaf:
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.cuts + 1)[1:-1])) for j in range(m)]
        bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        score = np.full(n, self.base)
        draw = np.random.default_rng(0)
        for _ in range(self.rounds):
            # each tree sees a share of the features, the same ones at every fit
            self.seen = np.sort(draw.permutation(m)[: max(1, round(self.share * m))])
            prob = 1 / (1 + np.exp(-score))
            tree, where = self._grow(bins, y - prob, prob * (1 - prob))
            self.trees.append(tree)
            score += tree[2][where]
        return self

    def _grow(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray):
        n, m = bins.shape
        size = 2**self.depth
        feature, cut, node = np.full(size - 1, -1), np.zeros(size - 1), np.zeros(n, dtype=int)
        for level in range(self.depth):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                at = np.flatnonzero(node == k)
                best = (1e-6, -1, 0)
                if len(at) >= 2 * self.leaf:
                    gs, hs = g[at].sum(), h[at].sum()
                    for j in self.seen:
                        q = len(self.edges[j]) + 1
                        if q < 2:
                            continue
                        b = bins[at, j]
                        gl, hl, cl = (np.cumsum(np.bincount(b, w, q))[:-1] for w in (g[at], h[at], None))
                        ok = (cl >= self.leaf) & (len(at) - cl >= self.leaf)
                        gain = np.where(ok, gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), -1)
                        i = int(gain.argmax()) if len(gain) else 0
                        if len(gain) and gain[i] > best[0]:
                            best = (float(gain[i]), int(j), i)
                if best[1] >= 0:
                    feature[k], cut[k] = best[1], self.edges[best[1]][best[2]]
                    node[at] = np.where(bins[at, best[1]] <= best[2], 2 * k + 1, 2 * k + 2)
                else:
                    node[at] = 2 * k + 1
        leaf = node - (size - 1)
        value = np.array([self.rate * g[leaf == k].sum() / (h[leaf == k].sum() + 1) for k in range(size)])
        return (feature, cut, value), leaf

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                f = feature[node]
                right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > cut[node])
                node = 2 * node + 1 + right
            score += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))
