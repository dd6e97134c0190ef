"""Gradient-boosted trees for a softmax over few classes: histogram splits on quantile bins, in numpy."""

from __future__ import annotations

import math

import numpy as np


def _exp(x: np.ndarray) -> np.ndarray:
    """exp by the C library: numpy's differs in the last bit between processors (its AVX-512 code), and where gains all but tie, a split hangs on that bit."""
    return np.fromiter(map(math.exp, x.ravel().tolist()), float, x.size).reshape(x.shape)


class Boosted:
    """Complete trees of fixed depth, kept as arrays: ``rounds`` of one tree a class."""

    def __init__(self, classes: int, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.k, self.rounds, self.depth, self.rate, self.bins, self.ridge = classes, rounds, depth, rate, bins, ridge

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        n, d = b.shape
        logits = np.zeros((n, self.k))
        self.feature = np.zeros((self.rounds, self.k, 2**self.depth - 1), np.int32)
        self.bound = np.full((self.rounds, self.k, 2**self.depth - 1), self.bins, np.int32)
        self.value = np.zeros((self.rounds, self.k, 2**self.depth))
        hot = np.eye(self.k)[y]
        for r in range(self.rounds):
            p = _exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for c in range(self.k):
                g, h = p[:, c] - hot[:, c], np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
                at = np.zeros(n, np.int64)
                for level in range(self.depth):
                    m = 2**level
                    sums = np.zeros((2, d, m, self.bins))
                    for j in range(d):
                        key = at * self.bins + b[:, j]
                        for q, w in enumerate((g, h)):
                            sums[q, j] = np.bincount(key, w, m * self.bins).reshape(m, self.bins)
                    left = sums.cumsum(-1)[..., :-1]
                    total = sums.sum(-1, keepdims=True)
                    score = lambda s: s[0] ** 2 / (s[1] + self.ridge)
                    gain = score(left) + score(total - left) - score(total)
                    best = gain.transpose(1, 0, 2).reshape(m, -1)
                    pick = best.argmax(1)
                    for node in range(m):
                        if best[node, pick[node]] > 1e-6:
                            self.feature[r, c, m - 1 + node] = pick[node] // (self.bins - 1)
                            self.bound[r, c, m - 1 + node] = pick[node] % (self.bins - 1)
                    f, t = self.feature[r, c, m - 1 + at], self.bound[r, c, m - 1 + at]
                    at = 2 * at + (b[np.arange(n), f] > t)
                gs, hs = (np.bincount(at, w, 2**self.depth) for w in (g, h))
                self.value[r, c] = -self.rate * gs / (hs + self.ridge)
                logits[:, c] += self.value[r, c, at]
        return self

    def log_proba(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        rows = np.arange(len(b))
        logits = np.zeros((len(b), self.k))
        for r in range(self.rounds):
            for c in range(self.k):
                at = np.zeros(len(b), np.int64)
                for level in range(self.depth):
                    i = 2**level - 1 + at
                    at = 2 * at + (b[rows, self.feature[r, c, i]] > self.bound[r, c, i])
                logits[:, c] += self.value[r, c, at]
        z = logits - logits.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def save(self, path) -> None:
        """The fitted arrays as one compressed file."""
        sizes = np.array([len(e) for e in self.edges])
        shape = np.array([self.k, self.rounds, self.depth, self.bins])
        np.savez_compressed(path, edges=np.concatenate(self.edges), sizes=sizes, shape=shape, feature=self.feature.astype(np.int16), bound=self.bound.astype(np.int16), value=self.value)

    @classmethod
    def load(cls, path) -> Boosted:
        with np.load(path) as f:
            k, rounds, depth, bins = (int(x) for x in f["shape"])
            out = cls(k, rounds, depth, bins=bins)
            out.edges = np.split(f["edges"], np.cumsum(f["sizes"])[:-1])
            out.feature, out.bound, out.value = f["feature"].astype(np.int32), f["bound"].astype(np.int32), f["value"]
        return out
