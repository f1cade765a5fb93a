"""Hashed logistic regression in numpy."""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np

BITS = 16


_SEEN: dict[str, int] = {}


def hashed(feature: str) -> int:
    h = _SEEN.get(feature)
    if h is None:
        h = zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
        if len(_SEEN) < 200_000:
            _SEEN[feature] = h
    return h


class HashedLogistic:
    """Binary features as strings, hashed to ``2**BITS`` weights; trained by Adagrad on shuffled mini-batches, deterministic by seed."""

    def __init__(self, epochs: int = 6, rate: float = 0.3, l2: float = 1e-6, seed: int = 7):
        self.epochs, self.rate, self.l2, self.seed = epochs, rate, l2, seed
        self.w = np.zeros(1 << BITS, np.float32)

    def fit(self, rows: list[list[int]], y: np.ndarray) -> "HashedLogistic":
        rng = np.random.default_rng(self.seed)
        width = max(map(len, rows))
        flat = np.fromiter(chain.from_iterable(rows), np.int64)
        ids = np.flatnonzero(np.bincount(flat, minlength=1 << BITS))  # only the weights that occur are gone through
        m, place = len(ids), np.zeros(1 << BITS, np.int64)
        place[ids] = np.arange(m)
        x = np.full((len(rows), width), m)  # the last weight stays 0 and fills rows up
        x[np.arange(width) < np.array([len(r) for r in rows])[:, None]] = place[flat]
        w, g2 = np.append(self.w[ids], np.float32(0)), np.full(m, 1e-8, np.float32)
        for _ in range(self.epochs):
            order = rng.permutation(len(rows))
            xs, ys = x[order], y[order]
            for i in range(0, len(order), 128):
                xb = xs[i : i + 128]
                e = 1 / (1 + np.exp(-np.clip(w.take(xb).sum(axis=1), -30, 30))) - ys[i : i + 128]
                g = np.bincount(xb.ravel(), np.repeat(e / len(e), width), m + 1)[:m]
                hit = np.flatnonzero(g != 0)
                wh = w[hit]
                step = g[hit].astype(np.float32) + self.l2 * wh
                g2[hit] = gh = g2[hit] + step * step
                w[hit] = wh - self.rate * step / np.sqrt(gh)
        w = w[:m]
        self.w[ids] = w
        return self

    def score(self, row: list[int]) -> float:
        w = self.w
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, sum(w[i] for i in row))))))

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        n = np.array([len(r) for r in rows])
        flat = self.w[np.fromiter(chain.from_iterable(rows), np.int64, int(n.sum()))]
        z = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(n)[:-1]])) if len(flat) else np.zeros(len(rows))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
