"""Gradient-boosted trees on binned features and isotonic calibration, in numpy; deterministic."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete binary trees: node i has children 2i + 1 and 2i + 2; leaves hold steps of the log-odds."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 1.0, least: float = 2.0) -> Boosted:
    """Logistic loss, second order. Bins are quantiles of each feature; a child weighs at least `least`."""
    w = np.ones(len(y)) if w is None else w
    mean = np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-4, 1 - 1e-4) if len(y) else 0.5
    prior = float(np.log(mean / (1 - mean)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    none = Boosted(prior, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y) or y.min() == y.max():
        return none
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    codes = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], axis=1)
    width = bins + 1
    flat = codes + np.arange(m) * width
    z = np.full(n, prior)
    fs, ts, vs = [], [], []
    for _ in range(trees):
        p = sigmoid(z)
        g, h = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            base = (1 << level) - 1
            k = 1 << level
            cell = ((at - base)[:, None] * (m * width) + flat).ravel()
            gs = np.bincount(cell, np.repeat(g, m), k * m * width).reshape(k, m, width)
            hs = np.bincount(cell, np.repeat(h, m), k * m * width).reshape(k, m, width)
            ws = np.bincount(cell, np.repeat(w, m), k * m * width).reshape(k, m, width)
            gl, hl, wl = gs.cumsum(2), hs.cumsum(2), ws.cumsum(2)
            gt, ht, wt = gl[:, :, -1:], hl[:, :, -1:], wl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(wl < least) | (wt - wl < least)] = 0
            best = gain.reshape(k, -1).argmax(1)
            for i in range(k):
                j, b = divmod(int(best[i]), width)
                if gain[i, j, b] > 1e-9 and b < len(cuts[j]):
                    f[base + i], t[base + i] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        spot = at - inner
        v = -rate * np.bincount(spot, g, leaves) / (np.bincount(spot, h, leaves) + ridge)
        z += v[spot]
        fs.append(f)
        ts.append(t)
        vs.append(v)
    return Boosted(prior, np.array(fs), np.array(ts), np.array(vs))


@dataclass
class Isotonic:
    """A rising step function through pooled means, linear between their places."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, z: np.ndarray) -> np.ndarray:
        """A thousandth of the uncalibrated probability is mixed in, so that equal steps keep their order."""
        steps = np.interp(z, self.x, self.y) if len(self.x) else np.full(len(z), 0.5)
        return 0.999 * steps + 0.001 * sigmoid(z)


def isotonic(z: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; equal z are pooled first."""
    xs, inv = np.unique(z, return_inverse=True)
    sums, counts = np.bincount(inv, y, len(xs)), np.bincount(inv, minlength=len(xs)).astype(float)
    pools: list[list[float]] = []
    for x, s, c in zip(xs, sums, counts, strict=True):
        pools.append([s, c, x, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, c2, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s2, pools[-1][1] + c2, pools[-1][2], hi]
    at = [(x, s / c) for s, c, lo, hi in pools for x in ((lo, hi) if hi > lo else (lo,))]
    return Isotonic(np.array([a for a, _ in at]), np.array([b for _, b in at]))


def folds(ids: np.ndarray, k: int = 5) -> np.ndarray:
    """A fold for each id, the same in every run."""
    u = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((u >> np.uint64(33)) % np.uint64(k)).astype(np.int64)
