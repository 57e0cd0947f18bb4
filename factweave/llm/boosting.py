"""Gradient-boosted trees on binned features with logistic loss, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of equal depth as arrays: feature, cut (go right if above), leaf value."""

    prior: float
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < len(feature):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - len(feature)] if at.size else 0
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0) -> Boosted:
    share = np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4)
    model = Boosted(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    margin, inner = np.full(len(y), model.prior), 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut, place = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        split = np.full(inner, bins + 1)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = place - first
            best = np.full(many, 1e-9)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = at * (bins + 1) + binned[:, j]
                gs = np.bincount(key, g, many * (bins + 1)).reshape(many, -1)
                hs = np.bincount(key, h, many * (bins + 1)).reshape(many, -1)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain = np.where((hl > 0.5) & (ht - hl > 0.5), gain, 0)[:, : len(e)]
                top = gain.argmax(1)
                better = gain[np.arange(many), top] > best
                nodes = first + np.flatnonzero(better)
                best[better] = gain[better, top[better]]
                feature[nodes], split[nodes], cut[nodes] = j, top[better], e[top[better]]
            place = 2 * place + 1 + (binned[np.arange(len(y)), feature[place]] > split[place])
        leaf = place - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = rate * gs / (hs + ridge)
        margin += value[leaf]
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(value)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(knots, values) of the pool-adjacent-violators fit, for linear interpolation."""
    if not len(y):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order].astype(float), strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, _, hi = blocks.pop()
            v1, w1, lo, _ = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    knots = np.array([k for b in blocks for k in ((b[2], b[3]) if b[3] > b[2] else (b[2],))])
    values = np.array([b[0] for b in blocks for _ in range(2 if b[3] > b[2] else 1)])
    return knots, values
