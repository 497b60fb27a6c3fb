"""Histogram gradient-boosted trees for a binary label, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    edges: list[np.ndarray]
    base: float
    rate: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        out = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            out += self.rate * leaf[_leaf_of(bins, feature, cut)]
        return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def _leaf_of(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Trees are full: node i has children 2i+1 and 2i+2; a node without a split sends everything left."""
    node = np.zeros(len(bins), np.int64)
    for _ in range(int(np.log2(len(feature) + 1))):
        node = 2 * node + 1 + (bins[np.arange(len(bins)), feature[node]] > cut[node])
    return node - len(feature)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, n_bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Boosted:
    """Newton boosting of the logistic loss; splits maximise the usual gain over binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])]
    edges = [np.unique(np.r_[e, np.nextafter(0, 1)]) if (x[:, j] == 0).any() and (x[:, j] != 0).any() else e for j, e in enumerate(edges)]
    bins = binned(x, edges)
    mean = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    model = Boosted(edges, float(np.log(mean / (1 - mean))), rate)
    f = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = weight * (y - p), weight * p * (1 - p) + 1e-12
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 255, np.int64)
        node = np.zeros(len(y), np.int64)
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            if len(rows) >= 2:
                gs, hs, best = g[rows].sum(), h[rows].sum(), 1e-6
                for j in range(x.shape[1]):
                    n = len(edges[j]) + 1
                    gl, hl = (np.bincount(bins[rows, j], v[rows], n).cumsum()[:-1] for v in (g, h))
                    wl = np.bincount(bins[rows, j], weight[rows], n).cumsum()[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain = np.where((wl >= least) & (weight[rows].sum() - wl >= least), gain, 0)
                    if len(gain) and gain.max() > best:
                        best, feature[i], cut[i] = gain.max(), j, int(gain.argmax())
            node[rows] = 2 * i + 1 + (bins[rows, feature[i]] > cut[i])
        at = node - inner
        leaf = np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        model.trees.append((feature, cut, leaf))
        f += rate * leaf[at]
    return model


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, probability) of a non-decreasing fit, for linear interpolation.

    Rows of one margin are one point from the start: they have one probability whatever their order.
    """
    at, group = np.unique(margin, return_inverse=True)
    blocks: list[list[float]] = []  # weight, weighted label, first and last margin
    for m, w, t in zip(at, np.bincount(group, weight, len(at)), np.bincount(group, weight * y, len(at)), strict=True):
        blocks.append([w, t, m, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ps = np.array([b[1] / b[0] for b in blocks for _ in (0, 1)])
    return xs, ps
