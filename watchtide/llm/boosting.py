"""Gradient-boosted trees on binned dense features, and isotonic calibration; for bounded training samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete trees of one depth: inner node k has children 2k + 1 and 2k + 2; an unsplit node sends all rows left."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    above: np.ndarray  # threshold: larger values go right
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, above, leaf in zip(self.feature, self.above, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > above[node])
            out += leaf[node - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, smoothing: float = 1.0, least: float = 2.0) -> Trees:
    """Newton boosting for the logistic loss."""
    n, width = x.shape
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    inner = (1 << depth) - 1
    if not n or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)  # bin b: edges[b-1] < v <= edges[b]
    margin = np.full(n, base)
    features, aboves, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        feature, above = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.full(count, 1e-6)
            cut = np.full(count, -1)
            for f in range(width):
                slot = (node - first) * BINS + binned[:, f]
                sums = [np.cumsum(np.bincount(slot, v, count * BINS).reshape(count, BINS), 1) for v in (g, h)]
                (gl, hl), (gt, ht) = sums, [s[:, -1:] for s in sums]
                score = gl**2 / (hl + smoothing) + (gt - gl) ** 2 / (ht - hl + smoothing) - gt**2 / (ht + smoothing)
                score = np.where((hl > 0) & (ht - hl > 0), score, 0)[:, : len(edges[f])]
                if not score.shape[1]:
                    continue
                at = score.argmax(1)
                better = score[np.arange(count), at] > best
                best = np.where(better, score[np.arange(count), at], best)
                cut = np.where(better, at, cut)
                feature[first : first + count] = np.where(better, f, feature[first : first + count])
            split = cut >= 0
            above[first : first + count] = [edges[feature[first + k]][cut[k]] if split[k] else np.inf for k in range(count)]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > above[node])
        sums = [np.bincount(node - inner, v, inner + 1) for v in (g, h)]
        leaf = -rate * sums[0] / (sums[1] + smoothing) * (np.bincount(node - inner, minlength=inner + 1) >= least)
        margin += leaf[node - inner]
        features.append(feature)
        aboves.append(above)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(aboves), np.array(leaves))


@dataclass
class Isotonic:
    """A non-decreasing map from margin to probability, linear between the middles of pooled blocks."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        if len(self.at) < 2:
            return 1 / (1 + np.exp(-margin))
        # beyond the outer blocks scores still rise a little with the margin, so that order is kept
        flat = np.interp(margin, self.at, self.value)
        return 0.98 * flat + 0.02 / (1 + np.exp(-margin))


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators over the sorted margins."""
    if not len(margin) or y.min() == y.max():
        return Isotonic(np.zeros(0), np.zeros(0))
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, v in zip(margin[order].tolist(), y[order].tolist()):
        blocks.append([v, 1, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    table = np.array(blocks)
    return Isotonic(table[:, 2] / table[:, 1], table[:, 0] / table[:, 1])
