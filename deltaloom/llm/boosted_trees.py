"""Gradient boosted trees of fixed depth for a binary label, on a bounded matrix of examples, and their calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

DEPTH, ROUNDS, RATE, RIDGE, BINS, LEAST_WEIGHT = 3, 60, 0.2, 1.0, 32, 1.0


@dataclass
class Trees:
    """Complete trees: ``feature`` and ``cut`` of the inner nodes in level order, ``leaf`` values; and the line that calibrates their sum."""

    base: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, (1 << DEPTH) - 1), np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, (1 << DEPTH) - 1)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 1 << DEPTH)))
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row falls into, over all trees at once."""
        n, trees = len(x), np.arange(len(self.feature))
        at = np.zeros((n, len(trees)), np.int64)
        rows = np.arange(n)[:, None]
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.cut[trees, at])
        return self.base + self.leaf[trees, at - ((1 << DEPTH) - 1)].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for ``y`` (0 or 1) by Newton steps over histograms of quantile bins; with one class only their base."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Trees(float(np.log(rate / (1 - rate))))
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS, method="lower")) for c in x.T]
    cuts = [c[c < v.max()] for c, v in zip(cuts, x.T, strict=True)]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    z = np.full(len(y), model.base)
    features, values, leaves = [], [], []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        feature, cut, node = [], [], np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            best = np.full(1 << level, 1e-9)
            chosen, at = np.zeros(1 << level, np.int64), np.full(1 << level, BINS)
            for f in range(x.shape[1]):
                cells = node * BINS + binned[:, f]
                cg, ch = (np.bincount(cells, v, (1 << level) * BINS).reshape(-1, BINS).cumsum(axis=1) for v in (g, h))
                gain = lambda a, b: a * a / (b + RIDGE)
                gains = gain(cg, ch) + gain(cg[:, -1:] - cg, ch[:, -1:] - ch) - gain(cg[:, -1:], ch[:, -1:])
                gains[(ch < LEAST_WEIGHT) | (ch[:, -1:] - ch < LEAST_WEIGHT)] = 0
                top = gains.argmax(axis=1)
                better = gains[np.arange(1 << level), top] > best
                best, chosen, at = np.where(better, gains[np.arange(1 << level), top], best), np.where(better, f, chosen), np.where(better, top, at)
            feature += chosen.tolist()
            cut += [float(cuts[f][b]) if b < len(cuts[f]) else np.inf for f, b in zip(chosen, at, strict=True)]
            node = 2 * node + (binned[np.arange(len(y)), chosen[node]] > at[node])
        sums = [np.bincount(node, v, 1 << DEPTH) for v in (g, h)]
        step = RATE * sums[0] / (sums[1] + RIDGE)
        z += step[node]
        features.append(feature)
        values.append(cut)
        leaves.append(step)
    model.feature, model.cut, model.leaf = np.array(features), np.array(values), np.array(leaves)
    return model


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray) -> None:
    """Set the model's line so that its probabilities fit ``y`` of rows that it wasn't fitted on (Platt's targets)."""
    if len(y) == 0 or y.min() == y.max():
        return
    m, up, down = model.margin(x), y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -50, 50)))
        w, e = p * (1 - p) + 1e-9, target - p
        hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        grad = np.array([(e * m).sum() - 1e-3 * (a - 1), e.sum() - 1e-3 * b])
        da, db = np.linalg.solve(hess, grad)
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-9:
            break
    if a > 0:
        model.slope, model.shift = float(a), float(b)


def threshold(p: np.ndarray, y: np.ndarray, precision: float, z: float = 1.645) -> float:
    """The least probability, 0.5 or more, from which on the one-sided Wilson bound of the precision on ``y`` is at least ``precision``; infinite if there is none."""
    order = np.argsort(-p, kind="stable")
    hits, n = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    share = hits / n
    low = (share + z * z / (2 * n) - z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    last = np.append(p[order][1:] < p[order][:-1], True) if len(y) else np.zeros(0, bool)  # rows of one probability go together
    good = np.flatnonzero((low >= precision) & (p[order] >= 0.5) & last)
    return float(p[order][good[-1]]) if len(good) else float("inf")
