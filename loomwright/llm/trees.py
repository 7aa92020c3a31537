"""Gradient boosting of small decision trees on binned features, for samples that fit in a task.

Each round fits a tree of fixed depth to the gradients of the logistic loss: every level sums gradients over the bins of
all features at once and splits each node where the gain is largest (ties: the first feature, the lowest bin). Nothing
is drawn at random, so the same rows in any order give the same trees up to the rounding of sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS, DEPTH, RATE, BINS, LEAST, RIDGE = 60, 4, 0.2, 32, 4.0, 1.0


@dataclass
class Boosted:
    bias: float
    feature: np.ndarray  #: of node k of tree t
    cut: np.ndarray  #: values up to the cut go left
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out


def edges_of(x: np.ndarray) -> list[np.ndarray]:
    """Cuts between the values of each feature, BINS - 1 at most."""
    out = []
    for c in x.T:
        v = np.unique(c)
        if len(v) > BINS:
            v = np.unique(np.quantile(c, np.linspace(0, 1, BINS), method="lower"))
        out.append((v[1:] + v[:-1]) / 2)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Boosted:
    n, f = x.shape
    share = float(np.clip(y.mean() if n else 0.5, 1e-6, 1 - 1e-6))
    edges = edges_of(x)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    flat = binned + np.arange(f) * BINS
    score = np.full(n, np.log(share / (1 - share)))
    inner = 2**DEPTH - 1
    model = Boosted(float(score[0]) if n else 0.0, np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1)))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            nodes, first = 2**level, 2**level - 1
            key = ((at - first)[:, None] * (f * BINS) + flat).ravel()
            sums = [np.bincount(key, np.repeat(v, f), minlength=nodes * f * BINS).reshape(nodes, f, BINS) for v in (g, h, np.ones(n))]
            left = [s.cumsum(2)[:, :, :-1] for s in sums]
            total = [s.sum(2)[:, :, None] for s in sums]
            gain = sum(a[0] ** 2 / (a[1] + RIDGE) for a in (left[:2], [tt - ll for tt, ll in zip(total[:2], left[:2], strict=True)])) - total[0] ** 2 / (total[1] + RIDGE)
            gain[(left[2] < LEAST) | (total[2] - left[2] < LEAST)] = -1
            best = gain.reshape(nodes, -1).argmax(1)
            for k in range(nodes):
                feature, b = divmod(int(best[k]), BINS - 1)
                if gain[k, feature, b] > 1e-9 and b < len(edges[feature]):
                    model.feature[t, first + k], model.cut[t, first + k] = feature, edges[feature][b]
            at = 2 * at + 1 + (x[np.arange(n), model.feature[t, at]] > model.cut[t, at])
        leaf = at - inner
        model.leaf[t] = -RATE * np.bincount(leaf, g, minlength=inner + 1) / (np.bincount(leaf, h, minlength=inner + 1) + RIDGE)
        score += model.leaf[t][leaf]
    return model


def calibration(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b for which 1 / (1 + exp(-(a * s + b))) is the chance of y: Platt's fit, with his smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w, z = np.array([1.0, 0.0]), np.column_stack([s, np.ones(len(s))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (p - target) + 1e-6 * w)
        w = w - np.clip(step, -2, 2)
    return float(w[0]), float(w[1])
