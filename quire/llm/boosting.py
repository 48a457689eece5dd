"""Small numpy learners: histogram gradient boosting for a binary label, and isotonic regression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Boosted:
    """Trees of fixed depth with logistic loss; a node splits on value > threshold."""

    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    depth: int = 3

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0) -> Boosted:
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    coded = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Boosted(float(np.log(share / (1 - share))), [], depth)
    score = np.full(n, model.start)
    inner, rows = 2**depth - 1, np.arange(n)
    for _ in range(rounds):
        p = sigmoid(score)
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best, where = np.full(count, 1e-6), np.full((count, 2), -1)
            for j in range(width):
                size = len(cuts[j]) + 1
                if size == 1:
                    continue
                key = (node - first) * size + coded[:, j]
                g = np.bincount(key, grad, count * size).reshape(count, size).cumsum(1)
                h = np.bincount(key, hess, count * size).reshape(count, size).cumsum(1)
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                better = top > best
                best[better] = top[better]
                where[better, 0], where[better, 1] = j, at[better]
            for k in range(count):
                if where[k, 0] >= 0:
                    feature[first + k], threshold[first + k] = where[k, 0], cuts[where[k, 0]][where[k, 1]]
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        value = rate * g / (h + ridge)
        model.trees.append((feature, threshold, value))
        score += value[leaf]
    return model


@dataclass
class Isotonic:
    """A non-decreasing curve through pooled blocks, linear in between."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.value)


def isotonic(x: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; equal x are one point; each block's mean is drawn by one row towards the base rate."""
    order = np.argsort(x, kind="stable")
    points, begin = np.unique(x[order], return_index=True)
    sums = np.add.reduceat(y[order].astype(float), begin)
    sizes = np.diff(np.append(begin, len(x))).astype(float)
    blocks: list[list[float]] = []
    for p, s, n in zip(points, sums, sizes, strict=True):
        blocks.append([s, n, p * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    base = float(y.mean())
    value = np.array([(s + base) / (n + 1) for s, n, _ in blocks])
    return Isotonic(np.array([p / n for _, n, p in blocks]), np.maximum.accumulate(value))
