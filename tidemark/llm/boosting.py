"""Gradient-boosted trees over binned columns, flattened into arrays of nodes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Trees laid end to end. A leaf is its own child, so that every row can take the same number of steps."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.start)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.limit[node], self.left[node], self.right[node])
            total += self.value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def bin_limits(column: np.ndarray, bins: int) -> np.ndarray:
    """Upper limits of at most ``bins`` bins of about equal counts; every value lies in or above them."""
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, smooth: float = 1.0, least_rows: int = 8, monotone: dict[int, int] | None = None) -> Forest:
    """Logistic gradient boosting on histograms of gradients.

    monotone: by column, +1 if a larger value may only raise the score, -1 if only lower it. A split against it is refused, and its children's values stay on their sides of the split's middle. With no rows the forest scores one half; with one class only it scores that class's smoothed share.
    """
    monotone = monotone or {}
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    start = float(np.log(share / (1 - share)))
    limits = [bin_limits(x[:, j], bins) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(limits[j], x[:, j], side="left") for j in range(width)], axis=1) if n else np.zeros((0, width), dtype=np.int64)
    margin = np.full(n, start)
    nodes: list[list[float]] = []
    roots: list[int] = []

    def add(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def best_split(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, low: float, high: float):
        g_all, h_all = grad[rows].sum(), hess[rows].sum()
        found = (1e-6, -1, -1, 0.0, 0.0)
        for j in range(width):
            k = len(limits[j])
            if not k:
                continue
            b = binned[rows, j]
            g = np.bincount(b, grad[rows], k + 1)[:k].cumsum()
            h = np.bincount(b, hess[rows], k + 1)[:k].cumsum()
            c = np.bincount(b, minlength=k + 1)[:k].cumsum()
            left = np.clip(-g / (h + smooth), low, high)
            right = np.clip(-(g_all - g) / (h_all - h + smooth), low, high)
            # the loss that the two clipped values save against one
            gain = -(g * left + 0.5 * (h + smooth) * left**2) - ((g_all - g) * right + 0.5 * (h_all - h + smooth) * right**2)
            whole = np.clip(-g_all / (h_all + smooth), low, high)
            gain += g_all * whole + 0.5 * (h_all + smooth) * whole**2
            ok = (c >= least_rows) & (len(rows) - c >= least_rows)
            if j in monotone:
                ok &= monotone[j] * (right - left) >= 0
            gain = np.where(ok, gain, -np.inf)
            at = int(gain.argmax())
            if gain[at] > found[0]:
                found = (float(gain[at]), j, at, float(left[at]), float(right[at]))
        return found

    for _ in range(rounds if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        root = add(0.0)
        grow = [(root, np.arange(n), -np.inf, np.inf, 0)]
        while grow:
            node, rows, low, high, level = grow.pop()
            _, j, at, left, right = best_split(rows, grad, hess, low, high) if level < depth else (0, -1, -1, 0, 0)
            if j < 0:
                margin[rows] += nodes[node][4]
                continue
            a, b = add(rate * left), add(rate * right)
            nodes[node][:4] = [j, limits[j][at], a, b]
            middle = (left + right) / 2
            below = binned[rows, j] <= at
            sign = monotone.get(j, 0)
            grow.append((a, rows[below], middle if sign < 0 else low, middle if sign > 0 else high, level + 1))
            grow.append((b, rows[~below], middle if sign > 0 else low, middle if sign < 0 else high, level + 1))
        roots.append(root)
    flat = np.array(nodes).reshape(-1, 5)
    return Forest(start, np.array(roots, dtype=np.int64), flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4], depth)
