"""Small linear classifiers fitted on bounded samples (numpy, L-BFGS)."""

from __future__ import annotations

from collections import deque

import numpy as np


class Rows:
    """Sparse design matrix from coordinate arrays, with a trailing constant column."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, d: int):
        self.row, self.col, self.val, self.n, self.d = row, col, val, n, d + 1

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n) + w[-1]

    def transposed(self, r: np.ndarray) -> np.ndarray:
        g = np.bincount(self.col, self.val * r[self.row], self.d)
        g[-1] += r.sum()
        return g

    def pick(self, mask: np.ndarray) -> "Rows":
        new = np.cumsum(mask) - 1
        m = mask[self.row]
        return Rows(new[self.row[m]], self.col[m], self.val[m], int(mask.sum()), self.d - 1)


def _logistic(z, y):
    """y in {-1, 1}: loss and its derivative in z."""
    m = y * z
    return np.logaddexp(0, -m).sum(), -y * sigmoid(-m)


def _hinge2(z, y):
    gap = np.maximum(1 - y * z, 0)
    return (gap ** 2).sum(), -2 * y * gap


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, float)))


def fit(x: Rows, positive: np.ndarray, l2: float = 1.0, loss: str = "logistic", steps: int = 60) -> np.ndarray:
    """Weights (last: intercept, not penalised) of the L2-regularised linear model."""
    f = {"logistic": _logistic, "hinge2": _hinge2}[loss]
    y = np.where(positive, 1.0, -1.0)
    free = np.ones(x.d)
    free[-1] = 0

    def at(w):
        value, dz = f(x.times(w), y)
        return value + 0.5 * l2 * (free * w * w).sum(), x.transposed(dz) + l2 * free * w

    w = np.zeros(x.d)
    value, g = at(w)
    past: deque = deque(maxlen=8)
    for _ in range(steps):
        if np.abs(g).max(initial=0) < 1e-4 * max(1, x.n) ** 0.5:
            break
        step = g.copy()
        kept = []
        for s, t in reversed(past):
            a = (s @ step) / (s @ t)
            kept.append(a)
            step -= a * t
        if past:
            s, t = past[-1]
            step *= (s @ t) / (t @ t)
        else:
            step /= max(np.linalg.norm(g), 1e-12)
        for (s, t), a in zip(past, reversed(kept)):
            step += s * (a - (t @ step) / (s @ t))
        slope, size = g @ step, 1.0
        while size > 1e-10:
            new = w - size * step
            v, h = at(new)
            if v <= value - 1e-4 * size * slope:
                break
            size *= 0.5
        else:
            break
        if (new - w) @ (h - g) > 1e-12:
            past.append((new - w, h - g))
        small = value - v < 1e-6 * max(1.0, abs(v))
        w, value, g = new, v, h
        if small:
            break
    return w
