"""Small linear models fitted in numpy on bounded samples, and calibration."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray | None = None, l2: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Weights and, last, the bias of an L2-regularised logistic regression (Newton, damped)."""
    n, d = x.shape
    x = np.hstack([x, np.ones((n, 1))])
    sw = np.ones(n) if sample_weight is None else sample_weight
    sw = sw / max(sw.sum(), 1e-12)
    reg = np.full(d + 1, l2)
    reg[-1] = 1e-6
    w = np.zeros(d + 1)

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((sw * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (reg * v * v).sum())

    now = loss(w)
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (sw * (p - y)) + reg * w
        h = (x * (sw * p * (1 - p))[:, None]).T @ x + np.diag(reg + 1e-9)
        step = np.linalg.solve(h, g)
        t = 1.0
        while t > 1e-4 and (new := loss(w - t * step)) > now:
            t /= 2
        if t <= 1e-4:
            break
        w, gain, now = w - t * step, now - new, new
        if gain < 1e-9:
            break
    return w


def logistic_sparse(
    rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int, d: int, y: np.ndarray, sample_weight: np.ndarray, l2: float, steps: int = 150
) -> np.ndarray:
    """The same for a sparse matrix, by accelerated gradient steps. Returns d weights and the bias."""
    sw = sample_weight / max(sample_weight.sum(), 1e-12)
    norm = np.bincount(rows, vals * vals, minlength=n)
    rate = 1.0 / (0.25 * float((sw * (norm + 1)).sum()) + l2)
    w = np.zeros(d + 1)
    v, t = w.copy(), 1.0
    for _ in range(steps):
        z = np.bincount(rows, vals * v[cols], minlength=n) + v[-1]
        r = sw * (sigmoid(z) - y)
        g = np.r_[np.bincount(cols, vals * r[rows], minlength=d) + l2 * v[:d], r.sum()]
        new = v - rate * g
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / nt * (new - w)
        w, t = new, nt
    return w


def platt(z: np.ndarray, y: np.ndarray, sample_weight: np.ndarray | None = None) -> tuple[float, float]:
    """(slope, offset) that turn scores into log-odds; targets are smoothed as Platt does."""
    pos, neg = float((y > 0).sum()), float((y == 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.std(z)), 1e-9)
    w = logistic(z[:, None] / scale, t, sample_weight, l2=1e-4)
    return max(w[0], 0.0) / scale, w[1]
