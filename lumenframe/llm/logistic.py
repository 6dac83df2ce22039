"""Logistic regression by Newton's method, for a few dozen features and rows that fit the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40, empty: float = 0.5) -> Logistic:
        """``ridge`` holds all weights but the constant. Rows of one class alone give their share of the class, no rows ``empty``;
        such a share is kept between 0.01 and 0.99."""
        width = x.shape[1]
        if len(y) == 0 or y.min() == y.max():
            share = np.clip(y.mean() if len(y) else empty, 0.01, 0.99)
            return Logistic(np.zeros(width), np.ones(width), np.concatenate([np.zeros(width), [np.log(share / (1 - share))]]))
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        w, hold = np.zeros(width + 1), np.concatenate([np.full(width, ridge), [1e-6]])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold), z.T @ (y - p) - hold * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        return Logistic(mean, scale, w)

    def of(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
