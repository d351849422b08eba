"""Follow-the-regularised-leader updates on sparse rows, with one rate per weight."""

from __future__ import annotations

import numpy as np

_BLOCK = 1 << 16


class Ftrl:
    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self._z, self._n = np.zeros(size), np.zeros(size)

    def at(self, index) -> np.ndarray:
        """The weights at some places."""
        z, n = self._z[index], self._n[index]
        leader = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, leader)

    def learn(self, index: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        n = self._n[index]
        grown = n + gradient * gradient
        self._z[index] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * weights
        self._n[index] = grown

    def all(self) -> np.ndarray:
        out = np.empty(len(self._z))
        for k in range(0, len(out), _BLOCK):
            out[k : k + _BLOCK] = self.at(slice(k, k + _BLOCK))
        return out
