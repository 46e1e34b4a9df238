"""Union-find over the members of one group, vectorised."""

from __future__ import annotations

import numpy as np


class Joined:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def settle(self) -> np.ndarray:
        while True:
            further = self.root[self.root]
            if np.array_equal(further, self.root):
                return self.root
            self.root = further

    def link(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The given pairs that were needed to join what they join."""
        used_i, used_j = [i[:0]], [j[:0]]
        while len(i):
            root = self.settle()
            high, low = np.maximum(root[i], root[j]), np.minimum(root[i], root[j])
            apart = high != low
            i, j, high, low = i[apart], j[apart], high[apart], low[apart]
            _, one = np.unique(high, return_index=True)
            self.root[high[one]] = low[one]
            used_i.append(i[one])
            used_j.append(j[one])
        return np.concatenate(used_i), np.concatenate(used_j)
