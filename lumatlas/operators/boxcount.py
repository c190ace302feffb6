"""How many points lie in each of many boxes, without listing them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Whether values lie on the right side of a box's edge: (values, boxes) -> booleans. Monotone in the value.
Edge = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Points:
    """Points in order of their first coordinate; for every run of 1, 2, 4, ... of them the second coordinates in order."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(x, kind="stable")
        self.n, self.x = len(x), x[order]
        size = 1 << max(0, int(self.n - 1).bit_length())
        level = np.append(y[order], np.full(size - self.n, np.inf))  # what fills the last run up is never counted
        self.levels = [level]
        while len(level) and 1 << len(self.levels) <= size:
            level = np.sort(level.reshape(-1, 1 << len(self.levels)), axis=1).reshape(-1)
            self.levels.append(level)

    @staticmethod
    def _first(values: np.ndarray, start: np.ndarray, size: int, edge: Edge, boxes: np.ndarray, holds: bool) -> np.ndarray:
        """How many of the ``size`` values from ``start`` on come before the first for which ``edge`` is ``holds``."""
        low, high = np.zeros(len(start), dtype=np.int64), np.full(len(start), size)
        for _ in range(int(size).bit_length()):
            mid = np.minimum((low + high) // 2, size - 1)
            past = edge(values[start + mid], boxes) == holds
            go = low < high
            high = np.where(go & past, mid, high)
            low = np.where(go & ~past, mid + 1, low)
        return low

    def count(self, x_from: Edge, x_to: Edge, y_from: Edge, y_to: Edge, boxes: int) -> np.ndarray:
        """Points for which all four edges hold, for each box."""
        out, every = np.zeros(boxes, dtype=np.int64), np.arange(boxes)
        if not self.n:
            return out
        none = np.zeros(boxes, dtype=np.int64)
        low = self._first(self.x, none, self.n, x_from, every, True)
        high = np.maximum(low, self._first(self.x, none, self.n, x_to, every, False))
        for k, level in enumerate(self.levels):
            size = 1 << k
            for side, at in (((low & 1) == 1, low), ((high & 1) == 1, high - 1)):
                q = np.flatnonzero(side & (low < high))
                if len(q):
                    start = at[q] << k
                    a, b = (self._first(level, start, size, edge, q, holds) for edge, holds in ((y_from, True), (y_to, False)))
                    out[q] += np.maximum(b - a, 0)
            low, high = (low + 1) >> 1, high >> 1
            high = np.maximum(low, high)
        return out
