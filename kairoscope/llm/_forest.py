"""A spanning forest of links that a task has found: connectivity in at most one link a row."""

from __future__ import annotations

import numpy as np


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member's index for each of n rows, under links between rows a and b (vectorised label hooking)."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
