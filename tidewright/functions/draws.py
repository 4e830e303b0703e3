"""Random numbers that belong to a row or a path, not to the task that happens to draw them."""

from __future__ import annotations

import numpy as np


def uniform(ids: np.ndarray, *keys: int) -> np.ndarray:
    """A number of [0, 1) for every id and the given keys, the same wherever and whenever it is drawn."""
    x = ids.astype(np.uint64)
    for key in keys:
        x = x + np.uint64((key * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) * 2.0 ** -53


def laplace(u: np.ndarray, scale: float) -> np.ndarray:
    """Numbers of [0, 1) turned into ones of a Laplace distribution around zero."""
    off = u - 0.5
    return -scale * np.sign(off) * np.log1p(-2 * np.minimum(np.abs(off), 0.5 - 2.0 ** -54))
